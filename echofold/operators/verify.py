"""Verification of candidate pairs and the attributes of confirmed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.functions.hamming import fingerprint_similarity
from echofold.functions.text import identity_score, tag_key
from echofold.schema import MAX_OFFSET, SIMILARITY_THRESHOLD


def similarities(pairs: DataFrame, items: DataFrame, threshold: float = SIMILARITY_THRESHOLD, max_offset: int = MAX_OFFSET) -> DataFrame:
    """(a, b, similarity) of each pair whose two fingerprints exist.

    Fingerprints are joined to the pairs only now: the wide column never
    passes through the candidate join.
    """
    fp = items.where(F.size(F.coalesce("fingerprint", F.array().cast("array<int>"))) > 0)
    both = pairs.select("a", "b").join(fp.select(F.col("path").alias("a"), F.col("fingerprint").alias("fa")), "a")
    both = both.join(fp.select(F.col("path").alias("b"), F.col("fingerprint").alias("fb")), "b")
    return both.select("a", "b", fingerprint_similarity(F.col("fa"), F.col("fb"), threshold, max_offset).alias("similarity"))


def edges(pairs: DataFrame, items: DataFrame, threshold: float = SIMILARITY_THRESHOLD, max_offset: int = MAX_OFFSET) -> DataFrame:
    """(a, b, similarity, tag_score, duration_delta) of the confirmed pairs; unknown durations count as 0."""
    good = similarities(pairs, items, threshold, max_offset).where(F.col("similarity") >= threshold)
    facts = items.select("path", F.coalesce("duration", F.lit(0.0)).alias("duration"), tag_key(F.col("tags.title"), F.col("tags.artist")).alias("key"))
    good = good.join(facts.select(F.col("path").alias("a"), F.col("duration").alias("da"), F.col("key").alias("ka")), "a")
    good = good.join(facts.select(F.col("path").alias("b"), F.col("duration").alias("db"), F.col("key").alias("kb")), "b")
    score = identity_score(F.col("a"), F.col("ka"), F.col("b"), F.col("kb")) / 100.0
    return good.select("a", "b", "similarity", score.alias("tag_score"), F.abs(F.col("da") - F.col("db")).alias("duration_delta"))
