"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import frequency, hash_to_min, history, leak, names, pii, set_join, survivors, tokens
from echofold.operators.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.keep(table(spark, d, "duplicate_group"))


def p1_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivors.golden(table(spark, d, "duplicate_group"))


def p1_golden_by_trust(spark: SparkSession, d: str) -> DataFrame:
    return survivors.golden(table(spark, d, "duplicate_group"), by_trust=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variants(table(spark, d, "audio_file"))


def p2_artists(spark: SparkSession, d: str) -> DataFrame:
    return names.artists(table(spark, d, "audio_file"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posting")
    freq = frequency.frequencies(p, "term", "file_id")
    return frequency.marked(freq, frequency.n_records(p, "term", "file_id")).where(F.col("mark").isNotNull()).select("term", "mark")


def p3_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequency.frequencies(table(spark, d, "posting"), "term", "file_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hash_to_min.groups(table(spark, d, "edge"), where=F.col("similarity") >= 0.85)


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """(id, batch, fingerprint): batch 0 holds the cached files that are indexed, by the row of the latest mtime."""
    c = table(spark, d, "fingerprint_cache").where(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.struct("mtime", "duration", "fingerprint")).alias("r"))
    old = c.join(table(spark, d, "indexed_file").select("id", "path"), "path").select("id", F.lit(0).alias("batch"), F.col("r.fingerprint").alias("fingerprint"))
    return old.unionByName(table(spark, d, "incoming_file").select("id", F.col("batch_no").alias("batch"), "fingerprint"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The cached files are the history, which is appended first; then the batches are appended and matched by their hashes."""
    files = p6_files(spark, d)
    store = history.HashStore(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
    store.append(files.where(F.col("batch") == 0), 0)
    store.append(files.where(F.col("batch") > 0), 1)
    return store.match(1)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return set_join.similar_sets(table(spark, d, "posting"), "term", "file_id", 0.5).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


#: The key of the surrogates; a user gives their own secret.
KEY = "demonstration key"


def _found(spark: SparkSession, d: str) -> DataFrame:
    return pii.detect(table(spark, d, "documents"), table(spark, d, "member_roll"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.pseudonyms(table(spark, d, "documents"), table(spark, d, "member_roll"), KEY).select("doc_id", "kind", "value").distinct()


def p10_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return pii.surrogates(_found(spark, d), KEY).select("kind", "value", "surrogate")


def p10_replaced(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    return pii.replaced(table(spark, d, "documents"), found, pii.surrogates(found, KEY))


NAMES = (p1_found, p1_golden, p1_golden_by_trust, p2_found, p2_artists, p3_found, p3_frequencies, p4_found, p6_found, p7_found, p8_ids, p9_found, p10_found, p10_surrogates, p10_replaced)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMES}
