"""The inverted index: postings, document frequency and the candidate self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions.bits import extract_terms
from echofold.schema import MIN_SHARED_FRACTION, MIN_SHARED_TERMS, TERM_DF_CAP


def postings(items: DataFrame, key: str = "path", stride: int = 1) -> DataFrame:
    """(key, term), distinct.  Items without frames have no rows.  ``key`` must be unique in ``items``.

    No shuffle: a fingerprint's terms are made distinct within its row.
    """
    return items.where(F.col(key).isNotNull()).select(key, F.explode(extract_terms(F.col("fingerprint"), stride)).alias("term"))


def term_counts(post: DataFrame, key: str = "path") -> DataFrame:
    """(key, term_count) of distinct postings."""
    return post.groupBy(key).agg(F.count("*").alias("term_count"))


def document_frequency(post: DataFrame) -> DataFrame:
    """(term, df) of distinct postings; partial counts are made before the shuffle."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def df_capped(post: DataFrame, df: DataFrame | None = None, cap: int = TERM_DF_CAP, least: int = 1) -> DataFrame:
    """Postings with their df, of the terms with least <= df <= cap.

    The counts are of ``post`` itself unless ``df`` (term, df), counts of a
    wider scope, is given.
    """
    if df is None:
        counted = document_frequency(post).where(F.col("df").between(least, cap))
    else:
        counted = df.where(F.col("df").between(least, cap))
    return post.join(counted, "term")


def containment(shared: Column, n_a: Column, n_b: Column, min_abs: int = MIN_SHARED_TERMS, min_fraction: float = MIN_SHARED_FRACTION) -> Column:
    """Whether ``shared`` terms make a pair worth verifying: an absolute floor and a share of the smaller set."""
    return shared >= F.greatest(F.lit(min_abs), F.ceil(F.lit(float(min_fraction)) * F.least(n_a, n_b)))


def shared_terms(post: DataFrame, key: str = "path", min_abs: int = MIN_SHARED_TERMS, cap: int = TERM_DF_CAP, df: DataFrame | None = None) -> DataFrame:
    """(a, b, shared) for a < b with at least ``min_abs`` common terms of df <= cap, counted in ``post`` or, with ``df`` (term, df), in a wider scope.

    A plain self-join emits df^2 rows per term.  Here each item first leaves
    out its min_abs-1 most frequent terms: two items with min_abs common
    terms still meet in one of the rest, whichever it is, so nothing is lost,
    and the join never sees the most frequent terms of ordinary items.  Pairs
    found are counted exactly over the whole capped sets afterwards.
    """
    kept = df_capped(post, df, cap, least=2).select(key, "term", "df")
    frequent_first = Window.partitionBy(key).orderBy(F.col("df").desc(), F.col("term").desc())
    ranked = kept.withColumn("rank", F.row_number().over(frequent_first))
    sets = kept.groupBy(key).agg(F.collect_list("term").alias("terms")).where(F.size("terms") >= min_abs)
    probe = ranked.where(F.col("rank") >= min_abs).select(key, "term")
    a = probe.select(F.col(key).alias("a"), "term")
    b = probe.select(F.col(key).alias("b"), "term")
    met = a.join(b, "term").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    both = met.join(sets.select(F.col(key).alias("a"), F.col("terms").alias("ta")), "a").join(sets.select(F.col(key).alias("b"), F.col("terms").alias("tb")), "b")
    return both.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("bigint").alias("shared")).where(F.col("shared") >= min_abs)


def candidate_pairs(post: DataFrame, key: str = "path", min_abs: int = MIN_SHARED_TERMS, min_fraction: float = MIN_SHARED_FRACTION, cap: int = TERM_DF_CAP, df: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, terms_a, terms_b): shared counts capped terms only, the set sizes count all terms."""
    n = term_counts(post, key)
    pairs = shared_terms(post, key, min_abs, cap, df)
    pairs = pairs.join(n.select(F.col(key).alias("a"), F.col("term_count").alias("terms_a")), "a")
    pairs = pairs.join(n.select(F.col(key).alias("b"), F.col("term_count").alias("terms_b")), "b")
    return pairs.where(containment(F.col("shared"), F.col("terms_a"), F.col("terms_b"), min_abs, min_fraction)).select("a", "b", "shared", "terms_a", "terms_b")


def find_candidates(queries: DataFrame, post: DataFrame, min_abs: int = MIN_SHARED_TERMS, cap: int = TERM_DF_CAP, df: DataFrame | None = None) -> DataFrame:
    """(path, candidate, shared, term_count): for each file of ``queries`` (path, term) the files of ``post`` (path, term), behind it in order, with at least ``min_abs`` of its terms.

    The lookup that a new file needs: only the lists of its terms are read
    on, never the pairs of the others.  Terms of df > cap, in ``post`` or in
    ``df``, don't count; term_count counts all terms of the candidate.
    """
    asked = queries.select("path", "term").dropna().distinct()
    lists = post.select(F.col("path").alias("candidate"), "term").join(asked.select("term").distinct(), "term", "left_semi")
    rare = (lists.groupBy("term").agg(F.count("*").alias("df")) if df is None else df).where(F.col("df") <= cap).select("term")
    met = asked.join(rare, "term").join(lists, "term").where(F.col("candidate") > F.col("path"))
    met = met.groupBy("path", "candidate").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_abs)
    return met.join(term_counts(post).withColumnRenamed("path", "candidate"), "candidate").select("path", "candidate", "shared", "term_count")
