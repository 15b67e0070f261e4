"""The registered queries of the core: name -> function of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions import bits, text
from echofold.operators import cluster, index, skew, verify
from echofold.plans.pipeline import Result, find_duplicates, library
from echofold.schema import MIN_SIZE_KB, SIMILARITY_THRESHOLD
from echofold.sources import files as src
from echofold.sources import report, store

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    return library(table(spark, d, "audio_file"), table(spark, d, "fingerprint_cache"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(items(spark, d))


def _detect(spark: SparkSession, d: str) -> Result:
    return find_duplicates(items(spark, d))


def scan_min_size(spark: SparkSession, d: str) -> DataFrame:
    return src.wanted(table(spark, d, "audio_file"), MIN_SIZE_KB * 1024).select("path", "size", "scan_ord")


def coerced_info(spark: SparkSession, d: str) -> DataFrame:
    t = src.coerce_info(table(spark, d, "audio_file"))
    return t.select("scan_ord", "duration", "bitrate", F.col("tags.title").alias("title"), F.col("tags.artist").alias("artist"))


def signed32(spark: SparkSession, d: str) -> DataFrame:
    t = src.latest(table(spark, d, "fingerprint_cache")).select("path", F.posexplode("fingerprint").alias("pos", "x"))
    u = t.select("path", "pos", bits.unsigned32(F.col("x")).alias("unsigned"))
    return u.withColumn("signed", bits.to_signed32(F.col("unsigned")))


def cache_freshness_split(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "incoming_file").select("id", "path", "mtime", "duration")
    t = src.split_fresh(new, table(spark, d, "fingerprint_cache"))
    return t.select("id", "path", "hit", "duration", F.size(F.when(F.col("hit"), F.coalesce("cached_fingerprint", F.array().cast("array<int>")))).alias("frames"))


def cache_progress(spark: SparkSession, d: str) -> DataFrame:
    """How many files of each batch are cached and how many have to be computed."""
    t = src.split_fresh(table(spark, d, "incoming_file").select("batch_no", "path", "mtime", "duration"), table(spark, d, "fingerprint_cache"))
    return t.groupBy("batch_no").agg(F.count_if("hit").alias("cached"), F.count_if(~F.col("hit")).alias("to_compute"))


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "incoming_file").select("path", "mtime", "duration", "fingerprint")
    t = store.upsert(src.latest(table(spark, d, "fingerprint_cache")), new)
    return t.select("path", "mtime", "duration", F.size("fingerprint").alias("frames"))


def backfill_missing(spark: SparkSession, d: str) -> DataFrame:
    t = store.missing_from_index(table(spark, d, "fingerprint_cache"), table(spark, d, "indexed_file"))
    return index.postings(t)


def eligible(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).where(F.size("fingerprint") > 0).select("path", F.size("fingerprint").alias("frames"))


def cache_count(spark: SparkSession, d: str) -> DataFrame:
    return src.latest(table(spark, d, "fingerprint_cache")).agg(F.count("*").alias("n"))


def term_postings(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d)


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.term_counts(posts(spark, d))


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return index.document_frequency(posts(spark, d))


def df_capped_postings(spark: SparkSession, d: str) -> DataFrame:
    return index.df_capped(posts(spark, d), cap=20).select("path", "term", "df")


def df_capped_postings_default(spark: SparkSession, d: str) -> DataFrame:
    """With the cap that find_duplicates() uses."""
    return index.df_capped(posts(spark, d)).select("path", "term", "df")


def shared_terms(spark: SparkSession, d: str) -> DataFrame:
    return index.shared_terms(posts(spark, d))


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return index.candidate_pairs(posts(spark, d))


def candidates_of_posting(spark: SparkSession, d: str) -> DataFrame:
    """The candidate query over the stored postings and files, a file's term_count as stored, dirt included."""
    p = table(spark, d, "posting").dropna().distinct()
    named = p.join(table(spark, d, "indexed_file").select(F.col("id").alias("file_id"), "path", "term_count"), "file_id")
    pairs = index.shared_terms(named.select("path", "term"))
    n = table(spark, d, "indexed_file").select("path", F.coalesce("term_count", F.lit(0)).alias("n"))
    pairs = pairs.join(n.select(F.col("path").alias("a"), F.col("n").alias("terms_a")), "a").join(n.select(F.col("path").alias("b"), F.col("n").alias("terms_b")), "b")
    return pairs.where(index.containment(F.col("shared"), F.col("terms_a"), F.col("terms_b"))).select("a", "b", "shared")


def find_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The lookup of single files: those whose id is divisible by 50, against all files that the stored postings hold."""
    files = table(spark, d, "indexed_file").select(F.col("id").alias("file_id"), "path")
    post = table(spark, d, "posting").dropna().distinct().join(files, "file_id")
    return index.find_candidates(post.where(F.col("file_id") % 50 == 0), post.select("path", "term"))


def shared_terms_in_cache_scope(spark: SparkSession, d: str) -> DataFrame:
    """Shared terms of the new files, of terms that count as rare among all files that are cached or new."""
    new = library_of(table(spark, d, "incoming_file"))
    cached = src.latest(table(spark, d, "fingerprint_cache")).join(new.select("path"), "path", "left_anti")
    df = index.document_frequency(index.postings(new.unionByName(cached.select("path", "fingerprint"))))
    return index.shared_terms(index.postings(new), cap=60, df=df)


def library_of(files: DataFrame) -> DataFrame:
    """(path, fingerprint) of the latest row of each path."""
    return src.latest(files.select("path", "mtime", "duration", "fingerprint")).select("path", "fingerprint")


def cache_force_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The freshness split when everything is to be computed again: no row is a hit, no duration is filled."""
    t = src.split_fresh(table(spark, d, "incoming_file").select("id", "mtime", "path", "duration"), table(spark, d, "fingerprint_cache"), force_refresh=True)
    return t.select("id", "hit", "duration")


def report_files(spark: SparkSession, d: str) -> DataFrame:
    """The file lines of the text report, in the order of its sections, groups and files."""
    groups, members = _stored_members(spark, d)
    return report.report_files(report.report_rows(groups, members), members)


def json_encoded(spark: SparkSession, d: str) -> DataFrame:
    """The report's groups as JSON objects, as they are written, non-ASCII letters as themselves."""
    r = report.json_rows(*_stored_members(spark, d))
    return r.select("keep", F.to_json(F.struct("tier", "confidence", "files", "keep")).alias("json"))


def hamming_at_offset(spark: SparkSession, d: str) -> DataFrame:
    both = _paired(spark, d)
    at = {f"s{n}": F.round(bits.similarity_at_offset(F.col("fa"), F.col("fb"), F.lit(k)), 9) for n, k in (("0", 0), ("5", 5), ("_5", -5))}
    return both.select("a", "b", *[c.alias(n) for n, c in at.items()])


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the confirmed or refused edges whose files are in the library."""
    t, e = items(spark, d).where(F.size("fingerprint") > 0), table(spark, d, "edge")
    e = e.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = e.join(t.select(F.col("path").alias("a"), F.col("fingerprint").alias("fa")), "a")
    return e.join(t.select(F.col("path").alias("b"), F.col("fingerprint").alias("fb")), "b")


def fingerprint_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).select("a", "b", F.round(bits.fingerprint_similarity(F.col("fa"), F.col("fb")), 9).alias("similarity"))


def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audio_file").select("scan_ord", text.normalize(F.col("tags.title")).alias("norm"))


def normalize_artist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audio_file").select("scan_ord", text.normalize_artist(F.col("tags.artist")).alias("norm"))


def normalize_stem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audio_file").select("scan_ord", text.normalize_stem(F.col("path")).alias("norm"))


def identity_score(spark: SparkSession, d: str) -> DataFrame:
    t = items(spark, d).select("path", text.tag_key(F.col("tags.title"), F.col("tags.artist")).alias("k"))
    e = _paired(spark, d).select("a", "b")
    e = e.join(t.select(F.col("path").alias("a"), F.col("k").alias("ka")), "a").join(t.select(F.col("path").alias("b"), F.col("k").alias("kb")), "b")
    return e.select("a", "b", F.round(text.identity_score(F.col("a"), F.col("ka"), F.col("b"), F.col("kb")), 6).alias("score"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    t = items(spark, d)
    e = verify.edges(index.candidate_pairs(index.postings(t)), t)
    return e.select("a", "b", F.round("similarity", 9).alias("similarity"), F.round("duration_delta", 6).alias("duration_delta"))


def _stored_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edge table in one row per unordered pair of two paths, confirmed rows only; of repeated rows the greatest values."""
    e = table(spark, d, "edge").where((F.col("a") != F.col("b")) & (F.col("similarity") >= SIMILARITY_THRESHOLD))
    e = e.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    e = e.agg(*[F.max(c).alias(c) for c in ("similarity", "tag_score", "duration_delta")])
    return e.withColumnsRenamed({"x": "a", "y": "b"})


def components(spark: SparkSession, d: str) -> DataFrame:
    return cluster.components(_stored_edges(spark, d))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    e = _stored_edges(spark, d)
    g = cluster.duplicate_groups(e, cluster.components(e))
    return g.withColumns({c: F.round(c, 6) for c in ("score", "tag_score")})


def _stored_members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, t = _stored_edges(spark, d), items(spark, d)
    comp = cluster.components(e)
    members = comp.join(t, comp["node"] == t["path"]).withColumnRenamed("component", "group").drop("node")
    return cluster.duplicate_groups(e, comp), members


def keep_best(spark: SparkSession, d: str) -> DataFrame:
    return cluster.keep_best(_stored_members(spark, d)[1])


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    r = report.report_rows(*_stored_members(spark, d))
    return r.select("group", "confidence", "number", "length", "note", "keep", "savings", "label")


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.report_summary(items(spark, d), report.report_rows(*_stored_members(spark, d)))


def json_report(spark: SparkSession, d: str) -> DataFrame:
    r = report.json_rows(*_stored_members(spark, d))
    return r.select("tier", "confidence", "score", "tag_score", F.array_join("files", "\n").alias("files"), "keep")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    """What a dry run would do with the stored groups, of which the files of the library exist."""
    f = table(spark, d, "duplicate_group").select("group_id", F.posexplode("files").alias("pos", "f")).select("group_id", "pos", "f.*")
    last = f.groupBy("group_id", "path").agg(F.max_by(F.struct("size", "bitrate", "scan_ord"), "scan_ord").alias("r")).select(F.col("group_id").alias("group"), "path", "r.*")
    files = F.array_sort(F.collect_list("path"))
    rep = last.groupBy("group").agg(files.alias("files")).join(cluster.keep_best(last).select("group", "keep"), "group")
    return report.apply_plan(rep, table(spark, d, "indexed_file").select("path"))


def apply_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


def apply_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.apply_counts(_plan(spark, d))


def detected_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges that the whole pipeline finds, with both scores."""
    return _detect(spark, d).edges.select("a", "b", F.round("similarity", 6).alias("similarity"), F.round("tag_score", 6).alias("tag_score"))


def detected_groups(spark: SparkSession, d: str) -> DataFrame:
    g = _detect(spark, d).groups
    return g.withColumns({c: F.round(c, 6) for c in ("score", "tag_score")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The file with the most rows of each term that holds at least 1 percent of the rows of posting."""
    return skew.hot_key_modes(table(spark, d, "posting"), "term", "file_id", share=0.01)


def p5_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of file_id over the rows of each term that holds at least 1 percent of the rows of posting."""
    return skew.hot_key_quantiles(table(spark, d, "posting"), "term", "file_id", share=0.01, quantiles=(0.25, 0.5, 0.75))


NAMES = (
    scan_min_size, coerced_info, signed32, cache_freshness_split, cache_progress, cache_upsert, backfill_missing, eligible, cache_count,
    term_postings, term_counts, document_frequency, df_capped_postings, df_capped_postings_default, shared_terms, candidate_pairs, candidates_of_posting,
    hamming_at_offset, fingerprint_similarity, normalize_title, normalize_artist, normalize_stem, identity_score, edges,
    components, duplicate_groups, keep_best, report_rows, report_summary, json_report, apply_plan, apply_counts,
    find_candidates, shared_terms_in_cache_scope, cache_force_refresh, report_files, json_encoded,
    detected_edges, detected_groups, p5_found, p5_quantiles,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMES}
