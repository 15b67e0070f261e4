"""The whole detection as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.operators.cluster import components, duplicate_groups
from echofold.operators.index import candidate_pairs, document_frequency, postings
from echofold.operators.shared import cut
from echofold.operators.verify import edges
from echofold.schema import SIMILARITY_THRESHOLD, TERM_DF_CAP
from echofold.sources.files import latest


def library(files: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per path, the last scan; fingerprint and duration filled from the cache where unknown."""
    row = F.struct("scan_ord", "size", "duration", "bitrate", "tags", "fingerprint")
    last = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max_by(row, "scan_ord").alias("r")).select("path", "r.*")
    c = latest(cache).select("path", F.col("duration").alias("cd"), F.col("fingerprint").alias("cf"))
    known = F.coalesce("duration", F.lit(0.0))
    return last.join(c, "path", "left").select(
        "path",
        F.coalesce("size", F.lit(0)).alias("size"),
        F.when((known == 0) & (F.coalesce("cd", F.lit(0.0)) != 0), F.col("cd")).otherwise(known).alias("duration"),
        F.coalesce("bitrate", F.lit(0)).alias("bitrate"),
        "tags",
        F.coalesce("fingerprint", "cf").alias("fingerprint"),
        "scan_ord",
    )


@dataclass
class Result:
    """Frames of one detection; ``edges`` is materialised, the rest derives from it and from ``items``."""

    items: DataFrame
    edges: DataFrame
    components: DataFrame
    groups: DataFrame
    members: DataFrame


def find_duplicates(items: DataFrame, threshold: float = SIMILARITY_THRESHOLD, cap: int = TERM_DF_CAP, cache: DataFrame | None = None) -> Result:
    """Index, candidates, verification, components and groups of ``items`` (path unique, as of library()).

    Terms in more than ``cap`` files don't count: files of ``items`` or, if
    it is given, of all that ``cache`` (path, fingerprint) holds besides.
    """
    df = None
    if cache is not None:
        rest = cache.select("path", "fingerprint").join(items.select("path"), "path", "left_anti")
        df = cut(document_frequency(postings(items.select("path", "fingerprint").unionByName(rest))).where(F.col("df") > 1))
    found = cut(edges(candidate_pairs(postings(items), cap=cap, df=df), items, threshold))
    comp = components(found)
    groups = duplicate_groups(found, comp)
    facts = items.select("path", "size", "duration", "bitrate", "tags", "scan_ord")
    members = comp.join(facts, comp["node"] == facts["path"]).withColumnRenamed("component", "group").drop("node")
    return Result(items, found, comp, groups, members)
