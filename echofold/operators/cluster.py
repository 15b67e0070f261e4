"""Connected components, duplicate groups and the item to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.operators.shared import cut
from echofold.schema import CONFIDENT_DELTA_S


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component.

    Alternating large-star and small-star steps: each keeps the edge count
    from growing and both only need the minimum of a neighbourhood, which is
    aggregated before the shuffle; a star of any size is never gathered.
    Rounds are cut with written tables.  Loops and null ends are ignored; no
    edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    e = cut(e)
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def duplicate_groups(edges: DataFrame, comp: DataFrame, tolerance: float = CONFIDENT_DELTA_S) -> DataFrame:
    """(group, n_files, score, tag_score, confidence) of each component of two or more items.

    An edge lies within one component, so one end decides its group.
    """
    size = comp.groupBy("component").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= 2)
    facts = edges.join(comp, edges["a"] == comp["node"]).groupBy("component")
    facts = facts.agg(F.avg("similarity").alias("s"), F.avg("tag_score").alias("t"), F.max("duration_delta").alias("d"))
    return size.join(facts, "component", "left").select(
        F.col("component").alias("group"),
        "n_files",
        F.coalesce("s", F.lit(1.0)).alias("score"),
        F.coalesce("t", F.lit(0.0)).alias("tag_score"),
        F.when(F.coalesce("d", F.lit(0.0)) <= tolerance, "high").otherwise("medium").alias("confidence"),
    )


def keep_key(bitrate: Column, size: Column) -> Column:
    """Bit rate where known, else size: the units differ, by definition."""
    return F.when(bitrate > 0, bitrate.cast("double")).otherwise(F.coalesce(size, F.lit(0)).cast("double"))


def keep_best(members: DataFrame, group: str = "group") -> DataFrame:
    """(group, keep, savings, n_files): the member of the largest keep_key, the first scanned on ties; sizes unknown count 0."""
    size = F.coalesce("size", F.lit(0))
    order = F.struct(keep_key(F.col("bitrate"), F.col("size")).alias("k"), (-F.col("scan_ord")).alias("o"))
    best = F.max_by(F.struct(F.col("path").alias("path"), size.alias("size")), order)
    agg = members.groupBy(group).agg(best.alias("best"), F.sum(size).alias("total"), F.count("*").alias("n_files"))
    return agg.select(group, F.col("best.path").alias("keep"), (F.col("total") - F.col("best.size")).alias("savings"), "n_files")
