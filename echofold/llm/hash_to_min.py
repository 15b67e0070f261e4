"""Groups from pairwise matches by Hash-to-Min."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.operators.shared import cut

#: A cluster of more than this share of all rows is joined by broadcast of its one row; there are at most 1/share.
HEAVY_SHARE = 1 / 256


def _with_min(c: DataFrame, rows: int) -> DataFrame:
    """``c`` (v, u) with m, the least u of v.

    The minimum is aggregated before the shuffle.  It is joined back by
    shuffle for most vertices; the few that hold a large share of the rows
    would overload a task and are joined by broadcast (at most 1/HEAVY_SHARE
    rows), so their rows stay where they are.
    """
    low = c.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
    heavy = [(r["v"], r["m"]) for r in low.where(F.col("n") > max(1000, int(rows * HEAVY_SHARE))).select("v", "m").collect()]
    if not heavy:
        return c.join(low.select("v", "m"), "v")
    is_heavy = F.col("v").isin([v for v, _ in heavy])
    few = F.broadcast(c.sparkSession.createDataFrame(heavy, "v bigint, m bigint"))
    return c.where(~is_heavy).join(low.select("v", "m"), "v").unionByName(c.where(is_heavy).join(few, "v"))


def groups(pairs: DataFrame, a: str = "a", b: str = "b", where: Column | None = None, max_rounds: int = 64) -> DataFrame:
    """(path, group_path): every end of a pair with the least end of its group, itself included.

    Ends are numbered in their own order, so the least number is the least
    end.  C(v) starts as v with its neighbours, one row (v, u) per member.
    A round sends C(v) to its minimum m and m to all of C(v), and unions what
    each vertex receives, until nothing changes.  Clusters are rows, never
    arrays.  Pairs with a null end, pairs of an end with itself and repeated
    pairs add nothing; without pairs there are no rows.
    """
    p = pairs if where is None else pairs.where(where)
    p = p.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    ends = p.select(F.col("a").alias("end")).unionByName(p.select(F.col("b").alias("end"))).distinct()
    ids = cut(ends.orderBy("end").withColumn("id", F.monotonically_increasing_id()))
    e = p.join(ids.select(F.col("end").alias("a"), F.col("id").alias("v")), "a").join(ids.select(F.col("end").alias("b"), F.col("id").alias("u")), "b").select("v", "u")
    own = ids.select(F.col("id").alias("v"), F.col("id").alias("u"))
    c = cut(e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).unionByName(own).distinct())
    seen = None
    for _ in range(max_rounds):
        now = tuple(c.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
        m = _with_min(c, now[0])
        c = cut(m.select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("r")).select("r.v", "r.u").distinct())
    else:
        raise RuntimeError(f"Hash-to-Min: not settled after {max_rounds} rounds")
    root = c.groupBy("v").agg(F.min("u").alias("m"))
    named = root.join(ids.select(F.col("id").alias("v"), F.col("end").alias("path")), "v").join(ids.select(F.col("id").alias("m"), F.col("end").alias("group_path")), "m")
    return named.select("path", "group_path")
