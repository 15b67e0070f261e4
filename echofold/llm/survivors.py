"""One surviving record per group of duplicates, chosen field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit rates are given in bit/s or in kbit/s; no sound of under 8 kbit/s is told apart from one of 8 Mbit/s.
KBIT_BELOW = 8000


def survivors(rows: DataFrame, keys: list[str], fields: dict[str, Column], order: Column, priority: Column | None = None, known: dict[str, Column] | None = None) -> DataFrame:
    """One row per key with, for each field, the value that survives.

    A single aggregation: per field the maximum of the struct (known, source
    priority, order, value), so a known value beats an unknown one, then the
    better source, then the later record, then the greater value.  A value is
    known if it is not null and ``known[field]`` (if given) is true; a field
    that no record knows comes out null.  Maxima combine before the shuffle,
    so a key with most of the rows is no burden on its task.
    """
    rank = F.lit(0) if priority is None else F.coalesce(priority, F.lit(-(1 << 31)))
    aggs = []
    for name, value in fields.items():
        ok = value.isNotNull() & (F.coalesce(known[name], F.lit(False)) if known and name in known else F.lit(True))
        aggs.append(F.max(F.struct(ok.alias("known"), rank.alias("rank"), order.alias("order"), F.when(ok, value).alias("value"))).alias(name))
    best = rows.groupBy(*keys).agg(*aggs)
    return best.select(*keys, *[F.col(f"{name}.value").alias(name) for name in fields])


def members(groups: DataFrame) -> DataFrame:
    """(group_id, path, bitrate, size, duration): one row per path of a group, each value the last known one by scan_ord.

    Only values above zero are known.  Entries without a path are dropped.
    """
    f = groups.select("group_id", F.explode("files").alias("f")).where(F.col("f.path").isNotNull())
    f = f.select("group_id", "f.path", "f.scan_ord", "f.bitrate", "f.size", "f.duration")
    fields = {n: F.col(n) for n in ("bitrate", "size", "duration")}
    return survivors(f, ["group_id", "path"], fields, F.col("scan_ord"), known={n: c > 0 for n, c in fields.items()})


def rate(bitrate: Column, size: Column, duration: Column) -> Column:
    """bit/s: the known bit rate in whichever unit, else what size and duration give; null if neither is known."""
    entered = F.when(bitrate < KBIT_BELOW, bitrate.cast("double") * 1000).otherwise(bitrate.cast("double"))
    return F.coalesce(entered, size * 8.0 / duration)


def keep(groups: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(group_id, keep_path) of each group of two or more paths with a rate.

    Among the members whose rate is within ``tolerance`` of the highest, the
    largest (unknown size: 0), then the smallest path.  The highest rate is
    aggregated first and joined back; a group of any size is split by
    adaptive skew handling on the members' side, the other side having one
    row a group.
    """
    m = members(groups).withColumn("rate", rate(F.col("bitrate"), F.col("size"), F.col("duration")))
    top = m.groupBy("group_id").agg(F.max("rate").alias("top"), F.count("*").alias("n")).where((F.col("n") >= 2) & F.col("top").isNotNull())
    near = m.join(top, "group_id").where(F.col("rate") * 100.0 >= F.col("top") * (100.0 - 100.0 * tolerance))
    best = F.min(F.struct((-F.coalesce("size", F.lit(0))).alias("s"), "path"))
    return near.groupBy("group_id").agg(best.alias("b")).select("group_id", F.col("b.path").alias("keep_path"))


#: Suffixes of the formats that are kept without loss; what such a file says of itself is trusted before others.
LOSSLESS = ("flac", "wav", "aiff", "alac", "ape", "wv")


def trust(path: Column) -> Column:
    """2 for a file of a lossless format, 1 for any other with a path, 0 for none."""
    return F.when(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*LOSSLESS), 2).when(path.isNotNull(), 1).otherwise(0)


def golden(groups: DataFrame, by_trust: bool = False) -> DataFrame:
    """One built record per group: each field the last known value of any member, or ``by_trust`` that of the most trusted ones; blank texts are not known."""
    f = groups.select("group_id", F.explode("files").alias("f"))
    fields = {n: F.col(f"f.{n}") for n in ("bitrate", "size", "duration")} | {n: F.col(f"f.tags.{n}") for n in ("title", "artist", "album")}
    known = {n: (F.trim(c) != "" if n in ("title", "artist", "album") else c > 0) for n, c in fields.items()}
    return survivors(f, ["group_id"], fields, F.col("f.scan_ord"), trust(F.col("f.path")) if by_trust else None, known)
