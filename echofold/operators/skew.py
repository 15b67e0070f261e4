"""Per-key results where a few keys hold most rows.

The tools here never bring the rows of a key together.  Rows are only
counted into histograms, whose counts merge, so that a hot key costs each
task what a cold one does and the driver sees bins, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.operators.shared import cut

BUCKETS = 1 << 14
#: Bins of a key and round; with at most 1/share keys this bounds what the driver gets.
BINS = 1 << 10


def hot_keys(rows: DataFrame, key: str, share: float, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """(key, rows) of the keys with at least ``share`` of all rows of ``rows``; at most 1/share of them.

    Two counting passes, without a shuffle of the distinct keys: the hash
    histogram of all rows first, then the exact counts of the keys in the
    buckets that are heavy enough, since a hot key makes its bucket hot.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    total_by = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()  # at most `buckets` rows
    least = max(1, math.ceil(share * sum(r["n"] for r in total_by) - 1e-9))
    heavy = [r["b"] for r in total_by if r["n"] >= least]
    if not heavy:
        return []
    counted = rows.where(bucket.isin(heavy)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sorted((r[key], r["n"]) for r in counted.collect())  # at most 1/share rows


def select_ranks(counts: DataFrame, ranks: dict[int, Sequence[int]], bins: int = BINS) -> dict[int, list[int]]:
    """The values at 1-based ranks of each key, exactly, by refining histograms.

    ``counts`` (key BIGINT, value BIGINT, n BIGINT) says that a key has a
    value n times; values may repeat over rows.  Each wanted rank keeps an
    interval of values with the number of values below it.  A round counts
    the interval's values in ``bins`` equal bins and keeps the bin that holds
    the rank, so an interval shrinks by that factor until one value is left:
    seven rounds at most for 64-bit values.  ``ranks`` names few keys (they
    come from hot_keys()); ranks beyond a key's count are an error.
    """
    ends = {r["key"]: (r["lo"], r["hi"], r["total"]) for r in counts.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total")).collect()}
    spark = counts.sparkSession
    state = {}
    for key, wanted in ranks.items():
        for rank in wanted:
            lo, hi, total = ends[key]
            if not 1 <= rank <= total:
                raise ValueError(f"rank {rank} of key {key}, which has {total} values")
            state[key, rank] = (lo, hi, 0)
    while open_ := {k: s for k, s in state.items() if s[0] < s[1]}:
        spans = sorted({(key, lo, hi) for (key, _), (lo, hi, _) in open_.items()})
        widths = {(key, lo, hi): (hi - lo) // bins + 1 for key, lo, hi in spans}
        want = F.broadcast(spark.createDataFrame([(k, lo, hi, widths[k, lo, hi]) for k, lo, hi in spans], "key bigint, lo bigint, hi bigint, width bigint"))  # one row a wanted rank
        inside = counts.join(want, "key").where(F.col("value").between(F.col("lo"), F.col("hi")))
        at = F.expr("(value - lo) div width")
        hist: dict = {}
        for r in inside.groupBy("key", "lo", "hi", at.alias("bin")).agg(F.sum("n").alias("n")).collect():  # spans x bins rows
            hist.setdefault((r["key"], r["lo"], r["hi"]), []).append((r["bin"], r["n"]))
        for (key, rank), (lo, hi, below) in open_.items():
            width = widths[key, lo, hi]
            for bin_, n in sorted(hist[key, lo, hi]):
                if below + n >= rank:
                    state[key, rank] = (lo + bin_ * width, min(hi, lo + (bin_ + 1) * width - 1), below)
                    break
                below += n
    return {key: [state[key, rank][0] for rank in wanted] for key, wanted in ranks.items()}


def _counted(rows: DataFrame, key: str, value: str, keys: Sequence[int]) -> DataFrame:
    """(key, value, n) of the given keys; spread over tasks by key and value, counted before the shuffle, written once."""
    some = rows.where(F.col(key).isin(list(keys))).groupBy(F.col(key).cast("bigint").alias("key"), F.col(value).cast("bigint").alias("value"))
    return cut(some.agg(F.count("*").alias("n")))


def hot_key_quantiles(rows: DataFrame, key: str, value: str, share: float, quantiles: Sequence[float]) -> DataFrame:
    """(key, quantile, value): the value at rank ceil(q x n), 1 at least, of each key with at least ``share`` of the rows.

    Rows with a null key or value do not count.  No hot key: no rows.
    """
    valid = rows.select(key, value).dropna()
    hot = hot_keys(valid, key, share)
    out = []
    if hot:
        ranks = {k: [max(1, math.ceil(q * n - 1e-9)) for q in quantiles] for k, n in hot}
        got = select_ranks(_counted(valid, key, value, [k for k, _ in hot]), {k: sorted(set(r)) for k, r in ranks.items()})
        out = [(k, q, dict(zip(sorted(set(r)), got[k]))[x]) for k, r in ranks.items() for q, x in zip(quantiles, r)]
    return rows.sparkSession.createDataFrame(out, f"`{key}` bigint, quantile double, `{value}` bigint")


def hot_key_modes(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, value): the most frequent value, the smallest on a tie, of each key with at least ``share`` of the rows.

    Two selections by select_ranks(): over the values' frequencies the last
    rank is the greatest frequency; over the values that have it the first
    rank is the smallest value.  Rows with a null key or value do not count;
    repeated rows count each time.  No hot key: no rows.
    """
    valid = rows.select(key, value).dropna()
    hot = hot_keys(valid, key, share)
    out = []
    if hot:
        counts = _counted(valid, key, value, [k for k, _ in hot])
        freq = counts.select("key", F.col("n").alias("value"), F.lit(1).cast("bigint").alias("n"))
        distinct = {r["key"]: r["d"] for r in counts.groupBy("key").agg(F.count("*").alias("d")).collect()}  # one row a hot key
        top = {k: v[0] for k, v in select_ranks(freq, {k: [n] for k, n in distinct.items()}).items()}
        best = F.broadcast(rows.sparkSession.createDataFrame(list(top.items()), "key bigint, top bigint"))  # one row a hot key
        tied = counts.join(best, "key").where(F.col("n") == F.col("top")).select("key", "value", F.lit(1).cast("bigint").alias("n"))
        out = [(k, v[0]) for k, v in select_ranks(tied, {k: [1] for k in top}).items()]
    return rows.sparkSession.createDataFrame(out, f"`{key}` bigint, `{value}` bigint")
