"""How often every term occurs and in how many records, by last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 12
SALTS = 1 << 10


def combined(rows: DataFrame, term: str, record: str) -> DataFrame:
    """(term BIGINT, record BIGINT, n): repeated rows of a batch as one, before any shuffle; rows with a null are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, r = np.asarray(b.column(0)), np.asarray(b.column(1))
            if not len(t):
                continue
            o = np.lexsort((r, t))
            t, r = t[o], r[o]
            first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (r[1:] != r[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(t[first]), pa.array(r[first]), pa.array(np.diff(np.r_[first, len(t)]))], names=["term", "record", "n"])

    valid = rows.select(F.col(term).cast("bigint").alias("term"), F.col(record).cast("bigint").alias("record")).dropna()
    return valid.mapInArrow(run, "term bigint, record bigint, n bigint")


def last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, occurrences, records) from rows ordered by term and record.

    A term holds three numbers: its occurrences, its records, and the last
    record seen; a row counts as a further record if it differs from that.
    The term that is open at the end of a batch is carried into the next.
    """
    open_: tuple[int, int, int, int] | None = None  # term, occurrences, records, last record
    for b in batches:
        t, r, n = (np.asarray(b.column(i)) for i in range(3))
        if not len(t):
            continue
        new_term = np.r_[open_ is None or t[0] != open_[0], t[1:] != t[:-1]]
        new_record = new_term | np.r_[open_ is None or r[0] != open_[3], r[1:] != r[:-1]]
        starts = np.flatnonzero(new_term)
        if open_ is not None and (not len(starts) or starts[0] > 0):
            end = starts[0] if len(starts) else len(t)
            open_ = (open_[0], open_[1] + int(n[:end].sum()), open_[2] + int(new_record[:end].sum()), int(r[end - 1]))
        if not len(starts):
            continue
        occ, rec = np.add.reduceat(n, starts), np.add.reduceat(new_record.astype(np.int64), starts)
        closed = [t[starts[:-1]], occ[:-1], rec[:-1]]
        if open_ is not None:
            closed = [np.r_[x, c] for x, c in zip(open_[:3], closed)]
        if len(closed[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in closed], names=["term", "occurrences", "records"])
        open_ = (int(t[starts[-1]]), int(occ[-1]), int(rec[-1]), int(r[-1]))
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in open_[:3]], names=["term", "occurrences", "records"])


def heavy_buckets(rows: DataFrame, key: Column, share: float, buckets: int = BUCKETS) -> list[int]:
    """Hash buckets of the key with at least ``share`` of the rows: 1/share at most.  One count, no shuffle of keys."""
    got = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n")).collect()  # `buckets` rows at most
    total = sum(r["n"] for r in got)
    return sorted(r["b"] for r in got if r["n"] >= max(1, share * total))


def frequencies(rows: DataFrame, term: str, record: str, share: float = 1 / 256) -> DataFrame:
    """(term, occurrences, records) of every term over all rows with both values.

    Rows are hashed by term into one shuffle and ordered by record within.
    Terms in heavy hash buckets are spread by record as well (all rows of a
    record stay together, so the counters of the parts add up) and their
    parts are summed; only those few need a second, small shuffle.
    """
    valid = rows.select(term, record).dropna()
    heavy = heavy_buckets(valid, F.col(term).cast("bigint"), share)
    hot = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).isin(heavy)
    schema = "term bigint, occurrences bigint, records bigint"
    one = combined(rows, term, record)
    if not heavy:
        return one.repartition("term").sortWithinPartitions("term", "record").mapInArrow(last_seen, schema)
    part = F.when(hot, F.pmod(F.xxhash64("record"), F.lit(SALTS))).otherwise(F.lit(-1))
    counted = one.withColumn("part", part).repartition("term", "part").sortWithinPartitions("term", "record").select("term", "record", "n").mapInArrow(last_seen, schema)
    # One output row for each term and task; all but the heavy buckets' terms come from a single task.
    summed = counted.where(hot).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return counted.where(~hot).unionByName(summed)


def marked(freq: DataFrame, n_records: int, rare: int = 2, common: int = 20, common_share: float = 0.05) -> DataFrame:
    """``freq`` with mark: 'rare' in at most ``rare`` records, 'common' in more than ``common`` and more than ``common_share`` of all, else null."""
    mark = F.when(F.col("records") <= rare, "rare").when((F.col("records") > common) & (F.col("records") > common_share * n_records), "common")
    return freq.withColumn("mark", mark)


def n_records(rows: DataFrame, term: str, record: str) -> int:
    """The number of different records with any row that counts; one number, counted by the executors."""
    return rows.select(term, record).dropna().select(record).distinct().count()
