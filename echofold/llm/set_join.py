"""All pairs of similar sets, by merging inverted lists for T occurrences."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echofold.llm.frequency import combined
from echofold.operators.shared import cut
from echofold.operators.skew import hot_keys

#: Lists of more records than this are long: they are searched for candidates, not merged.
SHORT = 64
#: Values with this share of the rows are long without being listed at all.
HOT_SHARE = 1 / 1024
#: Rows, and partners in short lists, that a task holds while it gathers what it found by record.
FLUSH, FLUSH_PARTNERS = 1 << 20, 1 << 24


def merge_skip(lists: list[list[int]], t: int) -> list[tuple[int, int]]:
    """(record, occurrences) of the records in at least ``t`` of the ascending lists.

    A heap holds the head of each list.  When the least head occurs fewer
    than t times, t-1 lists are popped and jump, by binary search, to the
    least head that is left: what they skip can't occur t times.
    """
    heads = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heads)
    out = []
    while len(heads) >= t:
        least, same = heads[0][0], []
        while heads and heads[0][0] == least:
            same.append(heapq.heappop(heads))
        if len(same) >= t:
            out.append((least, len(same)))
            for _, i, at in same:
                if at + 1 < len(lists[i]):
                    heapq.heappush(heads, (lists[i][at + 1], i, at + 1))
            continue
        while len(same) < t - 1 and heads:
            same.append(heapq.heappop(heads))
        if not heads:
            break
        to = heads[0][0]
        for _, i, at in same:
            at = bisect_left(lists[i], to, at)
            if at < len(lists[i]):
                heapq.heappush(heads, (lists[i][at], i, at))
    return out


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Members of ``a`` that a binary search finds in ascending ``b``."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


PIECE = "record bigint, n bigint, long array<bigint>, partners array<bigint>, lens array<int>"


def _pieces(short: int):  # noqa: ANN202
    """Rows ordered by value and record -> per record: its number of values, its long ones, and the lists of its short ones.

    Of a short list each record gets the part behind itself, so a pair is met
    once.  Only the open value is carried from batch to batch, and of a long
    list no more than a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = partners = 0
        tail_v, tail_r = np.empty(0, np.int64), np.empty(0, np.int64)
        open_long: int | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, partners
            if rows:
                v, r = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                is_long = np.concatenate([h[2] for h in held])
                yield _gather(v, r, is_long)
            held, rows, partners = [], 0, 0

        for b in batches:
            v, r = np.asarray(b.column(0)), np.asarray(b.column(1))
            v, r = np.r_[tail_v, v], np.r_[tail_r, r]
            if not len(v):
                continue
            keep = np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])]
            v, r = v[keep], r[keep]
            start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            size = np.diff(np.r_[start, len(v)])
            long = size > short
            if open_long is not None and v[0] == open_long:
                long[0] = True
            per_row = np.repeat(long, size)
            # The last value may go on.  If it is long already, its rows can leave but for the last one, kept against repetition.
            last = len(v) - (1 if long[-1] else size[-1])
            open_long = int(v[-1]) if long[-1] else None
            tail_v, tail_r = v[last:], r[last:]
            if last:
                held.append((v[:last], r[:last], per_row[:last]))
                rows += last
                partners += int((size * (size - 1) // 2)[~long].sum())
            if rows >= FLUSH or partners >= FLUSH_PARTNERS:
                yield from flush()
        if len(tail_v):
            held.append((tail_v, tail_r, np.full(len(tail_v), open_long is not None)))
            rows += len(tail_v)
        yield from flush()

    return run


def _gather(v: np.ndarray, r: np.ndarray, is_long: np.ndarray) -> pa.RecordBatch:
    """What rows ordered by value and record say, by record."""
    records, n = np.unique(r, return_counts=True)
    lv, lr = v[is_long], r[is_long]
    o = np.argsort(lr, kind="stable")
    long_n = np.searchsorted(lr[o], records, "right") - np.searchsorted(lr[o], records, "left")
    sv, sr = v[~is_long], r[~is_long]
    if len(sv):
        start = np.flatnonzero(np.r_[True, sv[1:] != sv[:-1]])
        size = np.diff(np.r_[start, len(sv)])
        behind = np.repeat(start + size, size) - np.arange(len(sv)) - 1  # members of the list behind each row
    else:
        behind = np.empty(0, np.int64)
    some = np.flatnonzero(behind > 0)
    some = some[np.argsort(sr[some], kind="stable")]
    lens = behind[some]
    ends = np.cumsum(lens)
    flat = sr[np.repeat(some + 1, lens) + (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens))]
    lists_to = np.searchsorted(sr[some], records, "right")
    flat_to = np.r_[0, ends][lists_to]
    offs = lambda to: pa.array(np.r_[0, to].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(records),
            pa.array(n.astype(np.int64)),
            pa.ListArray.from_arrays(offs(np.cumsum(long_n)), pa.array(lv[o])),
            pa.ListArray.from_arrays(offs(flat_to), pa.array(flat)),
            pa.ListArray.from_arrays(offs(lists_to), pa.array(lens.astype(np.int32))),
        ],
        names=["record", "n", "long", "partners", "lens"],
    )


def _hot_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot values in any order -> long values by record and batch; n stays 0, as repetitions are told only once all are together."""
    for b in batches:
        v, r = np.asarray(b.column(0)), np.asarray(b.column(1))
        if not len(v):
            continue
        o = np.lexsort((v, r))
        records, n = np.unique(r[o], return_counts=True)
        none = pa.ListArray.from_arrays(pa.array(np.zeros(len(records) + 1, np.int32)), pa.array([], pa.int64()))
        empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(records) + 1, np.int32)), pa.array([], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(records), pa.array(np.zeros(len(records), np.int64)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(v[o])), none, empty], names=["record", "n", "long", "partners", "lens"])


def _least_overlap(n: int, threshold: float) -> int:
    """The overlap that any partner of a set of n needs."""
    return max(1, math.ceil(threshold * n - 1e-9))


def _probe(threshold: float):  # noqa: ANN202
    """Per record: merge its short lists for T minus its long values, so that no partner is missed while that is positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hot = b.column("n").to_pylist(), b.column("hot_n").to_pylist()
            out_ids, out_counts, poor = [], [], []
            for i in range(b.num_rows):
                size = n[i] + hot[i]
                t = _least_overlap(size, threshold) - len(b.column("long")[i])
                poor.append(t < 1)
                flat, lists, at = b.column("partners")[i].as_py(), [], 0
                for k in b.column("lens")[i].as_py():
                    lists.append(flat[at : at + k])
                    at += k
                found = merge_skip(lists, max(1, t))
                out_ids.append([x for x, _ in found])
                out_counts.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("record"), pa.array([x + y for x, y in zip(n, hot)], pa.int64()), b.column("long"), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_counts, pa.list_(pa.int64())), pa.array(poor, pa.bool_())],
                names=["record", "n", "long", "partners", "counts", "poor"],
            )

    return run


def _confirm(threshold: float):  # noqa: ANN202
    """Candidates with both long sets -> pairs whose whole overlap suffices; the long lists are searched, not merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            la, lb = b.column("long_a"), b.column("long_b")
            fa, fb, oa, ob = np.asarray(la.flatten()), np.asarray(lb.flatten()), np.asarray(la.offsets), np.asarray(lb.offsets)
            oa, ob = oa - oa[0], ob - ob[0]
            overlap = np.asarray(b.column("shared")) + np.array([in_common(fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]]) for i in range(b.num_rows)], np.int64)
            total = np.asarray(b.column("n_a")) + np.asarray(b.column("n_b"))
            good = overlap * (1 + threshold) >= threshold * total - 1e-9
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good)), b.column("b").filter(pa.array(good)), pa.array(overlap[good]), pa.array(total[good] - overlap[good])], names=["a", "b", "overlap", "union_"])

    return run


def _round(listed: DataFrame, hot: DataFrame | None, threshold: float, short: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, poor records (record, n, long)) of rows (term, record); ``hot`` has those of the hot values.

    Pairs of two poor records without a common short value are still open.
    """
    pieces = listed.repartition("term").sortWithinPartitions("term", "record").select("term", "record").mapInArrow(_pieces(short), PIECE)
    pieces = pieces.withColumn("hot", F.array().cast("array<bigint>"))
    if hot is not None:
        h = hot.select("term", "record").mapInArrow(_hot_pieces, PIECE)
        pieces = pieces.unionByName(h.select("record", "n", F.array().cast("array<bigint>").alias("long"), "partners", "lens", F.col("long").alias("hot")))
    flat = lambda c: F.flatten(F.collect_list(c))
    one = pieces.groupBy("record").agg(F.sum("n").alias("n"), flat("long").alias("long"), F.array_distinct(flat("hot")).alias("hot"), flat("partners").alias("partners"), flat("lens").alias("lens"))
    one = one.select("record", "n", F.size("hot").cast("bigint").alias("hot_n"), F.array_sort(F.concat("long", "hot")).alias("long"), "partners", "lens")
    table = cut(one.mapInArrow(_probe(threshold), "record bigint, n bigint, long array<bigint>, partners array<bigint>, counts array<bigint>, poor boolean"))
    a = table.where(F.size("partners") > 0).select(F.col("record").alias("a"), F.col("n").alias("n_a"), F.col("long").alias("long_a"), F.explode(F.arrays_zip("partners", "counts")).alias("c"))
    a = a.select("a", "n_a", "long_a", F.col("c.partners").alias("b"), F.col("c.counts").alias("shared"))
    # No more can be common than either's long values; most chance meetings end here, before the wide join.
    sizes = table.select(F.col("record").alias("b"), F.col("n").alias("n_b"), F.col("long").alias("long_b"))
    both = a.join(sizes, "b")
    bound = (F.col("shared") + F.least(F.size("long_a"), F.size("long_b"))) * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9
    pairs = both.where(bound).select("a", "b", "shared", "n_a", "n_b", "long_a", "long_b").mapInArrow(_confirm(threshold), "a bigint, b bigint, overlap bigint, union_ bigint")
    return pairs, table.where("poor").select("record", "n", "long")


def _carried_by_long(poor: DataFrame, threshold: float) -> DataFrame:
    """(a, b, overlap, union_) of all records whose common long values alone suffice; ``poor`` (record, n, long) is written already.

    Records of one size and the same long values are one class.  The values
    of a class are ordered by the length of their lists among the classes,
    and the T-1 longest are left out: of T common values one at least is in
    the rest of both sets, as the order is the same for all.  Only what is
    left is joined, and only sets of sizes that can reach the threshold; the
    lists left out are searched when a candidate is confirmed.
    """
    sig = poor.withColumn("class", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.array_join(F.col("long").cast("array<string>"), ",")), 256))
    member = cut(sig.select("class", "record").join(sig.groupBy("class").agg(F.min("record").alias("rep")), "class").select("record", "rep"))
    reps = cut(poor.join(member.where(F.col("record") == F.col("rep")).select("record"), "record", "left_semi"))
    own = reps.select("record", "n", F.explode("long").alias("term"))
    length = own.groupBy("term").agg(F.count("*").alias("length"))
    longest_first = Window.partitionBy("record").orderBy(F.col("length").desc(), F.col("term").desc())
    least = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("n") - 1e-9))
    probe = own.join(length, "term").where(F.col("length") > 1).withColumn("rank", F.row_number().over(longest_first))
    probe = cut(probe.where(F.col("rank") >= least).select("term", "record", "n"))
    x = probe.select("term", F.col("record").alias("a"), F.col("n").alias("n_a"))
    y = probe.select("term", F.col("record").alias("b"), F.col("n").alias("n_b"))
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    met = x.join(y, "term").where(fits).select("a", "b").distinct()
    side = lambda c: reps.select(F.col("record").alias(c), F.col("n").alias(f"n_{c}"), F.col("long").alias(f"long_{c}"))
    both = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.lit(0).cast("bigint").alias("shared"), "n_a", "n_b", "long_a", "long_b")
    good = both.mapInArrow(_confirm(threshold), "a bigint, b bigint, overlap bigint, union_ bigint")
    # A class that reaches the threshold with itself is a pair of its own.
    size = F.size("long").cast("bigint")
    itself = reps.where(size * (1 + threshold) >= threshold * 2 * F.col("n") - 1e-9).select(F.col("record").alias("a"), F.col("record").alias("b"), size.alias("overlap"), (2 * F.col("n") - size).alias("union_"))
    of = lambda c, to: member.select(F.col("rep").alias(c), F.col("record").alias(to))
    all_ = good.unionByName(itself).join(of("a", "x"), "a").join(of("b", "y"), "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return all_.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap", "union_")


def similar_sets(rows: DataFrame, value: str, record: str, threshold: float = 0.5, short: int = SHORT) -> DataFrame:
    """(a, b, overlap, union_) for a < b: the records whose sets of distinct values have at least this Jaccard similarity.

    A partner of a set of n values shares at least T = threshold x n of them.
    Lists of at most ``short`` records are merged with heap skipping for T
    minus the number of the set's long values; candidates are then searched
    in the long lists.  Which values are long decides the cost, never the
    result: a pair that shares no short value consists of two records whose
    long values alone could suffice ("poor"), and these are joined by their
    long values, which are known from the first pass.  Nulls do not count;
    records without values match nothing; repeated rows count once.
    """
    valid = rows.select(F.col(value).cast("bigint").alias("term"), F.col(record).cast("bigint").alias("record")).dropna()
    keys = [k for k, _ in hot_keys(valid.select("term"), "term", HOT_SHARE)]
    # Told apart in the scan: hot values never pass through the lists.
    is_hot = F.col("term").isin(keys)
    listed = combined(valid.where(~is_hot) if keys else valid, "term", "record").select("term", "record")
    pairs, poor = _round(listed, valid.where(is_hot) if keys else None, threshold, short)
    if poor.isEmpty():
        return pairs
    # A pair with a common short value too comes out of both; the larger overlap is the whole one.
    both = pairs.unionByName(_carried_by_long(cut(poor), threshold))
    return both.groupBy("a", "b").agg(F.max("overlap").alias("overlap"), F.min("union_").alias("union_"))
