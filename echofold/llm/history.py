"""New batches against everything accepted before, without going through the history's contents.

The unit is a fingerprint, an array of 32-bit frames.  Two kinds of hashes of
it are kept in bucketed tables: one of the whole content, and some of its
paragraphs.  A paragraph is a frame with its neighbours; as up to 15 percent
of the bits of a copy differ, and more where both are partly silent, its hash
is a selection of few bits of the frame, taken by several selections, beside
which the rest of the frame and some bits of its neighbours are kept.  A batch
meets the history bucket by bucket, and of the contents only candidates.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions import hamming
from echofold.operators.shared import cut, shared_dir
from echofold.schema import MAX_OFFSET, SIMILARITY_THRESHOLD

#: Frames in more than this share of the contents (and more than HOT_LEAST) say nothing, as silence does.
#: At most frames-per-content / HOT_SHARE frames are that frequent.
HOT_SHARE, HOT_LEAST = 1 / 200, 64
#: A frame within so many bits of a frequent one counts as it does, unless frequent frames are so many that this would take in more than NEAR_SHARE of all.
NEAR_BITS, NEAR_SHARE = 5, 1 / 64
#: Bits of a paragraph's hash for up to 2^LEAST_CONTENTS contents; one more for each doubling, so that buckets keep their size.
LEAST_BITS, LEAST_CONTENTS = 10, 17
#: Share of the bits of telling frames that may differ, and the meetings in one alignment that two contents are then to have.
FLIPPED, MEETINGS = 0.2, 6
#: Contents with fewer telling frames than this, or with overlaps so short, are compared with all others in full.
TELLING = 8
#: Neighbours on each side that stand beside a hash, and how many bits of each.
AROUND, BITS_EACH = 5, 4
#: Share of the known bits of two paragraphs that may differ, and the share at which one paragraph alone makes a candidate.
TOLERANCE, STRICT = 0.25, 0.18
#: Groups of hashes in a store, at least; else four for each bucket, which evens them out.
LEAST_GROUPS = 256
#: Entries of a group that one task holds; larger ones are split.
SPLIT = 1 << 22
#: Entries that a task gathers before it hands them on.
FLUSH = 1 << 20
#: Standard deviations by which unrelated bits may agree better than by half.
CHANCE_SD = 4.5
#: Contents on each side of a block that is compared in full.
BLOCK = 2048
#: Contents that are compared by their frequent frames at once: silent ones, which are few, and any others. Large blocks, as each side is sent to all blocks of the other.
SILENT, OTHERS = 1 << 15, 1 << 16
#: Groups of a content's frequent frames up to which bitmaps tell who has one of them, and the bitmaps read for a group.
GROUPS, ROWS = 8, 8
#: Kinds of frequent frames, the rest being one, of which two agree by ALIKE at most; and what may be of any kind.
KINDS, ALIKE, ANY = 8, 0.75, 128


def key_bits(n: int) -> int:
    """Bits of a hash for ``n`` contents."""
    return LEAST_BITS + max(0, math.ceil(math.log2(max(1, n))) - LEAST_CONTENTS)


def hashes_each(bits: int) -> int:
    """Hashes of a content of the usual length: what MEETINGS takes if each meets with the chance that all its bits are equal."""
    return math.ceil(MEETINGS / (1 - FLIPPED) ** bits)


def selections(n: int, bits: int) -> list[list[int]]:
    """``n`` selections of bits, the same on every machine and at every time."""
    rng = random.Random(20)
    return [sorted(rng.sample(range(32), bits)) for _ in range(n)]


#: Bits of a neighbour at each distance that stand beside a hash.
NEIGHBOURS = [(d, sorted(random.Random(40 + d).sample(range(32), BITS_EACH))) for d in range(-AROUND, AROUND + 1) if d]


def hot_frames(c: DataFrame, n: int | None = None) -> list[int]:
    """Frames of very many of the contents ``c``, of which there are ``n``, most frequent first; a bounded list (see HOT_SHARE)."""
    n = c.count() if n is None else n
    frames = c.select(F.explode(F.array_distinct("fingerprint")).alias("x")).dropna().groupBy("x").agg(F.count("*").alias("n"))
    many = frames.where(F.col("n") > max(HOT_LEAST, int(n * HOT_SHARE))).collect()
    return [r["x"] for r in sorted(many, key=lambda r: (-r["n"], r["x"]))]


def _near_bits(hot: list[int]) -> int:
    """Bits by which a frame may differ from a frequent one and still count as it does."""
    ball = lambda r: sum(math.comb(32, i) for i in range(r + 1)) / 2**32
    return max((r for r in range(NEAR_BITS + 1) if len(hot) * ball(r) <= NEAR_SHARE), default=0)


def silence(frames: np.ndarray, hot: list[int]) -> np.ndarray:
    """A byte for each frame: 0 if it is telling, else the number of the frequent frame that it is, from 1, or 127 if that is none of the first; 128 more if it is only nearly so."""
    r = _near_bits(hot)
    distinct, at = np.unique(frames, return_inverse=True)
    best, which = np.full(len(distinct), 33, np.uint8), np.zeros(len(distinct), np.uint8)
    for k, x in enumerate(hot):
        d = np.bitwise_count(distinct ^ np.uint32(x & 0xFFFFFFFF))
        nearer = (d <= r) & (d < best)
        best[nearer], which[nearer] = d[nearer], min(k + 1, 127)
    which[(which > 0) & (best > 0)] += 128
    return which[at]


def agreements(hot: list[int]) -> np.ndarray:
    """The share of bits in which frames of two values of silence() may agree at most; 0 if one is telling."""
    value = np.array([x & 0xFFFFFFFF for x in hot[:126]] or [0], np.uint32)
    out = np.zeros((256, 256), np.float32)
    kinds = [c for c in range(1, 256) if c % 128]
    for a in kinds:
        for b in kinds:
            x, y = a % 128 - 1, b % 128 - 1
            if max(x, y) >= min(len(hot), 126):
                out[a, b] = 1
            else:
                apart = int(np.bitwise_count(value[x] ^ value[y])) - _near_bits(hot) * (a // 128 + b // 128)
                out[a, b] = 1 - max(0, apart) / 32
    return out


def _bits(x: np.ndarray, which: list[int]) -> np.ndarray:
    """The given bits of each number, as a smaller number."""
    out = np.zeros(len(x), np.uint64)
    for to, b in enumerate(which):
        out |= ((x >> np.uint32(b)) & np.uint32(1)).astype(np.uint64) << np.uint64(to)
    return out


def paragraphs(frames: np.ndarray, start: np.ndarray, n: np.ndarray, numbers: np.ndarray, hot: list[int], bits: int) -> tuple[np.ndarray, ...]:
    """(key, number, position, word, known) of the paragraphs of some contents.

    ``word`` has the bits of the frame that the key lacks, then those of the
    neighbours; ``known`` has a bit for each neighbour that is there and
    telling.  Contents of fewer telling frames have more hashes of each, up to
    those of TELLING frames.
    """
    owner = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(frames)) - start[owner]
    telling = silence(frames, hot) == 0
    count = np.bincount(owner[telling], minlength=len(n))
    wanted = hashes_each(bits)
    each = -(-wanted // np.maximum(count, TELLING))
    around, known = np.zeros(len(frames), np.uint64), np.zeros(len(frames), np.int32)
    for j, (d, which) in enumerate(NEIGHBOURS):
        some = np.flatnonzero((pos + d >= 0) & (pos + d < n[owner]))
        some = some[telling[some + d]]
        around[some] |= _bits(frames[some + d], which) << np.uint64(j * BITS_EACH)
        known[some] |= 1 << j
    out = []
    for k, which in enumerate(selections(int(each.max(initial=0)), bits)):
        i = np.flatnonzero(telling & (each[owner] > k))
        key = _bits(frames[i], which).astype(np.int64) | (k << bits)
        rest = [b for b in range(32) if b not in which]
        word = _bits(frames[i], rest) | (around[i] << np.uint64(len(rest)))
        out.append((key, numbers[owner[i]], pos[i].astype(np.int32), word.view(np.int64), known[i]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64, np.int32))
    return tuple(np.concatenate(x) for x in zip(*out))


def _spread_bits(word: np.ndarray, known: np.ndarray, rest: int) -> np.ndarray:
    """A row of +1 and -1 for each paragraph, 0 where a neighbour is not known."""
    w = np.unpackbits(word.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : rest + len(NEIGHBOURS) * BITS_EACH]
    m = w.astype(np.float32) * 2 - 1
    m[:, rest:] *= np.repeat((known[:, None] >> np.arange(len(NEIGHBOURS))) & 1, BITS_EACH, axis=1)
    return m


def meetings(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], bits: int, once: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(a, b, shift, least and greatest position in b, strict) of alignments in which paragraphs of equal key are alike.

    Both sides are paragraphs(); ``once`` marks left ones whose contents are
    on the right too: of these each pair is met once.
    """
    rest = 32 - bits
    left, right = (tuple(x[np.argsort(side[0], kind="stable")] for x in (*side, *extra)) for side, extra in ((left, () if once is None else (once,)), (right, ())))
    keys, begin = np.unique(right[0], return_index=True)
    end = np.r_[begin[1:], len(right[0])]
    l0, l1 = np.searchsorted(left[0], keys, "left"), np.searchsorted(left[0], keys, "right")
    found: list[tuple[np.ndarray, ...]] = []
    for r0, r1, a0, a1 in zip(begin, end, l0, l1):
        if a0 == a1:
            continue
        for rs in range(r0, r1, 1 << 11):
            re_ = min(r1, rs + (1 << 11))
            mr = _spread_bits(right[3][rs:re_], right[4][rs:re_], rest)
            all_ = np.abs(mr).sum(1)
            least, strict = all_ * (1 - 2 * TOLERANCE), all_ * (1 - 2 * STRICT)
            for ls in range(a0, a1, 1 << 9):
                le = min(a1, ls + (1 << 9))
                dot = _spread_bits(left[3][ls:le], left[4][ls:le], rest) @ mr.T
                i, j = np.divmod(np.flatnonzero(dot >= least), re_ - rs)  # nonzero() of two dimensions takes several times as long
                if not len(i):
                    continue
                score, x, y = dot[i, j] >= strict[j], i + ls, j + rs
                a, b, shift = left[1][x], right[1][y], left[2][x] - right[2][y]
                ok = (np.abs(shift) <= MAX_OFFSET) & (a != b)
                if once is not None:
                    ok &= ~left[5][x] | (a < b)
                found.append((a[ok], b[ok], shift[ok], right[2][y][ok], score[ok]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32, bool))
    a, b, shift, q, s = (np.concatenate(x) for x in zip(*found))
    o = np.lexsort((q, shift, b, a))
    a, b, shift, q, s = (x[o] for x in (a, b, shift, q, s))
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (shift[1:] != shift[:-1])]) if len(a) else np.zeros(0, int)
    if not len(first):
        return a, b, shift.astype(np.int32), q, q, s
    last = np.r_[first[1:], len(a)] - 1
    return a[first], b[first], shift[first].astype(np.int32), q[first], q[last], np.logical_or.reduceat(s, first)


def least_hot(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many frequent frames an overlap of n must have in common for it to reach the threshold though its other frames are unrelated.

    Unrelated bits agree by half, and over 32 r of them by CHANCE_SD standard
    deviations more at most; frequent frames are taken to agree in full.
    """
    c = CHANCE_SD / (2 * np.sqrt(32 * np.maximum(n, 1)))
    rest = (c + np.sqrt(c * c + 2 * (1 - threshold))) ** 2
    return np.maximum(1.0, n * (1 - rest) - 1e-6)


def hot_masks(c: DataFrame, hot: list[int], threshold: float) -> DataFrame:
    """(number, mask, kind) of ``c``; ``mask`` is silence() of its frames.

    An overlap always holds the end of one of its contents.  Kind 1: frequent
    frames may carry a match in an overlap that ends with this content.  Kind
    2: too few telling frames for hashes, in all or in a short overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frames, start, n = hamming._ragged(b.column(1))
            quiet = silence(frames, hot)
            is_hot = quiet > 0
            upto = np.r_[0, np.cumsum(is_hot)]
            kind = np.zeros(len(n), np.int32)
            for left_out in range(MAX_OFFSET + 1):
                m = np.maximum(n - left_out, 0)
                kind[(m > 0) & (upto[start + n] - upto[start + n - m] >= least_hot(m, threshold))] = 1
            telling = n - (upto[start + n] - upto[start])
            kind[(n > 0) & ((telling < TELLING) | (n < MAX_OFFSET + TELLING))] = 2
            masks = [quiet[s : s + k].tobytes() for s, k in zip(start, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(masks, pa.binary()), pa.array(kind)], names=["number", "mask", "kind"])

    return c.select("number", "fingerprint").mapInArrow(run, "number bigint, mask binary, kind int")


def _tiles(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` rows ordered by length, fewer if they are long."""
    lo = 0
    while lo < len(n):
        hi = min(lo + most, len(n))
        hi = max(lo + 1, min(hi, lo + (1 << 24) // max(1, int(n[lo:hi].max()))))
        yield lo, hi
        lo = hi


def _kinds(many: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """A kind for each value of silence(), of which there are so ``many``: 0 if telling, ANY if nearly frequent only; frames of two others agree by ALIKE at most."""
    out = np.full(256, ANY, np.uint8)
    out[0] = 0
    values = [v for v in np.argsort(-many, kind="stable") if 0 < v < 127 and many[v]]
    k, left = 0, set(values)
    for first in values:
        if first not in left:
            continue
        k, reached = min(k + 1, KINDS), [first]
        left.discard(first)
        for v in reached:
            out[v] = k
            more = [w for w in left if agree[v, w] > ALIKE]
            reached += more
            left.difference_update(more)
    return out


def _silent(ends: pa.Table, others: pa.Table, threshold: float, agree: np.ndarray) -> pa.Table:
    """(a, b, shift) of the alignments that end with the end of a, of ``ends``, in which frequent frames may carry a match with b; ``agree`` as of agreements().

    Where a's frequent frames are just enough, few of them may meet others in
    b.  If they are parted into one group more than that, b has all of one
    group: those contents come from bitmaps, one for each position and kind
    of frame, and only they are counted and compared.
    """

    def side(t: pa.Table) -> tuple:
        masks = t.column("mask").to_pylist()
        n = np.array([len(m) for m in masks], np.int64)
        o = np.argsort(n, kind="stable")
        flat = np.frombuffer(b"".join(masks[i] for i in o), np.uint8)
        return np.asarray(t.column("number"))[o], n[o], np.cumsum(n[o]) - n[o], flat

    def checked(*rows: np.ndarray) -> None:
        at_once = max(1, FLUSH // int(n_a[rows[0]].max(initial=1)))
        for lo in range(0, len(rows[0]), at_once):
            compared(*(x[lo : lo + at_once] for x in rows))

    def compared(i: np.ndarray, j: np.ndarray, ka: np.ndarray, kb: np.ndarray) -> None:
        # They are not all the same frame: how far can these agree, and what would the rest have to be?
        n = n_a[i] - ka
        last = np.cumsum(n)
        within = np.arange(last[-1]) - np.repeat(last - n, n)
        both = agree[f_a[np.repeat(s_a[i] + ka, n) + within], f_b[np.repeat(s_b[j] + kb, n) + within]]
        rest = n - np.add.reduceat((both > 0).astype(np.int64), last - n)
        ok = np.add.reduceat(both.astype(np.float64), last - n) + rest / 2 + CHANCE_SD / 2 * np.sqrt(rest / 32) >= threshold * n - 1e-6
        ok &= num_a[i] != num_b[j]
        found.append((num_a[i[ok]], num_b[j[ok]], (ka - kb)[ok].astype(np.int32)))

    @functools.cache
    def spare(h: int, n: int) -> int:
        """How many of a's h frequent frames in n may meet a frame of another kind, which at most agrees by ALIKE, or a telling one."""
        lacks = np.arange(h + 1)
        enough = h + (n - h) / 2 - lacks * (1 - ALIKE) + CHANCE_SD / 2 * np.sqrt((n - h + lacks) / 32) >= threshold * n - 1e-6
        most = int(np.flatnonzero(enough).max(initial=-1))
        return most if most < min(GROUPS, h) else GROUPS

    (num_a, n_a, s_a, f_a), (num_b, n_b, s_b, f_b), found = side(ends), side(others), []
    kinds = _kinds(np.bincount(f_b, minlength=256), agree)
    need = least_hot(np.arange(int(n_a.max(initial=0)) + 1), threshold)
    for b0, b1 in _tiles(n_b, 1 << 16):
        length = n_b[b0:b1]
        kinds_b = np.zeros((-(-len(length) // 64) * 64, -(-int(length[-1]) // 64) * 64), np.uint8)
        for row, s, k in zip(kinds_b, s_b[b0:b1], length):
            row[:k] = kinds[f_b[s : s + k]]
        quiet = kinds_b > 0
        kind_of = lambda k, x=kinds_b.T: (x == k) | (x == ANY) if k else x > 0
        of_row = np.packbits(quiet, axis=1, bitorder="little").view(np.uint64)
        at_pos = np.concatenate([np.packbits(np.ascontiguousarray(kind_of(k)), axis=1, bitorder="little").view(np.uint64) for k in range(KINDS + 1)])
        many = np.bitwise_count(at_pos).sum(1, dtype=np.int64)
        held, size = [], 0
        for i, (s, n) in enumerate(zip(s_a, n_a)):
            hot = np.flatnonzero(f_a[s : s + n])
            row_of = kinds[f_a[s : s + n]].astype(np.int64) % ANY * quiet.shape[1]
            ways, groups, group_of = [], [], []
            first = np.searchsorted(hot, np.arange(min(MAX_OFFSET + 1, n)))
            for ka in np.flatnonzero(len(hot) - first >= need[n - np.arange(len(first))]):
                at = hot[first[ka] :] - ka
                lacks = spare(len(at), int(n - ka))
                # Of the contents in order of length, those that reach to the end of a.
                los = np.searchsorted(length, n - ka + np.arange(1 if ka else MAX_OFFSET + 1))
                los = los[los < len(length)]
                if lacks < 0 or not len(los):
                    continue
                if lacks < GROUPS:
                    by_many = row_of[at + ka] + at
                    by_many = by_many[np.argsort(many[by_many], kind="stable")]
                    g = np.arange(lacks + 1)[:, None]
                    rows = by_many[g + (lacks + 1) * (np.arange(ROWS) % -(-(len(at) - g) // (lacks + 1)))]
                    groups.append((rows + np.arange(len(los))[:, None, None]).reshape(-1, ROWS))
                    group_of.append(np.repeat(len(ways) + np.arange(len(los)), lacks + 1))
                ways += [(ka, kb, lo, lacks, at) for kb, lo in enumerate(los)]
            if not ways:
                continue
            ka, kb, lo, lacks = (np.array(x) for x in list(zip(*ways))[:4])
            mine = np.zeros((len(ways), quiet.shape[1]), bool)
            for row, (_, k, _, _, at) in zip(mine, ways):
                row[at + k] = True
            mine = np.packbits(mine, axis=1, bitorder="little").view(np.uint64)
            way, j = [], []
            for v in np.flatnonzero(lacks >= GROUPS):
                within = -(-(n + MAX_OFFSET) // 64)
                shared = np.bitwise_count(of_row[lo[v] :, :within] & mine[v, :within]).sum(1, dtype=np.uint16)
                j.append(np.flatnonzero(shared >= need[n - ka[v]]) + lo[v])
                way.append(np.full(len(j[-1]), v))
            if groups:
                rows, w = np.concatenate(groups), int(lo.min()) // 64
                some = at_pos[rows[:, 0], w:]
                for r in range(1, 3):
                    some &= at_pos[rows[:, r], w:]
                where = np.flatnonzero(some)
                (g, word), some = np.divmod(where, some.shape[1]), some.ravel()[where]
                for r in range(3, ROWS):
                    some &= at_pos[rows[g, r], word + w]
                    g, word, some = g[some > 0], word[some > 0], some[some > 0]
                of, bit = np.divmod(np.flatnonzero(np.unpackbits(some.view(np.uint8), bitorder="little")), 64)
                both = np.unique(np.concatenate(group_of)[g[of]] * quiet.shape[0] + (word[of] + w) * 64 + bit)
                way.append(both // quiet.shape[0])
                j.append(both % quiet.shape[0])
            way, j = np.concatenate(way), np.concatenate(j)
            ok = (j >= lo[way]) & (j < len(length))
            way, j = way[ok], j[ok]
            ok = np.bitwise_count(mine[way] & of_row[j]).sum(1, dtype=np.int64) >= need[n - ka[way]]
            way, j = way[ok], j[ok]
            held.append((np.full(len(j), i), j + b0, ka[way], kb[way]))
            size += len(j) * int(n)
            if size >= FLUSH:
                checked(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            checked(*(np.concatenate(x) for x in zip(*held)))
    cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)]
    return pa.table([pa.array(x) for x in cols], names=["a", "b", "shift"])


def _all_shifts(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """(a, b) of all pairs of two tables (number, fingerprint) that reach the threshold at some shift."""

    def side(t: pa.Table) -> tuple:
        frames, start, n = hamming._ragged(t.column("fingerprint"))
        o = np.argsort(n, kind="stable")
        return np.asarray(t.column("number"))[o], n[o], start[o], frames

    def wide(frames: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros((len(n), 32 * int(n.max(initial=0))), np.float32)
        for row, s, k in zip(out, start, n):
            row[: 32 * k] = np.unpackbits(frames[s : s + k].view(np.uint8)) * np.float32(2) - 1
        return out

    (num_a, n_a, s_a, f_a), (num_b, n_b, s_b, f_b), found = side(left), side(right), []
    for a0, a1 in _tiles(32 * n_a, 512):
        wa = wide(f_a, s_a[a0:a1], n_a[a0:a1])
        for b0, b1 in _tiles(32 * n_b, 512):
            wb, good = wide(f_b, s_b[b0:b1], n_b[b0:b1]), np.zeros((a1 - a0, b1 - b0), bool)
            for k in range(-MAX_OFFSET, MAX_OFFSET + 1):
                ka, kb = max(k, 0), max(-k, 0)
                w = min(wa.shape[1] - 32 * ka, wb.shape[1] - 32 * kb)
                if w <= 0:
                    continue
                n = 32.0 * np.minimum((n_a[a0:a1] - ka)[:, None], n_b[b0:b1] - kb)
                dot = wa[:, 32 * ka : 32 * ka + w] @ wb[:, 32 * kb : 32 * kb + w].T
                good |= (n > 0) & (1.0 - (n - dot) / 2 / np.maximum(n, 1) >= threshold)
            i, j = np.nonzero(good & (num_a[a0:a1, None] != num_b[b0:b1]))
            found.append((num_a[a0 + i], num_b[b0 + j]))
    cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2
    return pa.table([pa.array(x) for x in cols], names=["a", "b"])


def _in_blocks(left: DataFrame, right: DataFrame, compare, schema: str, most: tuple[int, int] = (BLOCK, BLOCK)) -> DataFrame:  # noqa: ANN001
    """``compare`` of all blocks of both sides; ``most`` rows a side, fewer of the left one if there would be few blocks."""
    n_l, n_r = left.count(), right.count()
    if not n_l or not n_r:
        return left.sparkSession.createDataFrame([], schema)
    g_l, g_r = max(-(-n_l // most[0]), min(8, -(-n_l // BLOCK))), -(-n_r // most[1])
    block = lambda g: F.pmod(F.xxhash64("number"), F.lit(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    x = left.select("*", block(g_l).alias("i"), every(g_r).alias("j"))
    names = right.columns  # the sides may be of one table
    y = right.select(*[F.col(c).alias(f"{c}_") for c in names], every(g_l).alias("i"), block(g_r).alias("j"))
    # Few bytes, much to do: the partitions must not be put together by their sizes.
    x, y = (t.repartition(min(2 * g_l * g_r, 4096), "i", "j").groupBy("i", "j") for t in (x, y))
    return x.cogroup(y).applyInArrow(lambda a, b: compare(a, b.select([f"{c}_" for c in names]).rename_columns(names)), schema)


def _at_shift(threshold: float):  # noqa: ANN202
    """Candidates (a, b, shift, fa, fb) -> those that reach the threshold at that shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, shift = hamming._ragged(batch.column("fa")), hamming._ragged(batch.column("fb")), np.asarray(batch.column("shift"))
            good = np.zeros(len(shift), bool)
            for k in np.unique(shift):
                rows = np.flatnonzero(shift == k)
                good[rows] = (hamming._at(a, b, rows, int(k)) if k >= 0 else hamming._at(b, a, rows, int(-k))) >= threshold
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


class HashStore:
    """What has been accepted, as bucketed tables to which each batch appends its hashes.

    | Table | One row for | Bucketed by |
    | --- | --- | --- |
    | hashes | a content: hash of the whole, number | hash |
    | paragraphs | some paragraphs of one group, as arrays | group |
    | contents | a content: number, fingerprint, its first and last batch | number |
    | masks | a content: where it is silent | - |
    | members | a file: number of its content, id, batch | number |

    ``root`` is a folder that driver and executors share; opened again, it
    holds what was appended before.  A part is one or more batches appended
    together; appending a part again, as after a failure, replaces it.
    match() reads the hashes of the history and joins them to those of the
    new part within buckets, without moving them, and reads the contents of
    candidates only.

    Frequent frames and the length of hashes are fixed by the first part that
    is not empty.  They decide the cost, not the result: a frame that becomes
    frequent later is hashed and compared like any other.  ``capacity`` is
    the number of contents to plan for, if it will be much larger than that
    part; ``buckets`` the number of files of a part, by default that of
    shuffle partitions.  Both are kept with the store.
    """

    TABLES = {
        "hashes": ("hash binary, number bigint, first int, last int", "hash"),
        "paragraphs": ("bucket int, key array<int>, number array<bigint>, pos array<int>, word array<bigint>, known array<smallint>", "bucket"),
        "contents": ("number bigint, fingerprint array<int>", "number"),
        "masks": ("number bigint, mask binary, kind int", None),
        "members": ("number bigint, id bigint, batch int", "number"),
    }

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, capacity: int = 0, threshold: float = SIMILARITY_THRESHOLD) -> None:
        self.spark, self.root, self.capacity, self.threshold = spark, root.rstrip("/"), capacity, threshold
        if not self._has("layout"):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(n).alias("buckets"), F.lit(max(LEAST_GROUPS, 4 * n)).alias("groups")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/layout")
        buckets, self.groups = self.spark.read.schema("buckets int, groups int").parquet(f"{self.root}/layout").first()
        self.buckets = buckets
        self.prefix = f"echofold_{hashlib.blake2b(self.root.encode(), digest_size=8).hexdigest()}"
        for name, (columns, by) in self.TABLES.items():
            clustered = f"CLUSTERED BY ({by}) INTO {buckets} BUCKETS" if by else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.prefix}_{name} ({columns}, part int) USING parquet PARTITIONED BY (part) {clustered} LOCATION '{self.root}/{name}'")
            if self._has(name):
                spark.sql(f"ALTER TABLE {self.prefix}_{name} RECOVER PARTITIONS")

    def _has(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}")

    def _insert(self, name: str, rows: DataFrame, part: int, placed: bool = False) -> None:
        """Replace a part of a table; ``placed`` says that the rows lie in its buckets already."""
        columns, by = self.TABLES[name]
        view = f"{self.prefix}_new"
        (rows.repartition(self.buckets, by) if by and not placed else rows).createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.prefix}_{name} PARTITION (part = {part}) SELECT {', '.join(c.split()[0] for c in columns.split(', '))} FROM {view}")
        self.spark.catalog.dropTempView(view)

    def close(self) -> None:
        """Forget the tables; the files stay."""
        for name in self.TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")

    def hot(self) -> list[int]:
        return self.settings()[1]

    def settings(self) -> tuple[int, list[int]]:
        """(bits of a hash, frequent frames)."""
        if not self._has("settings"):
            return key_bits(self.capacity), []
        r = self.spark.read.schema("bits int, hot array<int>").parquet(f"{self.root}/settings").first()
        return r["bits"], list(r["hot"])

    def append(self, files: DataFrame, part: int) -> None:
        """Add rows (id, batch, fingerprint) as part number ``part``, which is also the batch if they name none.

        Files of equal content are one content, named by its least id.  Null
        and empty fingerprints and rows without id or batch are left out.  Of
        several rows with one id that of the highest batch counts, then that
        of the greatest content hash.  Ids must not come again in another part.
        """
        some = F.size(F.coalesce("fingerprint", F.array().cast("array<int>"))) > 0
        files = files if "batch" in files.columns else files.withColumn("batch", F.lit(part))
        f = files.where(some).select(F.col("id").cast("bigint").alias("id"), F.col("batch").cast("int").alias("batch"), "fingerprint").dropna(subset=["id", "batch"])
        f = cut(f.withColumn("hash", F.unhex(F.sha2(F.array_join(F.col("fingerprint").cast("array<string>"), ",", "-"), 256))))
        one = cut(f.groupBy("id").agg(F.max(F.struct("batch", "hash")).alias("r")).select("id", "r.batch", "r.hash"))
        # The fingerprints travel once, to the bucket of their number.
        self._insert("hashes", one.groupBy("hash").agg(F.min("id").alias("number"), F.min("batch").alias("first"), F.max("batch").alias("last")), part)
        h = self.table("hashes").where(F.col("part") == part)
        c = f.select(F.col("id").alias("number"), "hash", "fingerprint").repartition(self.buckets, "number")
        c = c.join(h.select("number", F.col("hash").alias("own")).hint("merge"), "number").where(F.col("hash") == F.col("own"))
        self._insert("contents", c.dropDuplicates(["number"]), part, placed=True)
        self._insert("members", one.join(h.select("hash", "number").hint("merge"), "hash"), part)
        c = self.table("contents").where(F.col("part") == part)
        if not self._has("settings") and (n := h.count()):
            row = [(key_bits(max(n, self.capacity)), hot_frames(c, n))]
            self.spark.createDataFrame(row, "bits int, hot array<int>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/settings")
        bits, hot = self.settings()
        self._insert("masks", hot_masks(c, hot, self.threshold), part)
        self._insert("paragraphs", _packed(c, hot, bits, self.groups), part)

    def match(self, part: int) -> DataFrame:
        """(id_a, id_b), id_a < id_b: files of the part ``part`` and those of lower batches, here or in earlier parts, of the same or nearly the same content."""
        upto = lambda name: self.table(name).where(F.col("part") <= part)
        new = lambda name: self.table(name).where(F.col("part") == part)
        ends = lambda c, to: c.select("hash", F.col("number").alias(to))
        # No join may turn into a broadcast: the sizes that the planner knows are those of compressed files.
        # Full copies: whole hashes, within buckets.
        copies = ends(self.table("hashes").where(F.col("part") < part), "a").join(ends(new("hashes"), "b").hint("merge"), "hash").select("a", "b")
        copies = copies.unionByName(new("hashes").where(F.col("first") < F.col("last")).select(F.col("number").alias("a"), F.col("number").alias("b")))
        # Shared paragraphs, within buckets; two in one alignment, or one that is very much alike, make a candidate.
        bits, _ = self.settings()
        met = _met(upto("paragraphs").withColumn("fresh", F.col("part") == part), new("paragraphs"), bits)
        met = met.groupBy("a", "b", "shift").agg(F.min("q0").alias("q0"), F.max("q1").alias("q1"), F.max("strict").alias("strict"))
        candidates = met.where((F.col("q0") < F.col("q1")) | F.col("strict")).select("a", "b", "shift")
        # What silence may carry, and what has too little else.
        near, full = self._carried(upto, new)
        candidates = cut(candidates.unionByName(near).distinct())
        contents = upto("contents").select("number", "fingerprint")
        side = lambda c: contents.withColumnsRenamed({"number": c, "fingerprint": f"f{c}"})
        good = candidates.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").mapInArrow(_at_shift(self.threshold), "a bigint, b bigint")
        pairs = copies.unionByName(good).unionByName(full).distinct()
        x = upto("members").select(F.col("number").alias("a"), F.col("id").alias("x"), F.col("batch").alias("bx"))
        y = new("members").select(F.col("number").alias("b"), F.col("id").alias("y"), F.col("batch").alias("by"))
        out = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(F.col("bx") != F.col("by"))
        return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def _carried(self, upto, new) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
        """((a, b, shift) that frequent frames may carry, (a, b) of contents that are compared with all others), exact."""
        old, fresh = upto("masks").drop("part"), new("masks").drop("part")
        silent = lambda x, y: _in_blocks(x, y, lambda a, b, t=self.threshold, g=agreements(self.hot()): _silent(a, b, t, g), "a bigint, b bigint, shift int", (SILENT, OTHERS))
        tight = F.col("kind") == 1
        # An alignment ends with one of its contents, of kind 1: an earlier one, or a new one.
        near = silent(old.where(tight), fresh).unionByName(silent(fresh.where(tight), old).select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("shift")).alias("shift")))
        few = F.col("kind") == 2
        if upto("masks").where(few).isEmpty():
            return near, self.spark.createDataFrame([], "a bigint, b bigint")
        whole = lambda m, c: c.select("number", "fingerprint").join(m.select("number").hint("merge"), "number", "left_semi")
        compare = lambda x, y: _in_blocks(x, y, lambda a, b, t=self.threshold: _all_shifts(a, b, t), "a bigint, b bigint")
        full = compare(whole(old.where(few), upto("contents")), new("contents").select("number", "fingerprint"))
        full = full.unionByName(compare(whole(upto("masks").where(~few), upto("contents")), whole(fresh.where(few), new("contents"))))
        return near, full


def _packed(c: DataFrame, hot: list[int], bits: int, groups: int) -> DataFrame:
    """The paragraphs of contents (number, fingerprint), packed by group: a row holds those that one task made of one group."""

    def pack(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, number, pos, word, known = (np.concatenate(x) for x in zip(*parts))
        group = ((key * 0x9E3779B1 & 0xFFFFFFFF) >> 7) % groups
        o = np.lexsort((key, group))
        at = np.searchsorted(group[o], np.arange(groups + 1))
        some = np.flatnonzero(np.diff(at))
        offsets = pa.array(np.r_[at[some], at[-1]].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[o].astype(t))) for x, t in ((key, np.int32), (number, np.int64), (pos, np.int32), (word, np.int64), (known, np.int16))]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *lists], names=["bucket", "key", "number", "pos", "word", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            frames, start, n = hamming._ragged(b.column(1))
            numbers, lo = np.asarray(b.column(0)), 0
            # A piece of the batch at a time, so that long contents don't fill the memory.
            ends = np.cumsum(n)
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FLUSH // 4, "right")))
                a, z = start[lo], ends[hi - 1]
                held.append(paragraphs(frames[a:z], start[lo:hi] - a, n[lo:hi], numbers[lo:hi], hot, bits))
                rows, lo = rows + len(held[-1][0]), hi
                if rows >= FLUSH:
                    yield pack(held)
                    held, rows = [], 0
        if held:
            yield pack(held)

    return c.select("number", "fingerprint").mapInArrow(run, "bucket int, key array<int>, number array<bigint>, pos array<int>, word array<bigint>, known array<smallint>")


def _met(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    """(a, b, shift, q0, q1, strict) of the meetings of packed paragraphs, group by group; ``left`` has fresh, which marks those of ``right``.

    Groups are met where they lie.  Of groups of more than SPLIT entries, as
    a large family of near copies makes, the rows are spread over several
    tasks on both sides.
    """

    def flat(t: pa.Table) -> tuple[np.ndarray, ...]:
        return tuple(np.asarray(t.column(c).combine_chunks().flatten()) for c in ("key", "number", "pos", "word", "known"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        fresh = np.repeat(np.asarray(x.column("fresh")), np.asarray(x.column("key").combine_chunks().value_lengths())) if len(x) else np.zeros(0, bool)
        got = meetings(flat(x), flat(y), bits, fresh) if len(x) and len(y) else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32, bool))
        return pa.table([pa.array(c) for c in got], names=["a", "b", "shift", "q0", "q1", "strict"])

    schema = "a bigint, b bigint, shift int, q0 int, q1 int, strict boolean"
    sized = left.groupBy("bucket").agg(F.sum(F.size("key")).alias("n"), F.sum(F.when(F.col("fresh"), F.size("key"))).alias("m")).where(F.col("n") > SPLIT).collect()  # as many rows as groups at most
    big = F.col("bucket").isin([r["bucket"] for r in sized])
    columns = ["bucket", "key", "number", "pos", "word", "known"]
    one = left.select(*columns, "fresh"), right.select(*columns)
    if not sized:
        return one[0].groupBy("bucket").cogroup(one[1].groupBy("bucket")).applyInArrow(compare, schema)
    met = one[0].where(~big).groupBy("bucket").cogroup(one[1].where(~big).groupBy("bucket")).applyInArrow(compare, schema)
    g_l, g_r = (-(-max(r[c] or 1 for r in sized) // SPLIT) for c in ("n", "m"))
    part = lambda g: F.pmod(F.xxhash64("number", "pos"), F.lit(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    x = one[0].where(big).select("*", part(g_l).alias("i"), every(g_r).alias("j")).groupBy("bucket", "i", "j")
    y = one[1].where(big).select("*", every(g_l).alias("i"), part(g_r).alias("j")).groupBy("bucket", "i", "j")
    return met.unionByName(x.cogroup(y).applyInArrow(compare, schema))


def earlier_copies(files: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """(id_a, id_b), id_a < id_b: files of different batches with the same or nearly the same content, by a store of their own.

    ``files`` (id, batch, fingerprint): batch 0 is the history.
    """
    spark = files.sparkSession
    store = HashStore(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}", threshold=threshold)
    store.append(files.where(F.col("batch") == 0), 0)
    store.append(files.where(F.col("batch") > 0), 1)
    return store.match(1)
