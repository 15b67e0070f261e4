"""Held-out passages in corpus documents, by Wu-Manber search and comparison."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.tokens import spread

PASSAGE_WORDS, ALTERED = 30, 0.10
#: Letters of the search strings that shift tables look at, at most, and of a block.
SEED, BLOCK = 24, 10
#: What stands between brackets or dashes and is no longer than this is an interruption or a page mark; a text with longer ones is searched with and without them.
ASIDE = 140
#: Texts of more words are compared piece by piece.
NEAR_WORDS = 600
#: Letters of items that one search holds, which is some 170 MB in a worker; more items are searched in several passes.
PASS_LETTERS = 1_000_000

_ASIDES = re.compile(rf"\([^()]{{0,{ASIDE}}}\)|\[[^\[\]]{{0,{ASIDE}}}\]|<[^<>]{{0,{ASIDE}}}>|—[^—\n]{{1,{ASIDE}}}[!?.:]\s*—")
_LONG_ASIDES = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|—[^—\n]+[!?.:]\s*—")
_BROKEN = re.compile(r"(?<=\w)[-‐‑­][ \t]*\r?\n\s*(?=\w)|­")
_WORD = re.compile(r"\w+(?:(?:[-‐‑'’]|(?<=\d)[.,](?=\d))\w+)*")
_JOINER = re.compile(r"[-‐‑'’_.,]")


def _split(t: str) -> list[str]:
    t = t.lower()
    if "\n" in t or "­" in t:
        t = _BROKEN.sub("", t)
    found = _WORD.findall(t)
    return [w if w.isalnum() else _JOINER.sub("", w) for w in found if w.strip("_")]


def words(text: str | None) -> list[str]:
    """Words in lower case, whole where a line end or a hyphen splits them, numbers whole with their separators, without asides; punctuation and layout are dropped."""
    return _split(_ASIDES.sub(" ", _ASIDES.sub(" ", text or "")))


def readings(text: str | None) -> list[list[str]]:
    """words(), and where a bracket or a pair of dashes holds so much that it may be a passage or split one, the text with all of them and with none."""
    out, longest = [words(text)], max((m.end() - m.start() for m in _LONG_ASIDES.finditer(text or "")), default=0)
    if longest > ASIDE // 2:
        out += [_split(text), _split(_LONG_ASIDES.sub(" ", _LONG_ASIDES.sub(" ", text)))]
    return out


def least_run(at_least: int, altered: float) -> tuple[int, int]:
    """(unaltered words in a row that any passage has, words in such rows): k altered words leave k + 1 rows."""
    sizes = [(n, math.floor(altered * n + 1e-9)) for n in range(at_least, 12 * at_least + 1)]
    run = min(-(-(n - k) // (k + 1)) for n, k in sizes)
    return run, min(n - k - k * (run - 1) for n, k in sizes)


def reach(item: list[str], doc: list[str], most: list[float]) -> list[int]:
    """The least number of altered words with which the first 0, 1, 2 ... words of ``item`` stand at the start of ``doc``, as far as it may matter.

    A word may be replaced, missing or added.  A word that is broken in two,
    or two that are run together, are not altered.  ``most`` says for each
    number of words how many altered ones may matter.  Only the furthest
    point on each diagonal is kept for each cost, so equal texts take linear
    time.
    """
    costs, n, m, c, points = [0], len(item), len(doc), 0, [(0, 0)]
    while points:
        front: dict[int, int] = {}
        for i, j in points:
            if front.get(j - i, -1) >= i:
                continue
            front[j - i] = at = i
            while i < n and j < m:
                if item[i] == doc[j]:
                    i, j = i + 1, j + 1
                elif j + 1 < m and item[i] == doc[j] + doc[j + 1]:
                    i, j = i + 1, j + 2
                elif i + 1 < n and item[i] + item[i + 1] == doc[j]:
                    i, j = i + 2, j + 1
                else:
                    break
            if i > at:
                if len(costs) <= i:
                    costs += [c] * (i + 1 - len(costs))
                if front.get(j - i, -1) < i:
                    front[j - i] = i
        if len(costs) > n:
            break
        c, points = c + 1, []
        for k, i in front.items():
            j = i + k
            if i < n and j < m and c <= most[i + 1]:
                points.append((i + 1, j + 1))
                # A replaced word may be the last of a passage; a missing one may not.
                if len(costs) < i + 2:
                    costs += [c] * (i + 2 - len(costs))
            if i < n and c <= most[i + 1]:
                points.append((i + 1, j))
            if j < m and c <= most[i]:
                points.append((i, j + 1))
        points.sort(reverse=True)
    return costs


class Passages:
    """The search tables of the items, and the search.

    Texts are searched as runs of letters and digits for all strings of so
    many words of an item as any passage has unaltered in a row, and compared
    word by word around what is found.
    """

    def __init__(self, items: Iterable[tuple[int, str | None]], at_least: int = PASSAGE_WORDS, altered: float = ALTERED) -> None:
        self.at_least, self.altered = at_least, altered
        self.run_words, self.least_cover = least_run(at_least, altered)
        self.words: dict[int, list[str]] = {}
        self.seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            w = words(text)
            if len(w) < at_least:
                continue
            self.words[item] = w
            for i in range(len(w) - self.run_words + 1):
                self.seeds["".join(w[i : i + self.run_words])].append((item, i))
        # The items as numbers of their words, in rows: each word, and each two that may be run together; -1 is no word of any, -2 is behind the end.
        self.ids: dict[str, int] = {}
        number = lambda w: self.ids.setdefault(w, len(self.ids))
        self.row = {item: k for k, item in enumerate(self.words)}
        self.sizes = np.array([len(w) for w in self.words.values()], np.int32)
        width = int(self.sizes.max(initial=at_least))
        self.one, self.two = np.full((len(self.words), width), -2, np.int32), np.full((len(self.words), width - 1), -1, np.int32)
        for k, w in enumerate(self.words.values()):
            self.one[k, : len(w)] = [number(x) for x in w]
            self.two[k, : len(w) - 1] = [number(x + y) for x, y in zip(w, w[1:])]
        self.length = min([SEED, *map(len, self.seeds)])
        self.block = min(BLOCK, self.length)
        # How far the window may move when it ends in a block; the strings whose first letters end in it.
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for seed in self.seeds:
            for end in range(self.block, self.length + 1):
                block = seed[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.length), self.length - end)
            self.bucket[seed[: self.length]][len(seed)].add(seed)
        self.bucket = {k: {n: set(x) for n, x in v.items()} for k, v in self.bucket.items()}

    def hits(self, run: str) -> list[tuple[int, str]]:
        """(start, search string) of all occurrences in a run of letters."""
        out, shift, bucket, m, b = [], self.shift.get, self.bucket, self.length, self.block
        far, i, n, none = m - b + 1, m, len(run), {}
        while i <= n:
            step = shift(run[i - b : i], far)
            if step:
                i += step
                continue
            start = i - m
            for size, seeds in bucket.get(run[start:i], none).items():
                if (window := run[start : start + size]) in seeds:
                    out.append((start, window))
            i += 1
        return out

    def search(self, text: str | None) -> list[int]:
        """The items of which the text holds a passage."""
        if not self.seeds or len(text or "") < self.length:
            return []
        return sorted({item for doc in readings(text) for item in self._search(doc)})

    def _search(self, doc: list[str]) -> list[int]:
        hits = self.hits("".join(doc))
        if not hits:
            return []
        starts = [0]
        for w in doc:
            starts.append(starts[-1] + len(w))
        # Hits of one item that follow each other are one run of unaltered words.
        runs: dict[int, list[list[int]]] = defaultdict(list)  # item -> [first word, word behind the last, first word in the text]
        last: dict[tuple[int, int], list[int]] = {}
        word_at = {x: d for d, x in enumerate(starts)}
        for at, seed in hits:
            d = word_at.get(at)
            if d is None or at + len(seed) not in word_at:
                continue  # letters of parts of words
            for item, i in self.seeds[seed]:
                run = last.get((item, d - i))
                if run and run[1] >= i:
                    run[1] = i + self.run_words
                else:
                    last[item, d - i] = run = [i, i + self.run_words, d]
                    runs[item].append(run)
        left = [item for item, of in runs.items() if self._covered(of, self.allowed(item))]
        near = self._plausible(left, doc) if len(doc) <= NEAR_WORDS else dict.fromkeys(left)
        return [item for item, there in near.items() if any(self._passes(item, *x, doc, starts, there) for x in sorted(runs[item], key=lambda x: x[0] - x[1]))]

    def allowed(self, item: int) -> int:
        """Altered words that any passage of the item may have."""
        return math.floor(self.altered * len(self.words[item]) + 1e-9)

    def _plausible(self, items: list[int], doc: list[str]) -> dict[int, np.ndarray]:
        """Items of which enough words in a row are anywhere in ``doc``, and which; a word that isn't is altered, wherever the others stand."""
        if not items:
            return {}
        there = np.zeros(len(self.ids) + 2, bool)
        there[[self.ids.get(w, -1) for w in doc]] = True
        there[[self.ids.get(v + w, -1) for v, w in zip(doc, doc[1:])]] = True  # a broken word
        there[-1], there[-2] = False, True
        at = [self.row[i] for i in items]
        here = there[self.one[at]]
        both = there[self.two[at]]  # two words run together
        here[:, :-1] |= both
        here[:, 1:] |= both
        cost = np.zeros((len(at), here.shape[1] + 1))
        np.cumsum(~here, axis=1, out=cost[:, 1:])
        cost -= self.altered * np.arange(cost.shape[1])
        good = cost[:, self.at_least :] <= np.maximum.accumulate(cost, axis=1)[:, : -self.at_least] + 1e-9
        good &= np.arange(self.at_least, cost.shape[1]) <= self.sizes[at][:, None]
        return {i: row for i, ok, row in zip(items, good.any(axis=1), here) if ok}

    def _covered(self, runs: list[list[int]], allowed: int) -> bool:
        """Whether runs that one alignment may have in common hold as many words as a passage has in such runs."""
        if any(b - a >= self.least_cover for a, b, _ in runs):
            return True
        if len(runs) == 1:
            return False
        # Of two runs, either alone is too short.
        at = sorted((d - a, a) for a, _, d in runs)
        return any(y[0] - x[0] <= allowed for x, y in zip(at, at[1:]))

    def _passes(self, item: int, i0: int, i1: int, d: int, doc: list[str], starts: list[int], there: np.ndarray | None) -> bool:
        """Whether the unaltered words i0 to i1 of the item, which stand at word ``d`` of the text, are in a passage."""
        w, share = self.words[item], self.altered
        if i1 - i0 >= self.at_least:
            return True
        if there is None:
            shift = 2 * self.allowed(item)
            there = self._plausible([item], doc[max(0, d - i0 - shift) : d + len(w) - i0 + shift]).get(item)
            if there is None:
                return False
        # Of each side: what its first n words cost at least, less their share; and how low that may still fall.
        sides = []
        for x in (there[:i0][::-1], there[i1 : len(w)]):
            least = np.r_[0, np.cumsum(~x)]
            net = least - share * np.arange(len(least))
            sides.append((float(net.min()), np.minimum.accumulate(net[::-1])[::-1] - least))
        slack = share * (i1 - i0) + 1e-9
        if sides[0][0] + sides[1][0] > slack:
            return False
        e = bisect_left(starts, starts[d] + len("".join(w[i0:i1])))
        right = reach(w[i1:], doc[e:], (slack - sides[0][0] - sides[1][1]).tolist())
        low = min(c - share * n for n, c in enumerate(right))
        if sides[0][0] + low > slack:
            return False
        left = reach(w[:i0][::-1], doc[:d][::-1], (slack - low - sides[0][1]).tolist())
        # Some window of enough words on both sides must not cost more than its share.
        best, high = [], float("inf")
        for n in range(len(right) - 1, -1, -1):
            high = min(high, right[n] - share * n)
            best.append(high)
        best.reverse()
        first = self.at_least - (i1 - i0)
        return any(first - n < len(best) and c - share * n + best[max(0, first - n)] <= slack for n, c in enumerate(left))


def leaks(docs: DataFrame, items: DataFrame, at_least: int = PASSAGE_WORDS, altered: float = ALTERED) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of at least 30 successive words of an item, one word in ten altered at most.

    Altered is a word that is replaced, at the ends of the passage too, or
    missing or added within it.  Nothing that fits this is lost: every such
    passage has so many unaltered words in a row that the search finds it,
    and the comparison around them is exact.

    The items are the search tables, sent to each executor; they are test
    material of a fixed size, and beyond PASS_LETTERS letters they are
    searched in several passes.  Documents are read whole, once per pass, and
    nothing of them is shuffled unless there are fewer partitions than cores.
    Null, empty and blank texts hold nothing; items shorter than a passage
    occur nowhere.
    """
    spark, out, batch, letters = docs.sparkSession, [], [], 0

    def pass_(batch: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Passages(batch, at_least, altered))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = shared.value.search
            for b in batches:
                ids, found = b.column(0).to_pylist(), [search(t) for t in b.column(1).to_pylist()]
                pairs = [(d, i) for d, f in zip(ids, found) for i in f]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

        return spread(docs.where(F.length("text") > 0), "doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint")

    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        batch.append((r["item_id"], r["text"]))
        letters += len(r["text"])
        if letters > PASS_LETTERS:
            out.append(pass_(batch))
            batch, letters = [], 0
    if batch or not out:
        out.append(pass_(batch))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_.distinct()
