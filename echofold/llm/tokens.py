"""Encoding a corpus by a public byte-level BPE vocabulary: a two-tier lookup.

A pre-token that is itself in the vocabulary is resolved by a minimal
perfect hash; any other is merged from its bytes with a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a task remembers; it starts anew beyond that.
REMEMBERED = 1 << 18


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, spread evenly over the cores where the files alone would give them less than a task each."""
    df = df.select(*columns)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def load(path: str = VOCABULARY) -> list[bytes]:
    """Tokens by id, from lines of base64 token and rank."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash of n byte strings: n slots, one string each, one displacement per bucket.

    Buckets of some three strings are placed from the largest down, each by
    the first displacement that sends all its strings to free slots; buckets
    of one string name a free slot outright, so the last slots cost no search.
    """

    def __init__(self, keys: list[bytes]) -> None:
        if len(set(keys)) != len(keys):
            raise ValueError("the keys of a perfect hash must differ")
        self.n = max(1, len(keys))
        self.n_buckets = self.n // 3 + 1
        for self.seed in range(1 << 16):
            if self._place(keys):
                break
        else:
            raise RuntimeError("no seed gives a perfect hash")
        self._displace, self._slots = self.displace.tolist(), self.slots.tolist()

    def _place(self, keys: list[bytes]) -> bool:
        """Find all displacements under the present seed; few keys may need another one."""
        n = self.n
        self.slots = np.full(n, -1, np.int32)
        self.displace = np.zeros(self.n_buckets, np.int64)
        hashes = [self._hashes(k) for k in keys]
        buckets: dict[int, list[int]] = {}
        for i, (b, _, _) in enumerate(hashes):
            buckets.setdefault(b, []).append(i)
        free = np.ones(n, bool)
        singles = []
        tries = np.arange(1, 1 << 12, dtype=np.int64)
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            x, y = (np.array([hashes[i][j] for i in members], np.int64) for j in (1, 2))
            found = False
            for base in range(0, max(2 * n, 1 << 12), len(tries)):
                at = (x[None, :] + (tries[:, None] + base) * y[None, :]) % n
                for d in np.flatnonzero(free[at].all(1)):
                    if len(set(at[d].tolist())) == len(members):
                        found = True
                        break
                if found:
                    break
            if not found:
                return False
            self.displace[b] = tries[d] + base
            self.slots[at[d]] = members
            free[at[d]] = False
        for (b, i), slot in zip(singles, np.flatnonzero(free).tolist()):
            self.displace[b] = -1 - slot
            self.slots[slot] = i
        return True

    def _hashes(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        return h % self.n_buckets, (h >> 40) % self.n, 1 + (h >> 80) % max(1, self.n - 1)

    def slot(self, key: bytes) -> int:
        """The index of the only key that may be this one; compare to be sure."""
        b, x, y = self._hashes(key)
        d = self._displace[b]
        return self._slots[-1 - d if d < 0 else (x + d * y) % self.n]


class Encoder(dict):
    """pre-token -> ids; a dict of what was met, computed where missing."""

    def __init__(self, tokens: list[bytes], table: PerfectHash) -> None:
        super().__init__()
        self.tokens, self.table = tokens, table

    def rank(self, piece: bytes) -> int:
        """The id of a piece in the vocabulary, else -1."""
        i = self.table.slot(piece)
        return i if i >= 0 and self.tokens[i] == piece else -1

    def __missing__(self, word: str) -> list[int]:
        piece = word.encode("utf-8", "surrogatepass")
        whole = self.rank(piece)
        ids = self[word] = [whole] if whole >= 0 else self.merge(piece)
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of the lowest rank, the leftmost on ties, until none is in the vocabulary.

        The bytes are a linked list; the heap holds (rank, left end, ends of
        both parts), and an entry whose parts have changed is skipped.
        n log n for a piece of n bytes, however long.
        """
        n = len(piece)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0: no part starts at i
        before = list(range(-1, n - 1))  # start of the part before the one at i
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                r = self.rank(piece[i : end[j]])
                if r >= 0:
                    heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(self.rank(piece[i : end[i]]))
            i = end[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts.  Names of special tokens are ordinary text."""
        out: list[int] = []
        for word in _SPLIT(text or ""):
            out += self[word]
        return out


_SPLIT = regex.compile(PATTERN).findall


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>), a row for each row; an empty list for empty and null texts.

    The driver reads the vocabulary (of a fixed size, under 1 MB) and ships
    the built table once; documents are encoded whole, in Arrow batches,
    without a shuffle unless there are fewer partitions than cores.
    """
    tokens = load(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(*shared.value)
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for t in b.column(1).to_pylist():
                flat += enc.encode(t)
                ends.append(len(flat))
            if len(enc) > REMEMBERED:
                enc.clear()
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    return spread(docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias(text)), key, text).mapInArrow(run, f"`{key}` bigint, ids array<int>")
