import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echofold.llm import history
from tests.test_functions import at

SCHEMA = "id bigint, batch int, fingerprint array<int>"


def best(a, b):
    return max(at(a, b, k) for k in range(-20, 21))


def made(seed, n=60):
    rng = random.Random(seed)
    frame = lambda: rng.randrange(-(2**31), 2**31)
    noisy = lambda fp, p: [((x & 0xFFFFFFFF) ^ sum((rng.random() < p) << b for b in range(32))) for x in fp]
    signed = lambda fp: [x - 2**32 if x >= 2**31 else x for x in fp]
    rows = []
    for i in range(n):
        fp = [frame() for _ in range(rng.randrange(40, 80))]
        rows.append((i, 0, fp))
        for j in range(rng.randrange(3)):
            k = rng.randrange(-20, 21)
            fp2 = signed(noisy(fp, rng.choice([0, 0.02, 0.05, 0.3])))
            fp2 = fp2[k:] if k > 0 else [frame() for _ in range(-k)] + fp2
            rows.append((1000 + i * 10 + j, rng.randrange(1, 4), fp2 if rng.random() < 0.8 else fp))
    return rows + [(5000, 1, None), (5001, 2, []), (5002, 0, None), (None, 1, rows[0][2])]


def brute(rows):
    rows = [r for r in rows if r[2] and r[0] is not None]
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[1] > b[1] and best(a[2], b[2]) >= 0.85}


def test_earlier_copies(spark):
    rows = made(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"hash": F.lit(1), "number": F.lit(1), "new": F.lit(1)}).repartition(5)
    got = [tuple(r) for r in history.earlier_copies(df).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want) > 20 and len(set(got)) >= 0.97 * len(want)


def test_store_agrees(spark, tmp_path):
    rows = [r for r in made(2) if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    store, got = history.HashStore(spark, str(tmp_path / "s"), buckets=4), set()
    for n in range(4):
        batch = df.where(F.col("batch") == n)
        store.append(batch, n)
        store.append(batch, n)  # again, as after a failure
        if n:
            got |= {tuple(r) for r in store.match(n).collect()}
        store.close()
        store = history.HashStore(spark, str(tmp_path / "s"), buckets=7)  # opened again, as it was made
    assert got == {tuple(r) for r in history.earlier_copies(df).collect()}


def test_silence(spark, monkeypatch):
    """Contents of frames that are too common to tell anything are compared all the same."""
    monkeypatch.setattr(history, "HOT_LEAST", 3)
    rng = random.Random(4)
    quiet = [[rng.choice([1, 2, 3]) for _ in range(45)] for _ in range(12)]
    rows = [(i, i % 3, fp) for i, fp in enumerate(quiet)] + [(50 + i, 2, fp) for i, fp in enumerate(quiet[:4])]
    got = {tuple(r) for r in history.earlier_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_nothing(spark):
    assert history.earlier_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert history.earlier_copies(spark.createDataFrame([(1, 0, None)], SCHEMA)).count() == 0


def family(rng, n, frames, altered):
    """Copies of one recording with some frames replaced by others."""
    frame = lambda: rng.randrange(-(2**31), 2**31)
    first = [frame() for _ in range(frames)]
    out = []
    for _ in range(n):
        fp = list(first)
        for i in rng.sample(range(frames), rng.randrange(*altered)):
            fp[i] = frame()
        out.append(fp)
    return out


def test_family(spark):
    """A family of more near copies than a frame may have contents keeps its evidence."""
    rows = [(i, i % 3, fp) for i, fp in enumerate(family(random.Random(7), 90, 60, (2, 9)))]
    got = [tuple(r) for r in history.earlier_copies(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) == 2700


def test_silence_and_telling(spark, monkeypatch):
    """Contents of too few telling frames, or of frequent frames for the most part, are compared with any others."""
    monkeypatch.setattr(history, "HOT_LEAST", 3)
    rng = random.Random(5)
    frame = lambda: rng.randrange(-(2**31), 2**31)
    silent = [1] * 100
    rows = [(i, 0, [1] * 60 + [frame() for _ in range(60)]) for i in range(4)]
    rows += [(10, 0, silent), (11, 1, [1] * 90 + [frame() for _ in range(10)])]
    rows += [(20 + i, i, [1] * 75 + [frame() for _ in range(25)]) for i in range(2)]
    long = [frame() for _ in range(60)]
    four_bits = lambda x: ((x & 0xFFFFFFFF) ^ sum(1 << i for i in rng.sample(range(32), 4)) ^ (1 << 31)) - 2**31
    rows += [(30, 0, long)] + [(31 + i, 1, [four_bits(x) for x in long[3 * i : 3 * i + 6]]) for i in range(6)]
    got = {tuple(r) for r in history.earlier_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and {(10, 11), (20, 21), (30, 31), (30, 36)} <= got


def test_store_keeps_families_and_silence(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, i // 80, fp) for i, fp in enumerate(family(rng, 90, 60, (2, 9)))]
    rows += [(200, 0, rows[0][2][:6]), (201, 1, [x ^ 7 for x in rows[0][2][:6]])]
    df, store = spark.createDataFrame(rows, SCHEMA), history.HashStore(spark, str(tmp_path / "s"), buckets=4)
    store.append(df.where("batch = 0"), 0)
    assert store.hot()
    store.append(df.where("batch = 1"), 1)
    got = [tuple(r) for r in store.match(1).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 800


def test_hot_limit(spark):
    """A frame in 90 of 20,000 contents still tells something; one in 150 does not."""
    c = spark.range(20000).select(F.array(F.col("id"), F.when(F.col("id") < 90, -1).when(F.col("id") < 240, -2).otherwise(F.col("id"))).cast("array<int>").alias("fingerprint"))
    assert history.hot_frames(c) == [-2]


def test_split_groups(spark, monkeypatch):
    """Groups that are too large for one task give the same pairs."""
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in history.earlier_copies(df).collect()}
    monkeypatch.setattr(history, "SPLIT", 8)
    monkeypatch.setattr(history, "FLUSH", 64)
    got = [tuple(r) for r in history.earlier_copies(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_tables_lie_in_buckets(spark, tmp_path):
    """Whole hashes, contents and members are joined, and paragraphs met, where they lie."""
    df, store = spark.createDataFrame([r for r in made(4) if r[0] is not None], SCHEMA), history.HashStore(spark, str(tmp_path / "s"), buckets=4)
    store.append(df.where("batch = 0"), 0)
    store.append(df.where("batch > 0"), 1)
    new = store.table("paragraphs").where("part = 1")
    plan = history._met(store.table("paragraphs").withColumn("fresh", F.lit(False)), new, 10)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]
    h = store.table("hashes")
    plan = h.where("part = 0").join(h.where("part = 1").hint("merge"), "hash")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_recall_by_bits(spark):
    """Of pairs whose bits are flipped at random, in contents of any length, at least 97 percent come out up to the threshold."""
    rng, rows, want = random.Random(11), [], 0
    for i in range(150):
        fp = [rng.randrange(2**32) for _ in range(rng.choice([30, 40, 70, 150]))]
        k, p = rng.randrange(-9, 10), rng.choice([0.05, 0.1, 0.13])
        other = [x ^ sum((rng.random() < p) << b for b in range(32)) for x in fp]
        other = other[k:] if k > 0 else [rng.randrange(2**32) for _ in range(-k)] + other
        rows += [(i, 0, [x - 2**31 for x in fp]), (1000 + i, 1, [x - 2**31 for x in other])]
    want = brute(rows)
    got = {tuple(r) for r in history.earlier_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got <= want and len(want) > 140 and len(got) >= 0.97 * len(want)


def test_one_id_of_several_contents(spark):
    """Of rows with one id the last batch counts; repeated rows count once."""
    rng = random.Random(3)
    x, y, z = ([rng.randrange(-(2**31), 2**31) for _ in range(50)] for _ in range(3))
    rows = [(1, 0, x), (2, 0, y), (7, 1, x), (7, 2, y), (7, 2, y), (8, 1, x), (8, 1, x), (9, 3, z)]
    got = sorted(tuple(r) for r in history.earlier_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 8), (2, 7)]


def masks(rng, n, hot, most, dense=0.5):
    """Contents that begin with silence, then have frequent frames here and there; the first ``dense`` of them have more."""
    values = np.array([0, *range(1, hot + 1), *range(129, hot + 129)], np.uint8)
    p = np.r_[0.5, np.full(hot, 0.48 / hot), np.full(hot, 0.02 / hot)]
    out = []
    for i in range(n):
        k = int(rng.integers(8, most))
        m = rng.choice(values, k, p=p if i >= dense * n else np.r_[0.2, p[1:] * 1.6])
        m[: int(rng.integers(0, k // 2))] = rng.integers(1, 3)
        out.append(m.tobytes())
    for i in range(n // 2, n // 2 + n // 8):  # nearly the same mask, moved
        out[i] = out[0][int(rng.integers(0, 4)) :] if i % 2 else bytes(3) + out[1]
    return out


@pytest.mark.parametrize("hot, most", [(2, 40), (6, 90), (20, 150)])
def test_silent_is_exact(hot, most):
    """The alignments that frequent frames may carry, by bitmaps, are those of a look at every one."""
    rng = np.random.default_rng(hot)
    frames = [int(x) for x in rng.integers(0, 2**32, hot)]
    frames[1] = frames[0] ^ 0b111
    agree, threshold = history.agreements(frames), 0.85
    a, b = masks(rng, 40, hot, most), masks(rng, 150, hot, most)
    table = lambda m, at: pa.table({"number": pa.array(np.arange(at, at + len(m))), "mask": pa.array(m, pa.binary())})
    want = set()
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            for k in range(-20, 21):
                u, v = np.frombuffer(x, np.uint8)[max(k, 0) :], np.frombuffer(y, np.uint8)[max(-k, 0) :]
                n = len(u)  # it ends with the end of a
                if 0 < n <= len(v):
                    both = agree[u, v[:n]]
                    rest = n - (both > 0).sum()
                    if (both > 0).sum() >= history.least_hot(n, threshold) and both.sum(dtype=float) + rest / 2 + history.CHANCE_SD / 2 * np.sqrt(rest / 32) >= threshold * n - 1e-6:
                        want.add((i, 1000 + j, k))
    got = [tuple(r.values()) for r in history._silent(table(a, 0), table(b, 1000), threshold, agree).to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_silent_does_not_multiply_all_pairs():
    """Finding the alignments takes less time than a product of all masks at all shifts, which is only a part of looking at every pair."""
    rng = np.random.default_rng(1)
    frames = [int(x) for x in rng.integers(0, 2**32, 30)]
    p = np.r_[0.7, np.full(30, 0.01)]
    one = lambda q: np.r_[np.full(20, 1 + rng.integers(2)), rng.choice(31, 45, p=q)].astype(np.uint8).tobytes()
    a, b = [one(np.r_[0.5, np.full(30, 0.5 / 30)]) for _ in range(400)], [one(p) for _ in range(30000)]
    table = lambda m, at: pa.table({"number": pa.array(np.arange(at, at + len(m))), "mask": pa.array(m, pa.binary())})
    x, y, began = rng.random((400, 65), np.float32), rng.random((65, 1000), np.float32), time.process_time()
    for _ in range(41 * 30):
        (x @ y >= 99).any()
    product, began = time.process_time() - began, time.process_time()
    history._silent(table(a, 0), table(b, 1000), 0.85, history.agreements(frames))
    assert time.process_time() - began < product
