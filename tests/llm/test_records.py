"""Survivorship, counters, groups and the set join against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofold.llm import frequency, hash_to_min, set_join, survivors
from echofold.schema import ITEM
from tests.test_operators import roots

GROUP = f"group_id string, files array<{ITEM.simpleString()}>"


def f(path, order, bitrate=None, size=None, duration=None, title=None, artist=None):
    return (path, size, duration, bitrate, (title, artist, None, None), None, order)


def test_survivors(spark):
    groups = [
        ("units", [f("a", 1, bitrate=320), f("b", 2, bitrate=318000, size=9), f("c", 3, bitrate=128000, size=99)]),
        ("scans", [f("a", 2, bitrate=-1), f("a", 1, bitrate=320000, size=5), f("b", 3, size=8000, duration=1.0), f("b", 2, size=0)]),
        ("ties", [f("b", 1, bitrate=1000000), f("a", 1, bitrate=1000000), f("a", 1, bitrate=1000000)]),
        ("one path", [f("a", 1, bitrate=128), f("a", 2, bitrate=320)]),
        ("no rate", [f("a", 1, size=5), f("b", 2, duration=0.0, size=3)]),
        ("no paths", [f(None, 1, bitrate=5), f("z", 1, bitrate=128)]),
        ("null", None), ("empty", []),
    ]
    df = spark.createDataFrame(groups, GROUP).withColumns({"path": F.lit(1), "rate": F.lit(2), "known": F.lit(3)})
    assert {r["group_id"]: r["keep_path"] for r in survivors.keep(df).collect()} == {"units": "b", "scans": "a", "ties": "a"}
    assert survivors.keep(df.limit(0)).count() == survivors.golden(df.limit(0)).count() == 0


def test_scans_in_order(spark):
    df = spark.createDataFrame([("g", [f("a", 1, bitrate=64000), f("a", 3, bitrate=None), f("a", 2, bitrate=128), f("b", 9, bitrate=100000, size=1)])], GROUP)
    got = {r["path"]: r["bitrate"] for r in survivors.members(df).collect()}
    assert got == {"a": 128, "b": 100000}
    assert survivors.keep(df).first()["keep_path"] == "a"


def test_golden(spark):
    df = spark.createDataFrame([("g", [f("a", 1, size=7, title="old", artist="X"), f("b", 2, size=0, title=" "), f("c", None, title="never")])], GROUP)
    assert survivors.golden(df).select("size", "title", "artist", "album").first() == (7, "old", "X", None)


def test_priority(spark):
    rows = spark.createDataFrame([("k", "x", 9, 0), ("k", "y", 1, 5), ("k", None, 99, 9)], "key string, v string, at int, trust int")
    got = survivors.survivors(rows, ["key"], {"v": F.col("v")}, F.col("at"), F.col("trust"))
    assert got.collect() == [("k", "y")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(1, 3))), st.lists(st.integers(1, 5), min_size=1))
def test_last_seen(rows, cuts):
    rows.sort()
    batches, at, i = [], 0, 0
    while at < len(rows):
        n = cuts[i % len(cuts)]
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + n]], pa.int64()) for k in range(3)], names=["term", "record", "n"]))
        at, i = at + n, i + 1
    got = {}
    for b in frequency.last_seen(iter(batches)):
        for t, o, r in zip(*(b.column(k).to_pylist() for k in range(3))):
            assert t not in got
            got[t] = (o, r)
    want = defaultdict(lambda: [0, set()])
    for t, r, n in rows:
        want[t][0] += n
        want[t][1].add(r)
    assert got == {t: (o, len(r)) for t, (o, r) in want.items()}


@pytest.mark.parametrize("share", [1 / 256, 0.2, 2.0])
def test_frequencies(spark, share):
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.3 else rng.randrange(50), rng.randrange(40)) for _ in range(2000)] + [(None, 1), (5, None), (-3, -9)]
    df = spark.createDataFrame(rows, "t bigint, r bigint").withColumns({"term": F.lit("x"), "record": F.lit("y"), "n": F.lit(0), "part": F.lit(1)}).repartition(6)
    want = defaultdict(lambda: [0, set()])
    for t, r in rows:
        if t is not None and r is not None:
            want[t][0] += 1
            want[t][1].add(r)
    got = frequency.frequencies(df, "t", "r", share)
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got.collect()} == {t: (o, len(r)) for t, (o, r) in want.items()}
    assert got.count() == len(want)
    marks = {r["term"]: r["mark"] for r in frequency.marked(got, 41).collect()}
    assert marks[-3] == "rare" and marks[7] == "common"
    assert frequency.frequencies(df.limit(0), "t", "r").count() == 0 and frequency.n_records(df.limit(0), "t", "r") == 0


@pytest.mark.parametrize("kind", ["random", "path", "star", "clique", "none"])
def test_hash_to_min(spark, kind, monkeypatch):
    monkeypatch.setattr(hash_to_min, "HEAVY_SHARE", 0.01)
    rng = random.Random(9)
    pairs = {
        "random": [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(220)],
        "path": [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)],
        "star": [("n500", f"m{i:04}") for i in range(1500)],
        "clique": [(f"n{i}", f"n{j}") for i in range(12) for j in range(12)],
        "none": [],
    }[kind]
    df = spark.createDataFrame([(a, b, 0.9) for a, b in pairs + pairs[:5]] + [("n001", None, 1.0), (None, "n001", 1.0), ("q", "q", 1.0), ("u", "v", 0.1), ("u", "w", None)], "a string, b string, s double")
    df = df.withColumns({"v": F.lit(1), "u": F.lit(2), "id": F.lit(3)})
    got = {r["path"]: r["group_path"] for r in hash_to_min.groups(df, where=F.col("s") >= 0.85).collect()}
    assert got == roots([p for p in pairs if p[0] != p[1]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 20)), max_size=9), st.integers(1, 6))
def test_merge_skip(lists, t):
    want = {x: n for x in range(21) if (n := sum(x in s for s in lists)) >= t}
    assert dict(set_join.merge_skip([sorted(s) for s in lists], t)) == want


def test_in_common():
    assert set_join.in_common(np.array([1, 5, 9]), np.array([5, 9, 11])) == 2
    assert set_join.in_common(np.array([], np.int64), np.array([1])) == 0


def brute(sets, threshold):
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("seed,threshold,short", [(1, 0.5, 64), (2, 0.5, 2), (3, 0.5, 1), (4, 0.8, 3), (5, 0.3, 2)])
def test_similar_sets(spark, seed, threshold, short):
    rng = random.Random(seed)
    base = [set(rng.sample(range(100, 400), rng.randrange(1, 25))) for _ in range(14)]
    sets = {}
    for i in range(90):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(6)):
            s.add(rng.randrange(400))
            if s and rng.random() < 0.5:
                s.discard(rng.choice(sorted(s)))
        s |= {1} if rng.random() < 0.7 else set()  # a value of most records
        sets[i] = s | ({2, 3} if seed % 2 else set())
    for i in range(90, 110):
        sets[i] = {1, 2, 3, 4}  # many copies, of common values only
    sets[110] = {1, 2, 3, 5}
    rows = [(t, i) for i, s in sets.items() for t in s for _ in range(rng.randrange(1, 4))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [(None, 1), (1, None)], "t bigint, f bigint").withColumns({"term": F.lit("x"), "record": F.lit(0), "n": F.lit(0)}).repartition(5)
    got = set_join.similar_sets(df, "t", "f", threshold, short).collect()
    pairs = [(r["a"], r["b"]) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(sets, threshold)
    for r in got:
        assert (r["overlap"], r["union_"]) == (len(sets[r["a"]] & sets[r["b"]]), len(sets[r["a"]] | sets[r["b"]]))


def test_similar_sets_of_nothing(spark):
    assert set_join.similar_sets(spark.createDataFrame([(None, 1)], "t bigint, f bigint"), "t", "f").count() == 0
    assert set_join.similar_sets(spark.createDataFrame([(1, 1)], "t bigint, f bigint"), "t", "f").count() == 0


def test_similar_sets_of_thousands_without_short_values(spark):
    """All values are long and most sets are made of them alone, many as copies; a third of the records are one set."""
    rng = random.Random(8)
    base = [frozenset(rng.sample(range(90), rng.randrange(6, 30))) for _ in range(120)]
    sets = {}
    for i in range(2400):
        s = set(base[0]) if i % 3 == 0 else set(rng.choice(base))
        if i % 3 and rng.random() < 0.7:
            s ^= set(rng.sample(range(90), 3))
        sets[i] = s | ({1000 + i // 2} if i % 5 == 0 else set())
    df = spark.createDataFrame([(t, i) for i, s in sets.items() for t in s], "t bigint, f bigint").repartition(4)
    got = set_join.similar_sets(df, "t", "f", 0.6, 4).select("a", "b", "overlap").toPandas()
    m = np.zeros((len(sets), 3000), np.float32)
    for i, s in sets.items():
        m[i, list(s)] = 1
    common, n = m @ m.T, m.sum(1)
    good = np.triu(common >= 0.6 * (n[:, None] + n[None] - common) - 1e-4, 1)
    a, b = np.nonzero(good)
    want = set(zip(a.tolist(), b.tolist(), common[a, b].astype(int).tolist()))
    assert len(got) == len(want) and set(zip(got["a"], got["b"], got["overlap"])) == want
