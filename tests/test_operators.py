import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from echofold.operators import cluster, index, skew, verify
from echofold.plans.pipeline import find_duplicates, library
from echofold.schema import ITEM


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    low = {}
    for x in parent:
        low[find(x)] = min(low.get(find(x), x), x)
    return {x: low[find(x)] for x in parent}


@pytest.mark.parametrize("seed,n,m", [(1, 40, 25), (2, 200, 150), (3, 60, 59)])
def test_components(spark, seed, n, m):
    rng = random.Random(seed)
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(m)] if seed == 3 else [(f"n{rng.randrange(n):03}", f"n{rng.randrange(n):03}") for _ in range(m)]
    pairs = [p for p in pairs if p[0] != p[1]] + pairs[:3]
    dirty = pairs + [("x", "x"), (None, "y"), ("z", None)]
    got = {r["node"]: r["component"] for r in cluster.components(spark.createDataFrame(dirty, "a string, b string")).collect()}
    assert got == roots(pairs)


def test_components_of_a_star(spark):
    got = cluster.components(spark.createDataFrame([("hub", f"leaf{i}") for i in range(500)], "a string, b string"))
    assert got.select("component").distinct().count() == 1 and got.count() == 501


def test_components_of_nothing(spark):
    assert cluster.components(spark.createDataFrame([], "a string, b string")).count() == 0


def brute(sets, min_abs, cap):
    df = Counter(t for s in sets.values() for t in s)
    out = {}
    for a in sets:
        for b in sets:
            if a < b and (n := len([t for t in sets[a] & sets[b] if df[t] <= cap])) >= min_abs:
                out[a, b] = n
    return out


@pytest.mark.parametrize("min_abs,cap", [(1, 100), (2, 5), (4, 8), (6, 100)])
def test_shared_terms(spark, min_abs, cap):
    rng = random.Random(min_abs)
    sets = {f"f{i:02}": {int(rng.paretovariate(0.7)) % 60 for _ in range(rng.randrange(20))} for i in range(30)}
    post = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "path string, term bigint")
    got = {(r["a"], r["b"]): r["shared"] for r in index.shared_terms(post, min_abs=min_abs, cap=cap).collect()}
    assert got == brute(sets, min_abs, cap)


@pytest.mark.parametrize("n,shared,want", [(200, 20, True), (200, 19, False), (210, 21, True), (210, 20, False)])
def test_containment(spark, n, shared, want):
    df = spark.createDataFrame([(shared, n, 5000)], "s bigint, a bigint, b bigint")
    assert df.select(index.containment(F.col("s"), F.col("a"), F.col("b"))).first()[0] is want


def test_df_cap(spark):
    post = spark.createDataFrame([(f"p{i}", 1) for i in range(3)] + [(f"p{i}", 2) for i in range(4)], "path string, term bigint")
    assert {r["term"] for r in index.df_capped(post, cap=3).collect()} == {1}
    wider = spark.createDataFrame([(1, 9), (2, 3)], "term bigint, df bigint")
    assert {r["term"] for r in index.df_capped(post, wider, cap=3).collect()} == {2}


def item(path, bitrate=0, size=0, duration=0.0, order=0, fp=None, title=None):
    return (path, size, duration, bitrate, (title, None, None, None), fp, order)


def test_chain_and_confidence(spark):
    edges = spark.createDataFrame([("a", "b", 0.9, 0.4, 1.0), ("b", "c", 1.0, 0.6, 5.0), ("d", "e", 0.9, None, 5.01)], "a string, b string, similarity double, tag_score double, duration_delta double")
    got = {r["group"]: r for r in cluster.duplicate_groups(edges, cluster.components(edges)).collect()}
    assert (got["a"]["n_files"], round(got["a"]["score"], 6), round(got["a"]["tag_score"], 6), got["a"]["confidence"]) == (3, 0.95, 0.5, "high")
    assert (got["d"]["confidence"], got["d"]["tag_score"]) == ("medium", 0.0)


def test_keep(spark):
    m = spark.createDataFrame(
        [("g", "a", 10, 128000, 1), ("g", "b", 20, 320000, 2), ("g", "c", 5_000_000, 0, 3), ("h", "x", 7, 1, 2), ("h", "y", 9, 1, 1), ("i", "n", None, None, 1)],
        "group string, path string, size bigint, bitrate int, scan_ord bigint",
    )
    got = {r["group"]: (r["keep"], r["savings"]) for r in cluster.keep_best(m).collect()}
    assert got == {"g": ("c", 30), "h": ("y", 7), "i": ("n", 0)}


def test_pipeline(spark):
    rng = random.Random(5)
    base = [[rng.randrange(-(2**31), 2**31) for _ in range(50)] for _ in range(6)]
    rows = [item(f"/m/{i}a.mp3", 128000, 100, 10.0, 2 * i, fp, "T") for i, fp in enumerate(base)]
    rows += [item(f"/m/{i}b.mp3", 0, 90, 10.0, 2 * i + 1, [x ^ (1 if j % 9 == 0 else 0) for j, x in enumerate(fp)], "T") for i, fp in enumerate(base[:3])]
    rows += [item("/m/none.mp3", order=90), item("/m/empty.mp3", order=91, fp=[])]
    r = find_duplicates(spark.createDataFrame(rows, ITEM))
    assert {(e["a"], e["b"]) for e in r.edges.collect()} == {(f"/m/{i}a.mp3", f"/m/{i}b.mp3") for i in range(3)}
    assert r.groups.count() == 3 and r.members.count() == 6


def test_pipeline_of_nothing(spark):
    r = find_duplicates(spark.createDataFrame([], ITEM))
    assert r.edges.count() == r.groups.count() == 0


def test_library(spark):
    files = spark.createDataFrame([item("p", 1, 5, 0.0, 1), item("p", 2, 6, None, 2), (None, 1, 1.0, 1, None, None, 3), item("q", 1, 1, 10.0, 4, [1])], ITEM)
    cache = spark.createDataFrame([("p", 1.0, 3.0, [1]), ("p", 2.0, 12.5, [2]), ("q", 9.0, 12.5, [9])], "path string, mtime double, duration double, fingerprint array<int>")
    got = {r["path"]: (r["size"], r["duration"], r["bitrate"], r["fingerprint"]) for r in library(files, cache).collect()}
    assert got == {"p": (6, 12.5, 2, [2]), "q": (1, 10.0, 1, [1])}


def test_edges_need_fingerprints(spark):
    items = spark.createDataFrame([item("a", fp=[1] * 30), item("b", fp=[1] * 30), item("c", fp=[])], ITEM)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "gone")], "a string, b string")
    assert [(e["a"], e["b"], e["similarity"]) for e in verify.edges(pairs, items).collect()] == [("a", "b", 1.0)]


def rows_of(seed, n=3000):
    rng = random.Random(seed)
    rows = [(1 if rng.random() < 0.4 else rng.choice([2, 3]) if rng.random() < 0.3 else rng.randrange(10, 10**9), rng.randrange(-(10**12), 10**12) if seed % 2 else rng.randrange(6)) for _ in range(n)]
    return rows + [(None, 1), (1, None), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_skewed_keys(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "k bigint, v bigint").withColumns({"key": F.lit("x"), "value": F.lit("y"), "n": F.lit(1)}).repartition(5)
    by = defaultdict(list)
    for k, v in rows:
        if k is not None and v is not None:
            by[k].append(v)
    total = sum(map(len, by.values()))
    hot = {k: sorted(v) for k, v in by.items() if len(v) >= 0.05 * total}
    assert len(hot) == 3
    modes = {k: min(Counter(v).items(), key=lambda x: (-x[1], x[0]))[0] for k, v in hot.items()}
    assert {r["k"]: r["v"] for r in skew.hot_key_modes(df, "k", "v", 0.05).collect()} == modes
    qs = (0.0, 0.25, 0.5, 1.0)
    want = {(k, q): v[max(1, -int(-(q * len(v)) // 1)) - 1] for k, v in hot.items() for q in qs}
    assert {(r["k"], r["quantile"]): r["v"] for r in skew.hot_key_quantiles(df, "k", "v", 0.05, qs).collect()} == want


def test_skew_of_nothing(spark):
    empty = spark.createDataFrame([(None, 1)], "k bigint, v bigint")
    assert skew.hot_key_modes(empty, "k", "v", 0.01).count() == skew.hot_key_quantiles(empty, "k", "v", 0.01, (0.5,)).count() == 0
    with pytest.raises(ValueError):
        skew.select_ranks(spark.createDataFrame([(1, 1, 1)], "key bigint, value bigint, n bigint"), {1: [2]})
