import contextlib
import json
import os

import pytest
from pyspark.sql import functions as F

from echofold.sources import files as src
from echofold.sources import report
from echofold.sources.store import SnapshotStore
from echofold.streaming import ingest

CACHE = "path string, mtime double, duration double, fingerprint array<int>"


def put(path, size=10):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"x" * size)


def test_scan(spark, tmp_path):
    d = str(tmp_path)
    for name, size in (("a.mp3", 100), ("s/b.MP3", 100), ("c.txt", 100), ("d.flac", 99), ("s/.e.mp3", 100)):
        put(f"{d}/{name}", size)
    names = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    assert names(src.scan_listing(spark, d, 100)) == ["a.mp3", "b.MP3"]
    assert names(src.scan_listing(spark, d, 100, hidden=True)) == [".e.mp3", "a.mp3", "b.MP3"]

    def reader(path, file):
        assert file.read(2) == b"xx"
        if path.endswith("MP3"):
            raise ValueError
        return None if path.endswith("flac") else (None, 320, {"title": [" T "], "album": None})

    rows = src.scan(spark, d, reader, 1).collect()
    assert sorted((os.path.basename(r["path"]), r["duration"], r["bitrate"], tuple(r["tags"])) for r in rows) == [(n, 0.0, 320, ("T", "", "", "")) for n in (".e.mp3", "a.mp3")]
    assert sorted(r["path"] for r in src.walk(spark, d).collect()) == sorted(f"{d}/{n}" for n in ("a.mp3", "s/b.MP3", "c.txt", "d.flac", "s/.e.mp3"))
    assert src.walk(spark, f"{d}/none").count() == 0


def test_freshness(spark):
    files = spark.createDataFrame([("a", 10.0, 0.0), ("b", 10.0, 10.0), ("c", 10.0, None), ("d", None, 1.0), ("e", 1.0, 1.0)], "path string, mtime double, duration double")
    cache = spark.createDataFrame([("a", 10.999, 12.5, [1]), ("b", 11.0, 12.5, [2]), ("c", 10.0, 12.5, None), ("d", 1.0, 1.0, [3])], CACHE)
    got = {r["path"]: (r["hit"], r["duration"]) for r in src.split_fresh(files, cache).collect()}
    assert got == {"a": (True, 12.5), "b": (False, 10.0), "c": (True, 12.5), "d": (False, 1.0), "e": (False, 1.0)}
    assert not any(r["hit"] for r in src.split_fresh(files, cache, force_refresh=True).collect())


def test_ensure_fingerprints(spark):
    files = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 0.0), ("c", 1.0, 5.0)], "path string, mtime double, duration double")
    cache = spark.createDataFrame([("a", 1.0, 7.0, [1])], CACHE)
    backend = lambda path: None if path == "b" else (9.0, [4294967291])
    done, new, warned = src.ensure_fingerprints(files, cache, src.first_of([lambda p: None, backend]))
    assert {r["path"]: (r["duration"], r["fingerprint"]) for r in done.collect()} == {"a": (7.0, [1]), "b": (0.0, None), "c": (5.0, [-5])}
    assert [r["path"] for r in new.collect()] == ["c"] and [r["path"] for r in warned.collect()] == ["b"]
    gone = lambda path: "no such file" if path in "ab" else None
    done, new, warned = src.ensure_fingerprints(files, cache, lambda p: (9.0, [4294967291]), why_not=gone)
    assert {r["path"]: r["fingerprint"] for r in done.collect()} == {"a": None, "b": None, "c": [-5]} and new.count() == 1
    assert sorted(tuple(r) for r in warned.collect()) == [(p, "file became inaccessible: no such file") for p in "ab"]
    _, new, warned = src.ensure_fingerprints(files, cache, lambda p: (9.0, [1]), force_refresh=True, why_not=gone)
    assert new.count() == 3 and warned.count() == 0
    assert "No such file" in src.unreachable("/nowhere") and src.unreachable("/") is None
    _, _, warned = src.ensure_fingerprints(files, cache, lambda p: None)
    assert [(r["path"], r["reason"]) for r in warned.collect()] == [(None, "no fingerprinting backend available")]


def test_first_of():
    assert src.first_of([lambda p: (0.0, []), lambda p: (1.0, [1])])("x") == (0.0, [])
    assert src.fpcalc_backend("/nowhere") is None and src.library_backend("/nowhere") is None


def test_whole_samples():
    assert list(src.whole_samples([b"abc", b"", b"d", b"efghi"], 4)) == [b"abcd", b"efgh"]
    assert list(src.whole_samples([], 4)) == []


def test_pcm_backend():
    @contextlib.contextmanager
    def decoder(path):
        if path == "broken":
            raise OSError
        yield src.Pcm(44100, 2, 1.5, [b"abcde", b"fgh", b"ij"])

    call = src.pcm_backend(decoder, lambda sound, blocks: [len(b) for b in blocks] + [sound.rate])
    assert call("x") == (1.5, [4, 4, 44100]) and call("broken") is None


def test_program_backend(tmp_path):
    (tmp_path / "p").write_text('#!/bin/sh\n[ "$3" = /x/y ] && echo \'{"duration": 2, "fingerprint": [1, 4294967295]}\'')
    (tmp_path / "p").chmod(0o755)
    make = lambda name: src.program_backend(lambda: name, ("-raw", "-json"), src._said_in_json)
    assert make(str(tmp_path / "p"))("/x/y") == (2.0, [1, 4294967295])
    assert make(str(tmp_path / "p"))("/other") is None and make("/no/program")("/x/y") is None and make(None)("/x/y") is None


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert len(store) == 0
    rows = lambda *r: spark.createDataFrame(list(r), CACHE)
    store.write(rows(("a", 1.0, 1.0, [1]), ("b", 1.0, 1.0, [2])))
    store.write(rows(("a", 2.0, 2.0, [3]), ("a", 1.5, 9.0, [4]), ("c", 1.0, 1.0, None)))
    assert {r["path"]: r["fingerprint"] for r in store.read().collect()} == {"a": [3], "b": [2], "c": None}
    assert {r["path"]: r["term_count"] for r in store.term_counts().collect()} == {"a": 4, "b": 4}
    assert store.find("b").count() == 1 and len(store) == 3


def test_store_commits(spark, tmp_path):
    """An incomplete commit is passed over, numbers are never taken twice, and merging keeps the rows and removes old folders."""
    store = SnapshotStore(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(list(r), CACHE)
    store.write(rows(("a", 1.0, 1.0, [1])))
    (tmp_path / "store/commits/000000000002").write_text("rows-of-a-writer-that-died")
    assert len(store) == 1
    with pytest.raises(Exception):
        store._commit(1, [])
    for i in range(9):
        store.write(rows(("a", 2.0 + i, 1.0, [i]), (f"b{i}", 1.0, 1.0, [i])))
    assert {r["path"]: r["fingerprint"] for r in store.read().collect()} == {"a": [8]} | {f"b{i}": [i] for i in range(9)}
    assert len(store.current()[1]) <= 3
    for _ in range(3):
        store.compact()
    assert len(store) == 10 and not [x for x in os.listdir(tmp_path / "store") if x.startswith("rows-")]


def test_store_find_candidates(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    frames = lambda lo: list(range(lo << 8, (lo + 60) << 8, 256))
    store.write(spark.createDataFrame([("b", 1.0, 1.0, frames(0)), ("c", 1.0, 1.0, frames(50)), ("a", 1.0, 1.0, frames(0)), ("z", 1.0, 1.0, None)], CACHE))
    terms = store.postings().where("path = 'b'").select("term")
    got = [tuple(r) for r in store.find_candidates("b", terms).collect()]
    shared = len({r["term"] for r in terms.collect()} & {r["term"] for r in store.postings().where("path = 'c'").collect()})
    assert got == [("c", shared, store.postings().where("path = 'c'").count())] and shared >= 20
    assert store.find_candidates("b", terms.limit(0)).count() == 0 and store.find_candidates("b", terms, cap=1).count() == 0


def test_stream(spark, tmp_path):
    d = str(tmp_path / "in")
    put(f"{d}/a.mp3")
    store, calls = SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "calls")

    def backend(path):
        with open(calls, "a") as f:
            f.write(os.path.basename(path) + "\n")
        return 1.0, [1, 2]

    for name in (None, "b.mp3"):
        if name:
            put(f"{d}/{name}")
        ingest.start(ingest.listing_stream(spark, d), store, backend, str(tmp_path / "cp")).awaitTermination(60)
    assert len(store) == 2
    assert sorted(set(open(calls).read().split())) == ["a.mp3", "b.mp3"]


REPORT = "tier string, confidence string, score double, tag_score double, files array<string>, keep string"


def test_report_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("fingerprint", "high", 0.9, 0.5, ["é", "b"], "b")], REPORT)
    report.write_json(rows, str(tmp_path / "lines"))
    assert report.read_json(spark, str(tmp_path / "lines"), multi_line=False).collect() == rows.collect()
    (tmp_path / "pretty.json").write_text(text := report.pretty_json(rows))
    assert "é" in text and json.loads(text)[0]["keep"] == "b"
    assert report.read_json(spark, str(tmp_path / "pretty.json")).collect() == rows.collect()
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception):
        report.read_json(spark, str(tmp_path / "bad.json")).collect()


def test_text_report(spark):
    groups = spark.createDataFrame([("g", 2, 0.9, 0.6, "high")], "group string, n_files bigint, score double, tag_score double, confidence string")
    members = spark.createDataFrame([("g", "/x/a.mp3", 2048, 65.0, 100, (None, "Z"), 1), ("g", "/x/b.mp3", 4096, 60.0, 50, ("T", None), 2)], "group string, path string, size bigint, duration double, bitrate int, tags struct<title:string,artist:string>, scan_ord bigint")
    rows = report.report_rows(groups, members)
    said = report.text_report(7, rows, members)
    assert "Scanned: 7 files  |  Found: 1" in said and "a.mp3 – Z  [1:05]" in said and "2 KB  ← keep" in said and "HIGH CONFIDENCE — Fingerprint Verified  (1 groups)" in said and "Total potential savings: ~4 KB" in said and said.index("b.mp3") < said.index("/x/a.mp3")
    warnings = spark.createDataFrame([("p", "unsupported or corrupt audio data"), (None, "no fingerprinting backend available")], "path string, reason string")
    said = report.text_report(7, rows, members, warnings)
    assert "[!] Skipped fingerprinting p — unsupported" in said and "\n[!] no fingerprinting" in said
    assert report.report_summary(members, rows).first()["savings"] == 4096


def test_apply(spark, tmp_path):
    d = str(tmp_path)
    for n in "abc":
        put(f"{d}/{n}", 3)
    put(f"{d}/b.bak")
    rows = [("f", "high", 1.0, 0.0, [f"{d}/a", f"{d}/b", f"{d}/gone"], f"{d}/a"), ("f", "high", 1.0, 0.0, ["x", "y", "z"], None), ("f", "high", 1.0, 0.0, ["p", "q", "r"], "r")]
    there = spark.createDataFrame([(f"{d}/{n}",) for n in "abc"], "path string")
    plan = report.apply_plan(spark.createDataFrame(rows, REPORT), there)
    assert {r["status"]: r["n"] for r in report.apply_counts(plan).collect()} == {"done": 1, "skip": 6}
    report.apply_on_driver(plan, apply=False)
    assert not os.path.samefile(f"{d}/a", f"{d}/b")
    report.apply_on_driver(plan, apply=True)
    assert os.path.samefile(f"{d}/a", f"{d}/b") and os.path.exists(f"{d}/b.bak.1")
    assert report.apply_pair(f"{d}/b", f"{d}/a", apply=True) == ("skip", "already linked")


def test_apply_rolls_back(tmp_path, monkeypatch):
    for n in "ab":
        put(f"{tmp_path}/{n}")
    monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(OSError("no")))
    assert report.apply_pair(f"{tmp_path}/b", f"{tmp_path}/a", apply=True)[0] == "fail"
    assert os.path.exists(f"{tmp_path}/b") and not os.path.exists(f"{tmp_path}/b.bak")


def test_latest_breaks_ties(spark):
    rows = [("a", 1.0, 2.0, [1]), ("a", 1.0, 2.0, [2]), ("a", 1.0, None, [9]), (None, 1.0, 1.0, [1]), ("b", None, None, None)]
    got = src.latest(spark.createDataFrame(rows, CACHE).withColumn("r", F.lit(1)))
    assert {r["path"]: r["fingerprint"] for r in got.collect()} == {"a": [2], "b": None}


def test_numbered(spark):
    rows = [("x" if i % 7 else "y", i * 31 % 5000, i) for i in range(5000)]
    got = report.numbered(spark.createDataFrame(rows, "c string, o bigint, i bigint").repartition(5), "c", "o").collect()
    want = {}
    for c in "xy":
        want |= {i: n for n, (_, i) in enumerate(sorted((o, i) for k, o, i in rows if k == c), 1)}
    assert {r["i"]: r["number"] for r in got} == want
    assert report.numbered(spark.createDataFrame([], "c string, o bigint"), "c", "o").count() == 0
