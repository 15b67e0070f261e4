import json
import os

from echofold import cli
from echofold.sources.store import SnapshotStore


def test_not_a_directory(capsys):
    assert cli.main(["detect", "/nowhere/at/all"]) == 1
    assert "not a directory" in capsys.readouterr().err


def test_detect(spark, tmp_path):
    d, calls = tmp_path / "in", tmp_path / "calls"
    d.mkdir()
    for n in ("a.mp3", "b.mp3", "c.mp3"):
        (d / n).write_bytes(n[:1].encode() * 20)

    def backend(path):
        with open(calls, "a") as f:
            f.write("x")
        return 3.0, list(range(40)) if path[-5] in "ab" else [x * 7919 for x in range(40)]

    store = SnapshotStore(spark, str(tmp_path / "store"))
    read = tmp_path / "read"

    def reader(path, file):
        with open(read, "a") as f:
            f.write("x")
        return 0, 128000, {"title": [path[-5]]}

    for turn in range(2):
        n, result, warnings = cli.detect(spark, str(d), store, reader, backend)
        groups = result.groups.collect()
        assert n == 3 and len(groups) == 1 and groups[0]["n_files"] == 2 and warnings.count() == 0
        assert {os.path.basename(r["path"]): r["duration"] for r in result.members.collect()} == {"a.mp3": 3.0, "b.mp3": 3.0}
        # Each file is read once a run, and fingerprinted once.
        assert len(calls.read_text()) == 3 and len(read.read_text()) == 3 * (turn + 1)


def test_apply(spark, tmp_path, capsys):
    for n in "ab":
        (tmp_path / n).write_text("same")
    groups = [{"tier": "f", "confidence": "high", "score": 1.0, "tag_score": 0.5, "files": [str(tmp_path / "a"), str(tmp_path / "b")], "keep": str(tmp_path / "a")}]
    (tmp_path / "r.json").write_text(json.dumps(groups))
    assert cli.main(["apply", str(tmp_path / "r.json")]) == 0 and "1 would be replaced" in capsys.readouterr().out
    assert cli.main(["apply", "--apply", str(tmp_path / "r.json")]) == 0
    assert os.path.samefile(tmp_path / "a", tmp_path / "b") and (tmp_path / "b.bak").exists()
    (tmp_path / "bad.json").write_text("{")
    assert cli.main(["apply", str(tmp_path / "bad.json")]) == 1
