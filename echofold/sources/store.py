"""The fingerprint snapshot: parquet folders that are only added, and numbered commits that name them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.operators.index import document_frequency, find_candidates, postings, term_counts
from echofold.schema import CACHE, MIN_SHARED_TERMS, TERM_DF_CAP
from echofold.sources.files import latest

#: Ends a commit file that is whole.
COMPLETE = "complete"
#: Appended folders that are merged at the latest, and commits whose folders stay for readers that are under way.
COMPACT, KEPT = 8, 3


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` without the paths of ``new``, and ``new``; several new rows of a path are reduced by latest()."""
    new = latest(new)
    return old.join(new, "path", "left_anti").select(*new.columns).unionByName(new)


def missing_from_index(cache: DataFrame, indexed: DataFrame) -> DataFrame:
    """Cached paths that the index does not hold."""
    return latest(cache).join(indexed.select("path"), "path", "left_anti")


class SnapshotStore:
    """Readers see the last complete commit; a writer adds a folder with the new rows, then a commit of the next number.

    A commit is a small file that names the folders it is made of, a base and
    what was appended since, and ends in a mark; its number is created once
    and never replaced, so that there is a complete commit at any time and of
    two writers one fails.  After COMPACT folders their rows are merged into
    a new base.  Folders that none of the last KEPT commits names are removed
    then.  ``root`` is a folder that driver and executors share.  An absent
    store reads as an empty table.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        path, fs = self._path("commits")
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit())

    def folders(self, number: int) -> list[str] | None:
        """The folders of a commit, the base first; None if it is not complete."""
        path, fs = self._path(f"commits/{number:012d}")
        stream = fs.open(path)
        try:
            lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()
        return lines[:-1] if lines[-1] == COMPLETE else None

    def current(self) -> tuple[int, list[str]]:
        """(number, folders) of the last complete commit; (0, []) if there is none."""
        for n in reversed(self.commits()):
            folders = self.folders(n)
            if folders is not None:
                return n, folders
        return 0, []

    def _commit(self, number: int, folders: list[str]) -> None:
        path, fs = self._path(f"commits/{number:012d}")
        out = fs.create(path, False)
        out.write(bytearray("\n".join([*folders, COMPLETE]).encode()))
        out.close()

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], CACHE)
        part = lambda f: self.spark.read.schema(CACHE).parquet(f"{self.root}/{f}")
        if len(folders) == 1:
            return part(folders[0])
        rows = None
        for k, f in enumerate(folders):
            x = part(f).withColumn("k", F.lit(k))
            rows = x if rows is None else rows.unionByName(x)
        last = rows.groupBy("path").agg(F.max_by(F.struct("mtime", "duration", "fingerprint"), "k").alias("r"))
        return last.select("path", "r.mtime", "r.duration", "r.fingerprint")

    def read(self) -> DataFrame:
        return self._read(self.current()[1])

    def write(self, new: DataFrame) -> None:
        """Upsert ``new``: only its own rows are written, and every COMPACT times all of them."""
        last = max([0, *self.commits()])
        _, folders = self.current()
        name = f"rows-{uuid.uuid4().hex}"
        latest(new).write.parquet(f"{self.root}/{name}")
        self._commit(last + 1, [*folders, name])
        if len(folders) + 1 > COMPACT:
            self.compact()

    def compact(self) -> None:
        """Merge all rows into one folder and remove what is no longer named."""
        number, folders = self.current()
        name = f"base-{uuid.uuid4().hex}"
        self._read(folders).write.parquet(f"{self.root}/{name}")
        self._commit(number + 1, [name])
        kept = {f for n in self.commits()[-KEPT:] for f in self.folders(n) or ()}
        root, fs = self._path("")
        for n in self.commits()[:-KEPT]:
            fs.delete(self._path(f"commits/{n:012d}")[0], False)
        for f in fs.listStatus(root):
            folder = f.getPath().getName()
            if folder.startswith(("rows-", "base-")) and folder not in kept:
                fs.delete(f.getPath(), True)

    def __len__(self) -> int:
        return self.read().count()

    def postings(self) -> DataFrame:
        return postings(self.read())

    def term_counts(self) -> DataFrame:
        return term_counts(self.postings())

    def document_frequency(self) -> DataFrame:
        """Derived in the plan, so that it can't be stale."""
        return document_frequency(self.postings())

    def find_candidates(self, path: str, terms: DataFrame, min_abs: int = MIN_SHARED_TERMS, cap: int = TERM_DF_CAP) -> DataFrame:
        """(candidate, shared, term_count): cached files behind ``path`` that share enough of ``terms`` (term); see index.find_candidates()."""
        queries = terms.select(F.lit(path).alias("path"), "term")
        return find_candidates(queries, self.postings(), min_abs=min_abs, cap=cap).drop("path")

    def find(self, path: str) -> DataFrame:
        """Point lookup, pushed down to the scan."""
        return self.read().where(F.col("path") == path)
