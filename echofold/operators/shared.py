"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "echofold-tables"


def shared_dir(spark: SparkSession) -> str:
    """Our folder in the one that the cluster names in spark.checkpoint.dir.

    One of our own is made only where none is set and the session is local,
    as in tests; on a cluster it would be another folder on each machine.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="echofold-")
        sc.setCheckpointDir(folder)
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{FOLDER}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once as a table in the shared folder; later plans start from there.

    Unlike checkpoint(), which computes its input twice, this runs the plan
    once, and what is read back is compressed and read by column.  Values
    that depend on where rows lie, such as monotonically_increasing_id(), are
    fixed by it.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove all tables that cut() wrote in this session; DataFrames that read them can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
