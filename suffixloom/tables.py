"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH = "suffixloom.scratch.dir"
#: Up to so many rows of a table that is made for it (a few numbers a row) are broadcast.
MOST_BROADCAST = 100_000


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the session's ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made once and remembered in the session, but only if all runs
    on one machine (``local``): on a cluster no machine sees another's folders, so an unset one is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_SCRATCH, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master is {master!r})")
        base = tempfile.mkdtemp(prefix="suffixloom-")
        spark.conf.set(_SCRATCH, base)
    return f"{base.rstrip('/')}/suffixloom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    What stands above is computed once however often the table is read, and a lost executor costs a reread, not a rerun.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, label: str, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, written, with a hint to broadcast it if it has no more than ``most`` rows.  Beyond that a join shuffles."""
    df = written(df, label)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def clean(spark: SparkSession, base: str | None = None) -> int:
    """Delete all intermediate tables in ``base`` (the shared folder), those of other sessions too; returns how many.

    Results that were not written elsewhere or fetched cannot be read afterwards.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_SCRATCH, None)
    if not base:
        return 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "suffixloom-*")) or []
    return sum(files.delete(x.getPath(), True) for x in found)
