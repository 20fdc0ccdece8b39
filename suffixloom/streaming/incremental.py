"""Counts that grow with new sequences: a stream of sequences into a table of k-mer counts.

Each micro-batch is counted and written to a partition of its own, which a rerun of the batch
overwrites, so counts are exact however often a batch is tried.  Counts have no time and need no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Build
from ..operators.kmers import count_kmers, union_counts
from ..plans.build import tree_from_kmers
from ..tables import written


def fasta_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """FASTA files that arrive in a folder, as a stream of ``seq``."""
    lines = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", max_files).text(path)
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace("value", r"^[^\n]*\n", "")).otherwise("")
    return lines.select(F.regexp_replace(body, r"\s+", "").alias("seq"))


def count_stream(sequences: DataFrame, k: int, table: str, checkpoint: str, by: list[str] = (), seq: str = "seq", trigger: dict | None = None) -> StreamingQuery:
    """Start counting a stream into ``table``; returns the running query.

    ``trigger`` is passed to the stream's trigger and defaults to working off what is there.
    """

    def add(batch: DataFrame, number: int) -> None:
        count_kmers(batch, k, by, seq).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return sequences.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_counts(spark: SparkSession, table: str, by: list[str] = ()) -> DataFrame:
    """The counts of all batches so far, added up."""
    return union_counts(spark.read.parquet(table), by=by)


def compact(spark: SparkSession, table: str, to: str, by: list[str] = ()) -> DataFrame:
    """Write the counts so far as one table without batches, and read it."""
    current_counts(spark, table, by).write.parquet(to)
    return spark.read.parquet(to)


def current_tree(spark: SparkSession, table: str, build: Build, by: list[str] = ()) -> DataFrame:
    """The tree of all sequences so far."""
    return tree_from_kmers(written(current_counts(spark, table, by), "kmers"), build, by)


def live_counts(sequences: DataFrame, k: int, by: list[str] = (), seq: str = "seq") -> DataFrame:
    """Running counts as a streaming aggregate, for output mode ``complete`` or ``update``."""
    return count_kmers(sequences, k, by, seq)
