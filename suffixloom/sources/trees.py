"""Tree tables, their text and CSV forms, and columns of archive records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..functions.symbols import post_order
from ..operators.contexts import NEXT
from ..operators.prune import TREE
from .archives import RECORD, TREE_SCHEMA, decode_records, encode_records


def write_tree(tree: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A tree (or many, with their model columns) as a Parquet table."""
    tree.write.mode(mode).parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """A tree table, its columns checked."""
    tree = spark.read.parquet(path)
    missing = set(TREE) - set(tree.columns)
    if missing:
        raise ValueError(f"{path} is no tree: it has no {sorted(missing)}")
    return tree


def dump_line(float_format: str | None = None) -> Column:
    """A tree row as text: context, count, counts of A, C, G, T, divergence, is_terminal, and 0, parted by blanks.

    The root's line begins with a blank, its context being empty.  Doubles are written with six significant
    digits, as a stream's default is.
    """
    d = F.col("divergence")
    number = F.format_string(float_format, d) if float_format else _six(d)
    flag = F.col("is_terminal").cast("int").cast("string")
    return F.concat_ws(" ", "context", F.col("count").cast("string"), *[F.col(c).cast("string") for c in NEXT], number, flag, F.lit("0"))


@F.pandas_udf(StringType())
def _six(d: pd.Series) -> pd.Series:
    """A double as the printf format %g has it.  The JVM rounds the shortest decimal form and ties up, C the number itself and ties to even."""
    return d.map("{:g}".format)


def dump(tree: DataFrame, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """The tree's lines in post-order, column ``value``; written as text where a path is given."""
    lines = tree.orderBy(post_order(F.col("context"))).select(dump_line().alias("value"))
    if path:
        lines.write.mode(mode).text(path)
    return lines


def write_grid(grid: DataFrame, path: str, mode: str = "append") -> None:
    """Results of a parameter grid as CSV, with the columns and order of that format (its last is always 0)."""
    row = grid.select("n_params", "bic_score", "min_count", "max_depth", "threshold", "log_likelihood", F.lit(0).alias("fifth_percentile_frequency"))
    row.coalesce(1).write.mode(mode).option("header", True).csv(path)


def to_records(tree: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by, record``: each tree row as an archive record."""
    part = tree.select(*by, *TREE)
    schema = StructType([*[part.schema[b] for b in by], StructField("record", BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = encode_records(b)
            records = [data[i : i + RECORD.itemsize] for i in range(0, len(data), RECORD.itemsize)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], pa.array(records, pa.binary())], names=schema.names)

    return part.mapInArrow(each, schema)


def from_records(records: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by`` and the tree rows of archive records."""
    part = records.select(*by, "record")
    schema = StructType([*[part.schema[b] for b in by], *StructType.fromDDL(TREE_SCHEMA).fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = decode_records(b"".join(b.column(len(by)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], *columns.values()], names=schema.names)

    return part.mapInArrow(each, schema)
