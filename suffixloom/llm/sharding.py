"""Sharding by a permutation-filled lookup table.

A table of prime size is filled by the shards in turn: each has its own preference order of all slots
(an offset and a step from its name's hash, which reach every slot as the size is prime) and claims the
first slot of it that is still free.  Slots are shared evenly to within one, and when shards come or go
few slots change hands.  A row's slot is its key's hash modulo the size; the table is joined by
broadcast, so a row is placed by one look-up.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, named

#: Shards and table size that the query uses.  A size of 100 or more slots a shard keeps shares within 1 %.
SHARDS, SIZE = tuple(f"shard-{k:03d}" for k in range(64)), 65537
#: Largest table that is broadcast (16 bytes a slot or so).
MOST_SLOTS = 4_194_301


def is_prime(n: int) -> bool:
    """Trial division; tables are small."""
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _preference(shard: str, size: int) -> tuple[int, int]:
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def fill(shards: list[str] | tuple[str, ...], size: int = SIZE, turns: dict[str, int] | None = None) -> np.ndarray:
    """The number of the shard that holds each slot.

    Shards take turns in the order of their names, whatever order they are given in; ``turns`` gives a
    shard more claims in each round (its weight).  Names must differ; the size must be a prime of at
    least as many slots as there are shards.
    """
    names = sorted(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shards must be named, each once")
    if not is_prime(size) or size < len(names) or size > MOST_SLOTS:
        raise ValueError(f"the size must be a prime from {len(names)} to {MOST_SLOTS}")
    number = {s: i for i, s in enumerate(shards)}
    state = [[number[s], *_preference(s, size), (turns or {}).get(s, 1)] for s in names]
    if any(s[3] < 1 for s in state):
        raise ValueError("each shard takes one turn or more")
    table, free = np.full(size, -1, np.int32), size
    while free:
        for s in state:
            for _ in range(min(s[3], free)):
                while table[s[1]] >= 0:
                    s[1] = (s[1] + s[2]) % size
                table[s[1]] = s[0]
                free -= 1
    return table


def slot_of(keys: list[Column], size: int) -> Column:
    """A key's slot: the first 60 bits of the MD5 of its parts, each with its length, modulo the size.  Null differs from empty."""
    parts = [F.coalesce(F.concat(F.octet_length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("-")) for k in keys]
    return (F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("bigint") % size).cast("int")


def assign(df: DataFrame, keys: list[str], shards: list[str] | tuple[str, ...] = SHARDS, size: int = SIZE, turns: dict[str, int] | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with ``slot`` and ``shard``, and the names these got (an underscore more where ``df`` has them).

    Equal keys go to one shard, null keys too; all rows and columns stay.
    """
    spark = df.sparkSession
    slot = fresh("slot", df.columns)
    shard = fresh("shard", [*df.columns, slot])
    table = spark.createDataFrame([(i, shards[int(s)]) for i, s in enumerate(fill(shards, size, turns))], f"`{slot}` int, `{shard}` string")
    placed = df.withColumn(slot, slot_of([named(k) for k in keys], size))
    names = [named(c) for c in df.columns]
    return placed.join(F.broadcast(table), slot).select(*names, slot, shard), [slot, shard]


def write_shards(df: DataFrame, keys: list[str], path: str, shards: list[str] | tuple[str, ...] = SHARDS, size: int = SIZE, rows_per_file: int = 1_000_000, turns: dict[str, int] | None = None) -> DataFrame:
    """Write Parquet under ``path``, a folder for each shard, and return ``shard, files, rows`` as read from there.

    Rows are rebalanced by shard: where a shard (a hot key, null or not, or one row very often repeated)
    has more than an advisory partition's bytes, its rows are split over several tasks by where they come
    from, whatever they hold.  Columns are written as they are, those of the names ``slot`` and ``shard``
    too; the folders' column is ``shard``, with underscores added where ``df`` has that.  An empty table
    makes no files and no rows.
    """
    spark = df.sparkSession
    placed, (slot, shard) = assign(df, keys, shards, size, turns)
    kept = placed.drop(slot)
    kept.hint("rebalance", F.col(shard)).write.partitionBy(shard).option("maxRecordsPerFile", rows_per_file).parquet(path)
    file = fresh("_file", kept.columns)
    back = spark.read.schema(kept.schema).parquet(path).select(F.col(shard).alias("shard"), F.col("_metadata.file_path").alias(file))
    by_file = back.groupBy("shard", file).count()
    return by_file.groupBy("shard").agg(F.count("*").alias("files"), F.sum("count").alias("rows")).orderBy("shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's slot and shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign(docs, ["doc_id"])[0]
