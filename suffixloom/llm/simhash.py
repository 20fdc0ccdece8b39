"""SimHash near-duplicates: fingerprints of word shingles, linked through pigeonhole blocks.

A fingerprint's 64 bits are cut into ``n`` blocks.  Two fingerprints that differ in
at most ``d`` bits agree in ``n - d`` blocks at least, so each choice of ``n - d``
blocks is a join key and every close pair meets under one of them.  Pairs that meet
are verified by their Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, numbered, slices, written
from .components import components

#: Words in a shingle, seed of the shingle hash, and bits that a link may differ in.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: A block key with more fingerprints than this is dealt out as pairs of tiles of about this size.
TILE = 65536
#: Buckets up to this size are compared by shifting the sorted rows against themselves.
SMALL = 8


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of one text (UTF-8).

    A-Z is lower-cased, words are runs of bytes other than ASCII white space.  A text of
    fewer words than a shingle is one shingle; a text of no words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-1].tolist()]
        pieces = [joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)]
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(pieces), 1 << 16):
        raw = np.frombuffer(b"".join([digest(p, seed) for p in pieces[at : at + (1 << 16)]]), np.uint8)
        total += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(pieces)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, row: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``row, fp`` for each row of ``docs``: the row's key and its fingerprint as a signed long.  Null text has no words."""
    part = docs.select(named(row).alias("row"), named(text).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b.column(1).fill_null("").cast(pa.binary()).to_pylist()
            fp = pa.array([fingerprint(t, shingle, seed) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["row", "fp"])

    kind = part.schema["row"].dataType.simpleString()
    return part.mapInArrow(each, f"row {kind}, fp bigint")


def block_bounds(n_blocks: int) -> list[tuple[int, int]]:
    """First bit and length of each of ``n_blocks`` blocks of 64 bits."""
    at = [64 * i // n_blocks for i in range(n_blocks + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def choose_blocks(n: int, distance: int = DISTANCE) -> int:
    """The least number of blocks at which ``n`` random fingerprints put one or so under each key."""
    for blocks in range(distance + 1, 2 * distance + 4):
        if (blocks - distance) * (64 // blocks) >= np.log2(max(n, 2)):
            break
    return blocks


def block_keys(fp: str, n_blocks: int, distance: int) -> list:
    """A bigint column for each choice of ``n_blocks - distance`` blocks: the choice's number and the blocks' bits."""
    keys, bounds = [], block_bounds(n_blocks)
    for i, chosen in enumerate(combinations(range(n_blocks), n_blocks - distance)):
        key = F.lit(i).cast("bigint")
        for j in chosen:
            at, length = bounds[j]
            key = F.shiftleft(key, length).bitwiseOR(
                F.shiftrightunsigned(F.col(fp), 64 - at - length).bitwiseAND(F.lit((1 << length) - 1))
            )
        keys.append(key)
    return keys


def forest(fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of distinct ``fps`` linked at ``distance`` or less: one search from each node.

    Each node is compared with those not reached yet, so a group of close copies costs
    about one pass and makes one edge for each of its members.
    """
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), x))
                right.append(found)
                front.extend(found)
                rest = rest[~near]
    return left, right


def linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the buckets of rows sorted by key: every close pair is joined by a path of them."""
    left, right = [], []
    new = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1)])
    sizes = np.diff(np.r_[new, len(keys)])
    bucket = np.repeat(np.arange(len(new)), sizes)
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    b, f = bucket[small], fps[small]
    for lag in range(1, SMALL):
        same = (b[lag:] == b[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= distance)
        left.append(f[:-lag][same])
        right.append(f[lag:][same])
    for at in np.flatnonzero(sizes > SMALL):
        x, y = forest(fps[new[at] : new[at] + sizes[at]], distance)
        left += x
        right += y
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def links(groups: DataFrame, n_blocks: int, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Edges ``a, b`` that join every pair of distinct fingerprints ``fp`` at ``distance`` or less by a path.

    Rows meet under block keys.  A key with more than ``tile`` fingerprints is cut into tiles by
    their hash and each pair of tiles is worked on by itself, so no task holds more than two tiles.
    """
    spark = groups.sparkSession
    keyed = groups.select("fp", F.explode(F.array(*block_keys("fp", n_blocks, distance))).alias("key"))
    hot = written(keyed.groupBy("key").count().filter(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "hot")
    if not hot.isEmpty():
        t = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least(t, u).alias("i"), F.greatest(t, u).alias("j")))
        keyed = keyed.join(hot, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).select("fp", "key", F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "fp")
    else:
        keyed = keyed.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = linked(keys, fps, distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(c) for c in batch.columns]
            keys, fps = np.stack([c.astype(np.int64) for c in cols[:3]], axis=1), cols[3].view(np.uint64)
            turn = np.flatnonzero(np.any(keys != keys[-1], axis=1))
            cut = int(turn[-1]) + 1 if len(turn) else 0  # the last bucket may go on in the next batch
            if not cut and held and not np.array_equal(held[-1][0][-1], keys[0]) or cut:
                yield out(np.concatenate([*(k for k, _ in held), keys[:cut]]), np.concatenate([*(f for _, f in held), fps[:cut]]))
                held = []
            held.append((keys[cut:], fps[cut:]))
        if held:
            yield out(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(each, "a bigint, b bigint")


def classes(fps: DataFrame, distance: int = DISTANCE, n_blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """``fp, root, first_row, n`` for each distinct fingerprint of ``fps`` (columns ``row``, ``fp``).

    ``root`` is one fingerprint of the component that links of ``distance`` bits or fewer reach and
    ``first_row`` the least row key of the component.
    """
    groups = written(fps.groupBy("fp").agg(F.min("row").alias("least"), F.count("*").alias("n")), "fingerprints")
    n_blocks = n_blocks or choose_blocks(groups.count(), distance)
    nodes = components(links(groups, n_blocks, distance, tile))
    member = groups.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = member.groupBy("root").agg(F.min("least").alias("first_row"))
    return member.join(first, "root").select("fp", "root", "first_row", "n")


def near_duplicates(docs: DataFrame, row: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``row, fp, root, first_row`` for each row of ``docs``: its fingerprint and its near-duplicate class.

    Documents with null or wordless text share fingerprint 0 and link like any other.  A null row key
    keeps its row; it is never the class's least key unless all keys are null.  Repeated rows each get
    a row.  An empty table gives none.  Columns other than ``row`` and ``text`` are not read.
    """
    fps = written(fingerprints(docs, row, text), "rows")
    return fps.join(written(classes(fps, **options), "classes").drop("n"), "fp").select("row", "fp", "root", "first_row")


def deduplicate(docs: DataFrame, row: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each near-duplicate class is kept: that with the least ``row``.

    Rows that tie (repeated or null keys) are told apart by a row number, so exactly one stays.
    The columns of ``docs`` are returned as they are.
    """
    docs, mark, same = numbered(docs, row)
    if same:
        found = near_duplicates(docs, row, text, **options)
        stay = found.filter(F.col("row") == F.col("first_row")).select(F.col("row").cast("bigint").alias(mark))
    else:
        key = F.struct(named(row).isNull().alias("null"), named(row).alias("id"), named(mark).alias("number"))
        found = near_duplicates(docs.select(key.alias("row"), named(text).alias("text")), "row", "text", **options)
        stay = found.filter(F.col("row.number") == F.col("first_row.number")).select(F.col("row.number").alias(mark))
    return docs.join(stay, mark, "left_semi").drop(mark)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint in hex, and the least ``doc_id`` of its near-duplicate class."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("row").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first_row").alias("component_id"))
