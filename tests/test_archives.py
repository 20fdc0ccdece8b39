"""Archives: the record format, ranges of bytes, parts in order, and what is refused."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from suffixloom.sources import archives as A

COLUMNS = ["context", "depth", "n_a", "n_c", "n_g", "n_t", "count", "divergence", "is_terminal"]


def some(n, seed, longest=128):
    rng = random.Random(seed)
    contexts = {"".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 3, 5, 9, 31, 32, 33, 64, 65, longest]))) for _ in range(n)} | {""}
    rows = []
    for c in sorted(contexts):
        counts = [rng.randrange(1 << rng.choice([3, 20, 62])) for _ in range(4)]
        rows.append((c, len(c), *counts, min(sum(counts), (1 << 63) - 1), rng.choice([-1.0, rng.uniform(0, 1e6)]), rng.random() < 0.5))
    return rows


def got(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_records_are_those_of_the_format():
    batch = pa.RecordBatch.from_pylist([dict(zip(COLUMNS, ("GT", 2, 1, 2, 3, 4, 10, 0.5, True), strict=True))])
    data = A.encode_records(batch)
    want = (0b1011 << 60).to_bytes(8, "little") + bytes(24) + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + (10).to_bytes(8, "little")
    want += b"".join(n.to_bytes(8, "little") for n in (1, 2, 3, 4)) + bytes.fromhex("000000000000e03f") + b"\x01"
    assert data == want and len(data) == 89


def test_round_trip_of_records():
    rows = some(500, 1)
    batch = pa.RecordBatch.from_pylist([dict(zip(COLUMNS, r, strict=True)) for r in rows])
    for b in (batch, batch.slice(100, 50), batch.slice(0, 0)):
        back = A.decode_records(A.encode_records(b))
        assert list(zip(*(c.to_pylist() for c in back.values()), strict=True)) == [tuple(r.values()) for r in b.to_pylist()]
    for bad in ("A" * 129, "ACGN"):
        with pytest.raises(ValueError):
            A.encode_records(pa.RecordBatch.from_pylist([dict(zip(COLUMNS, (bad, len(bad), 0, 0, 0, 0, 0, 0.0, False), strict=True))]))
    for bad in (b"x" * 90, b"\xff" * 89):
        with pytest.raises(ValueError):
            A.decode_records(bad)


@pytest.mark.parametrize("name", ["folder", "one.bintree"])
def test_written_in_ranges_and_read_in_ranges(spark, tmp_path, name):
    rows, path = some(3000, 2), str(tmp_path / name)
    tree = spark.createDataFrame(rows, A.TREE_SCHEMA)
    for _ in range(2):  # over what was there
        A.write_archive(tree, path, ranges=5)
        assert got(A.read_archive(spark, path)) == sorted(rows)
    files = [f.path for f in A._files(path)]
    assert len(files) == (1 if name.endswith("bintree") else 5) and sorted(os.listdir(tmp_path)) == [name]
    stored = b"".join(open(f, "rb").read() for f in files)
    assert len(stored) == 89 * len(rows)
    order = A.decode_records(stored)["context"].to_pylist()
    assert order == sorted(order, key=lambda c: c[::-1], reverse=True) and order[-1] == ""
    parts = A.read_archive(spark, path, split_bytes=89 * 100)
    assert parts.rdd.getNumPartitions() == sum(-(-os.path.getsize(f) // 8900) for f in files)
    sizes = [r["n"] for r in parts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) == 100 and got(parts) == sorted(rows)


def test_a_sparse_file_of_many_records_is_many_tasks(spark, tmp_path):
    """A file of 100 million records (8.9 GB, all zero bytes, which the file system does not store) is cut without being read."""
    path = str(tmp_path / "big.bintree")
    with open(path, "wb") as f:
        f.truncate(89 * 100_000_000)
    ranges = A.ArchiveReader({"path": path}).partitions()
    assert len(ranges) == -(-100_000_000 // ((64 << 20) // 89)) and ranges[0].start == 0 and ranges[-1].stop == 89 * 100_000_000
    assert all(a.stop == b.start and b.start % 89 == 0 for a, b in zip(ranges, ranges[1:], strict=False))
    last = next(A.ArchiveReader({"path": path}).read(ranges[-1]))
    assert last.num_rows == min(A.CHUNK, (ranges[-1].stop - ranges[-1].start) // 89) and set(last.column(1).to_pylist()) == {""}


def test_globs_and_empty_archives(spark, tmp_path):
    a, b = some(20, 3), some(30, 4)
    A.write_archive(spark.createDataFrame(a, A.TREE_SCHEMA), f"{tmp_path}/a.bintree")
    A.write_archive(spark.createDataFrame(b, A.TREE_SCHEMA), f"{tmp_path}/b.bintree")
    both = A.read_archive(spark, f"{tmp_path}/*.bintree")
    assert got(both) == sorted(a + b) and {os.path.basename(r.file) for r in both.select("file").distinct().collect()} == {"a.bintree", "b.bintree"}
    A.write_archive(spark.createDataFrame([], A.TREE_SCHEMA), f"{tmp_path}/none.bintree")
    A.write_archive(spark.createDataFrame([], A.TREE_SCHEMA), f"{tmp_path}/none")
    assert os.path.getsize(f"{tmp_path}/none.bintree") == 0
    assert got(A.read_archive(spark, f"{tmp_path}/none.bintree")) == got(A.read_archive(spark, f"{tmp_path}/none")) == []


def test_what_is_refused(spark, tmp_path):
    tree = spark.createDataFrame([("A", 1, 1, 0, 0, 0, 1, 0.5, True), ("C", 1, 1, 0, 0, 0, 1, 0.5, True)], A.TREE_SCHEMA)
    spark.dataSource.register(A.ContextArchive)
    (tmp_path / "x").mkdir()
    with pytest.raises(Exception, match="post-order"):
        tree.repartitionByRange(2, "context").sortWithinPartitions("context").write.format(A.NAME).mode("append").save(f"{tmp_path}/x")
    assert os.listdir(tmp_path / "x") == []
    with pytest.raises(Exception, match="is no tree"):
        tree.drop("count").write.format(A.NAME).mode("append").save(f"{tmp_path}/x")
    (tmp_path / "cut.bintree").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="inside a record"):
        A.read_archive(spark, f"{tmp_path}/cut.bintree").collect()
    with pytest.raises(Exception, match="not there"):
        A.read_archive(spark, f"{tmp_path}/nowhere").collect()
