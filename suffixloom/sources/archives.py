"""Tree archives as a data source: records of 89 bytes, read by ranges of bytes and written by ranges of the order.

    spark.dataSource.register(ContextArchive)
    spark.read.format("contextarchive").load("trees/*.bintree")

A path is a file, a folder of parts, or a glob, of any file system that pyarrow knows.  Records have one size, so a file
is cut where records begin and each range is a task of its own.  Written archives are folders of parts: the
tree is dealt by ranges of its order, each task writes its range to a file of its own, and when all are
done the parts are checked to follow each other and named in that order.  Where one file is wanted, tasks copy the parts to their
places in it, which are known, as records have one size.  The driver handles names and sizes, never records.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.symbols import post_order
from ..operators.prune import TREE
from ..tables import written

# One record of a tree archive, little-endian, 89 bytes, without padding.  Bases are packed
# two bits each (A 0, C 1, G 2, T 3) from the high end of four 64-bit words.
RECORD = np.dtype([("bases", "<u8", 4), ("length", "<u4"), ("n_words", "<u4"), ("count", "<u8"), ("next", "<u8", 4), ("divergence", "<f8"), ("is_terminal", "u1")])
MOST_BASES, WORD_BASES = 128, 32
TREE_SCHEMA = "context string, depth int, n_a bigint, n_c bigint, n_g bigint, n_t bigint, count bigint, divergence double, is_terminal boolean"
NAME = "contextarchive"
#: Bytes of a range, and records that are decoded at a time.
SPLIT, CHUNK = 64 << 20, 1 << 15
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_CODES = np.full(256, 255, np.uint8)
_CODES[_LETTERS] = np.arange(4)
_SHIFTS = np.arange(62, -2, -2, dtype=np.uint64)


def strings(letters: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The first ``lengths[i]`` of each row of a matrix of letters, as strings."""
    inside = np.arange(letters.shape[1]) < lengths[:, None]
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(letters[inside]))


def decode_records(data) -> dict[str, pa.Array]:
    """Columns of a tree from an archive's bytes."""
    if len(data) % RECORD.itemsize:
        raise ValueError("the archive ends inside a record")
    r = np.frombuffer(data, RECORD)
    if len(r) and r["length"].max() > MOST_BASES:
        raise ValueError(f"a record says that it has {r['length'].max()} symbols; this is no archive, or it is damaged")
    words = max(1, -(-int(r["length"].max(initial=0)) // WORD_BASES))
    codes = ((r["bases"][:, :words, None] >> _SHIFTS) & np.uint64(3)).astype(np.uint8).reshape(len(r), words * WORD_BASES)
    columns = [strings(_LETTERS[codes], r["length"]), r["length"].astype(np.int32), *r["next"].astype(np.int64).T, r["count"].astype(np.int64), r["divergence"], r["is_terminal"].astype(bool)]
    return {n: c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for n, c in zip(TREE, columns, strict=True)}


def encode_records(batch: pa.RecordBatch) -> bytes:
    """An archive's bytes from a tree's rows (columns by name), in the order given."""
    columns = dict(zip(batch.schema.names, batch.columns, strict=True))
    context = columns["context"].cast(pa.large_binary())
    n = len(context)
    at = np.frombuffer(context.buffers()[1], np.int64, count=n + 1, offset=8 * context.offset) if n else np.zeros(1, np.int64)
    data = context.buffers()[2] if n else None
    codes = _CODES[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(at)
    if n and lengths.max() > MOST_BASES:
        raise ValueError(f"a context of {lengths.max()} symbols does not fit an archive record")
    if codes.size and codes.max() > 3:
        raise ValueError("a context has a symbol that is none of A, C, G and T")
    bases = np.zeros((n, MOST_BASES), np.uint64)
    bases[np.arange(MOST_BASES) < lengths[:, None]] = codes
    r = np.zeros(n, RECORD)
    r["bases"] = (bases.reshape(n, 4, WORD_BASES) << _SHIFTS).sum(axis=2, dtype=np.uint64)
    r["length"], r["n_words"] = lengths, np.maximum(1, -(-lengths // WORD_BASES))
    number = lambda c: columns[c].to_numpy(zero_copy_only=False)
    r["count"], r["divergence"], r["is_terminal"] = number("count"), number("divergence"), number("is_terminal")
    r["next"] = np.stack([number(c) for c in TREE[2:6]], axis=1)
    return r.tobytes()


def _where(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[fs.FileInfo]:
    """Files of an archive in order of their names; those that begin with ``_`` or ``.`` do not count."""
    at, name = _where(path)
    glob = any(c in name for c in "*?[")
    folder = name.rstrip("/").rpartition("/")[0] if glob else name
    info = at.get_file_info(folder or ".")
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path} is not there")
    found = [info] if info.is_file else at.get_file_info(fs.FileSelector(folder or ".", recursive=True))
    wanted = lambda f: f.is_file and (info.is_file or not any(x[:1] in "_." for x in f.path[len(folder) :].strip("/").split("/")))
    return sorted((f for f in found if wanted(f) and (not glob or fnmatch(f.path, name))), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    """Bytes of a file from ``start`` to ``stop``, both where records begin or end."""

    file: str
    start: int
    stop: int


class ContextArchive(DataSource):
    """Options: ``splitBytes``, about so many bytes are a task's."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"file string, {TREE_SCHEMA}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = set(TREE) - set(schema.names)
        if missing:
            raise ValueError(f"this is no tree: it has no {sorted(missing)}")
        return ArchiveWriter(self.options["path"], overwrite)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = max(1, int(options.get("splitBytes", SPLIT)) // RECORD.itemsize) * RECORD.itemsize

    def partitions(self) -> list[Range]:
        found = []
        for f in _files(self.path):
            if f.size % RECORD.itemsize:
                raise ValueError(f"the archive {f.path} ends inside a record")
            found += [Range(f.path, at, min(f.size, at + self.step)) for at in range(0, f.size, self.step)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        with _where(self.path)[0].open_input_file(partition.file) as f:
            f.seek(partition.start)
            left = partition.stop - partition.start
            while left:
                data = f.read(min(left, CHUNK * RECORD.itemsize))
                if not data:
                    raise ValueError(f"{partition.file} ends before byte {partition.stop}")
                left -= len(data)
                columns = decode_records(data)
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(columns["context"]), pa.string()), *columns.values()], names=["file", *TREE])


@dataclass
class Part(WriterCommitMessage):
    """A part that a task wrote: its place, file, and first and last context."""

    place: int
    file: str
    records: int
    first: str
    last: str


def _order(context: str) -> tuple:
    """Sorts as the post-order does: by the reversed context, falling."""
    return tuple(-ord(c) for c in reversed(context)) + (1,)


class ArchiveWriter(DataSourceArrowWriter):
    """Tasks write parts into a folder that readers do not see; a commit names them in order, an abort deletes them."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_parts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        at, name = _where(self.path)
        context = TaskContext.get()
        place, attempt = context.partitionId(), context.taskAttemptId()
        at.create_dir(f"{name}/{self.job}", recursive=True)
        file, records, first, last = f"{name}/{self.job}/{place}-{attempt}", 0, "", ""
        with at.open_output_stream(file) as f:
            for b in batches:
                if b.num_rows:
                    f.write(encode_records(b))
                    column = b.column(b.schema.get_field_index("context"))
                    first, last = first if records else column[0].as_py(), column[b.num_rows - 1].as_py()
                    records += b.num_rows
        return Part(place, file, records, first, last)

    def commit(self, messages: list[Part | None]) -> None:
        at, name = _where(self.path)
        parts = sorted((m for m in messages if m and m.records), key=lambda m: m.place)
        for a, b in zip(parts, parts[1:], strict=False):
            if _order(a.last) > _order(b.first):
                self.abort(messages)
                raise ValueError("rows are not in post-order; write_archive orders them")
        old = [f.path for f in _files(self.path)] if self.overwrite else []
        first = 0 if self.overwrite else len(_files(self.path))
        for path in old:
            at.delete_file(path)
        for i, p in enumerate(parts, first):
            at.move(p.file, f"{name}/part-{i:06}.bintree")
        self.abort(messages)  # what failed attempts left

    def abort(self, messages: list[Part | None]) -> None:
        at, name = _where(self.path)
        if at.get_file_info(f"{name}/{self.job}").type == fs.FileType.Directory:
            at.delete_dir(f"{name}/{self.job}")


def read_archive(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """Trees from archive files, a task for every ``split_bytes`` bytes; a column ``file`` says which file a row is from."""
    spark.dataSource.register(ContextArchive)
    return spark.read.format(NAME).option("splitBytes", split_bytes).load(path)


def write_archive(tree: DataFrame, path: str, ranges: int | None = None) -> None:
    """One tree as an archive in post-order, over what was there: a folder of parts, or one file where ``path`` ends in ``.bintree``.

    Tasks write ``ranges`` ranges of the order (default: as many as shuffles have).  One file needs a folder that is mounted where executors run;
    on other file systems give a folder's name.  An empty tree makes an empty archive.
    """
    spark = tree.sparkSession
    tree = written(tree.select(*TREE), "tree")  # ranges are drawn from a sample of it
    order = post_order(F.col("context"))
    spark.dataSource.register(ContextArchive)
    one = path.endswith(".bintree")
    at, name = _where(path)
    if one and not isinstance(at, fs.LocalFileSystem):
        raise ValueError(f"{path}: one file can be written in parallel only where it can be written at any place; give a folder's name")
    folder = f"{path}.parts-{uuid.uuid4().hex}" if one else path
    dealt = tree.repartitionByRange(ranges, order) if ranges else tree.repartitionByRange(order)
    at.create_dir(_where(folder)[1], recursive=True)
    dealt.sortWithinPartitions(order).write.format(NAME).mode("overwrite").save(folder)
    if one:
        _in_one(spark, folder, name)
        at.delete_dir(_where(folder)[1])


def _in_one(spark: SparkSession, folder: str, name: str) -> None:
    """Copy the parts in ``folder`` to their places in one file, a part a task; a task that is tried again writes the same bytes."""
    parts, start = [], 0
    for f in _files(folder):
        parts.append((f.path, start))
        start += f.size
    new = f"{name}.new-{uuid.uuid4().hex}"
    with open(new, "wb") as f:
        f.truncate(start)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open(path, "rb") as source, open(new, "r+b") as target:
                    target.seek(to)
                    while data := source.read(CHUNK * RECORD.itemsize):
                        target.write(data)
            yield b

    if parts:
        spark.createDataFrame(parts, "path string, start bigint").repartition(len(parts)).mapInArrow(copied, "path string, start bigint").count()
    os.replace(new, name)
