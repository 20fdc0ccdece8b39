"""What several operators share: batches of bounded size, columns made in Python, word scanning."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..tables import shared_dir, written  # noqa: F401  (for the operators)

#: Texts are worked on in slices of about so many bytes, and so many rows at most.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 512

#: Of the GNU C library; other platforms do without.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

_MULT = 0x9E3779B97F4A7C15
_U = np.uint64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text in each is about ``size`` bytes, or one row, and rows are few enough."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths.astype(np.int64)), 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = min(start + SLICE_ROWS, max(start + 1, int(np.searchsorted(ends, base + size, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop
    tidy()


def tidy() -> None:
    """Give back to the system what a worker no longer uses; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def alnum_bytes() -> np.ndarray:
    """Byte table for words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z was lower-cased; 0 separates."""
    t = np.zeros(256, np.uint8)
    t[0x30:0x3A] = np.arange(0x30, 0x3A)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


def nonspace_bytes() -> np.ndarray:
    """Byte table for words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; 0 separates (a NUL byte counts as 1)."""
    t = np.arange(256).astype(np.uint8)
    t[0] = 1
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordScanner:
    """Finds words in UTF-8 bytes and gives each a 64-bit hash, with array operations only."""

    def __init__(self, table: np.ndarray, step: int = 1 << 19):
        self.table, self.step = table, step
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, self.step + 4096)
            for name, base in (("power", _MULT), ("inverse", pow(_MULT, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, word ends, word hashes, and the n + 1 places at which each row's words begin.

        Equal words have equal hashes.  A row's end ends its last word.
        """
        starts, ends, hashes = [], [], []
        at, total = 0, len(data)
        cuts = offsets[:-1]
        while at < total:
            stop = min(at + self.step, total)
            while stop < total and self.table[data[stop]]:  # to a separator, or the row's end
                row_end = int(offsets[np.searchsorted(offsets, stop)])
                gap = np.flatnonzero(self.table[data[stop : min(row_end, stop + self.step)]] == 0)
                if len(gap):
                    stop += int(gap[0])
                    break
                stop = min(row_end, stop + self.step)
                if stop == row_end:
                    break
            s, e, h = self._piece(data[at:stop], cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, stop)] - at)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h)
            at = stop
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        s = join(starts, np.int64)
        return s, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(s, offsets)

    def _piece(self, data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        self._powers(n + 1)
        low = self.table[data]
        inside = low != 0
        first = np.zeros(n, bool)
        first[row_starts] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        s = np.flatnonzero(inside & (first | ~before))
        last = np.empty(n, bool)
        last[-1] = True
        last[:-1] = first[1:] | ~inside[1:]
        e = np.flatnonzero(inside & last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(low.astype(np.uint64) * self.power[:n], out=sums[1:])
        h = (sums[e] - sums[s]) * self.inverse[s]
        return s, e, mix(h + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words, from the words' hashes; shorter than ``words`` by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= _U(0x9FB21C651E98DF25)
        h += words[i : n + i]
    return mix(h)


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken) -> str:
    """``name``, with underscores added until it is not in ``taken``."""
    while name in taken:
        name += "_"
    return name


def appended(docs: DataFrame, text: str, fields: StructType, each) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns computed in Python from one text column, and the names those columns got.

    ``each(column)`` gets the texts of a slice of rows as a string array and returns one array for each
    of ``fields``.  Rows and all other columns pass through as they are; a new name that ``docs`` has
    already gets an underscore.
    """
    names = docs.columns
    place = names.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    new = []
    for f in fields:
        new.append(fresh(f.name, [*names, *new]))
    schema = StructType([*plain.schema.fields, *[StructField(f"n{i}", f.dataType, True) for i, f in enumerate(fields)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, f"c{place}"):
            made = each(b.column(place))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[f.name for f in schema])

    return plain.mapInArrow(run, schema).toDF(*names, *new), new


def numbered(docs: DataFrame, row: str) -> tuple[DataFrame, str, bool]:
    """``docs`` with a unique long, its column's name, and whether that is ``row`` itself or a written row number."""
    ids = docs.select(named(row).alias("id"))
    mark = fresh("_number", docs.columns)
    if ids.schema["id"].dataType.simpleString() in ("bigint", "int") and ids.groupBy("id").count().filter("id is null or count > 1").isEmpty():
        return docs.withColumn(mark, named(row).cast("bigint")), mark, True
    return written(docs.withColumn(mark, F.monotonically_increasing_id()), "numbered"), mark, False


def without_words(text: bytes, spans: list[tuple[int, int]], scanner: WordScanner) -> bytes:
    """``text`` without ``spans`` (first word, words): each stretch of words that spans cover goes, from its first word to its last."""
    starts, ends, _, _ = scanner.scan(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    gone = np.zeros(len(starts) + 1, np.int64)
    for a, n in spans:
        gone[a] += 1
        gone[min(a + n, len(starts))] -= 1
    edge = np.diff(np.r_[False, np.cumsum(gone[:-1]) > 0, False].astype(np.int8))
    parts, at = [], 0
    for a, b in zip(starts[np.flatnonzero(edge == 1)].tolist(), ends[np.flatnonzero(edge == -1) - 1].tolist(), strict=True):
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def cut_words(docs: DataFrame, mark: str, text: str, spans: DataFrame, table: np.ndarray, drop_empty: bool = False) -> DataFrame:
    """``docs`` with the words in ``spans`` cut out of ``text``; same columns.

    ``spans`` has for a row's ``mark`` an array ``spans`` of ``start, n_words``; rows without are as they were.
    With ``drop_empty`` a row that loses words and has none left goes.  ``table`` says what words are made of.
    """
    names = docs.columns
    place, key = names.index(text), names.index(mark)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    joined = plain.join(spans.select(named(mark).alias(f"c{key}"), F.col("spans").alias("cut")), f"c{key}", "left")
    columns = plain.columns
    joined = joined.select(*columns, "cut")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner(table)
        for b in slices(batches, f"c{place}"):
            cuts = b.column(len(names))
            hit = np.flatnonzero(cuts.is_valid())
            b = b.select(columns)
            if len(hit):
                texts, gone = b.column(place).to_pylist(), np.zeros(b.num_rows, bool)
                for i in hit:
                    left = without_words(texts[i].encode(), [(x["start"], x["n_words"]) for x in cuts[i].as_py()], scanner)
                    texts[i] = left.decode()
                    gone[i] = drop_empty and not table[np.frombuffer(left, np.uint8)].any()
                b = b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type)).filter(pa.array(~gone))
            yield b

    return joined.mapInArrow(each, plain.schema).toDF(*names)
