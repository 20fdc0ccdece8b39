"""The roll-up of k-mer counts in one pass over sorted k-mers.

K-mers are dealt by ranges of their order and sorted, so all that begin with a context stand together.  Going through a range once, a
context is complete when its prefix changes, and each level is made from the next longer one.  Only contexts that
the ends of a stretch cut (at most two a depth) meet others in a shuffle and are added up there.  So the
k-mers themselves are what is shuffled, once, and not each of them for every depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.estimators import SYMBOLS
from ..functions.forms import MOST, Packed, form
from ..tables import written

_NEXT = [f"n_{s}" for s in SYMBOLS]
#: K-mers that are gone through at a time.
STRETCH = 1 << 18
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_CODES = np.zeros(256, np.uint8)
_CODES[_LETTERS] = np.arange(4)


def roll_up_sorted(kmers: DataFrame, max_depth: int, by: list[str] = (), enough: Column | None = None, as_packed: bool = False) -> DataFrame:
    """The rows of ``roll_up``, from distinct k-mers of ``max_depth + 1`` symbols (strings, or packed numbers).

    ``enough``, a condition on count and depth, leaves contexts out early.  ``as_packed`` gives packed contexts.
    """
    if as_packed and max_depth > MOST:
        raise ValueError(f"packed contexts have at most {MOST} symbols")
    by, numbers = list(by), form(kmers, "kmer") is Packed
    plain = kmers.select(*by, "kmer", "count").toDF(*[f"b{i}" for i in range(len(by))], "kmer", "count")  # ranges are drawn from a sample: what made it is shuffled already, or stored
    keys = plain.columns[:-1]
    dealt = plain.repartitionByRange(*keys).sortWithinPartitions(*keys)
    models = plain.schema.fields[: len(by)]
    schema = StructType([*[StructField(f.name, f.dataType) for f in models], StructField("context", LongType() if as_packed else StringType()), StructField("depth", IntegerType()), *[StructField(c, LongType()) for c in [*_NEXT, "count"]], StructField("cut", BooleanType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= STRETCH:
                yield from _stretch(pa.Table.from_batches(held).combine_chunks(), len(by), max_depth, numbers, as_packed, schema.names)
                held, n = [], 0
        if n:
            yield from _stretch(pa.Table.from_batches(held).combine_chunks(), len(by), max_depth, numbers, as_packed, schema.names)

    rows = dealt.mapInArrow(each, schema).toDF(*by, *schema.names[len(by) :])
    rows = written(rows if enough is None else rows.filter(F.col("cut") | (F.col("depth") == 0) | enough), "rolled")
    merged = rows.filter("cut").groupBy(*by, "context", "depth").agg(*[F.sum(c).alias(c) for c in [*_NEXT, "count"]])
    if enough is not None:
        merged = merged.filter((F.col("depth") == 0) | enough)
    columns = [*by, "context", "depth", *_NEXT, "count"]
    return rows.filter("not cut").select(columns).unionByName(merged.select(columns))


def _codes(kmer: pa.Array, k: int, numbers: bool) -> np.ndarray:
    """A row of ``k`` codes for each k-mer."""
    if numbers:
        shifts = np.arange(2 * (k - 1), -2, -2, dtype=np.int64)
        return ((kmer.to_numpy()[:, None] >> shifts) & 3).astype(np.uint8)
    text = kmer.cast(pa.large_binary())
    at = np.frombuffer(text.buffers()[1], np.int64, count=len(text) + 1, offset=8 * text.offset)
    data = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]]
    if len(data) != k * len(text):
        raise ValueError(f"a k-mer has not {k} symbols")
    return _CODES[data].reshape(-1, k)


def _stretch(rows: pa.Table, n_by: int, max_depth: int, numbers: bool, as_packed: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch of contexts for each depth, from sorted k-mers."""
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
    models = columns[:n_by]
    codes = _codes(columns[n_by], max_depth + 1, numbers)
    n = len(codes)
    # in how many first symbols a row equals the one before; -1 where its model is another
    differs = codes[1:] != codes[:-1]
    alike = np.r_[-1, np.where(differs.any(axis=1), differs.argmax(axis=1), max_depth + 1)]
    for m in models:
        number = m.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        alike[1:][number[1:] != number[:-1]] = -1
    start, count = np.arange(n), columns[n_by + 1].to_numpy()
    value = np.zeros(n, np.int64)
    if as_packed:
        for d in range(max_depth + 1):
            value = value << 2 | codes[:, d]
    for d in range(max_depth, -1, -1):
        first = alike[start] < d
        place = np.cumsum(first) - 1
        nexts = np.zeros((place[-1] + 1, 4), np.int64)
        np.add.at(nexts, (place, codes[start, d]), count)  # one row a symbol, unless k-mers repeat
        start = start[first]
        count = nexts.sum(axis=1)
        cut = np.zeros(len(start), bool)
        cut[[0, -1]] = True
        if as_packed:
            context = pa.array((value[start] >> 2 * (max_depth + 1 - d)) | (1 << 2 * d))
        else:
            ends = np.arange(len(start) + 1, dtype=np.int32) * d
            context = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_LETTERS[codes[start, :d]])))
        where = pa.array(start)
        yield pa.RecordBatch.from_arrays([*(m.take(where) for m in models), context, pa.array(np.full(len(start), d, np.int32)), *(pa.array(np.ascontiguousarray(nexts[:, i])) for i in range(4)), pa.array(count), pa.array(cut)], names=names)
