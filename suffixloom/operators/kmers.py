"""Fragments, k-mer counts, and their union."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

#: Symbols in a piece that windows are cut from.
PIECE = 4096
#: Bytes of sequence that are counted at a time.
SLICE = 4 << 20
#: Counters that a task holds for all k-mers of one model and length, and in all; beyond that it counts each slice by itself.
DENSE, MOST_DENSE = 1 << 20, 1 << 22
#: Longest k-mer that is counted as one base-4 number where it is read.
LONGEST_CODE = 26
#: Symbols of a minimizer, at most; groups that runs of windows are dealt to by it; windows of a run, at most.
MINIMIZER, GROUPS, RUN = 10, 4096, 4096
#: Symbols of a 64-bit number; longer k-mers are several.
DIGITS = 31
#: Windows that a task has as numbers at once.
AT_ONCE = 1 << 20
#: Symbols of a row; longer sequences (chromosomes) are cut into rows that overlap by one less than a window.
ROW = 1 << 24


def fragments(sequences: DataFrame, k: int, by: list[str] = (), seq: str = "seq") -> DataFrame:
    """``by, fragment``: the maximal runs of ACGT (either case) of ``k`` symbols or more; null sequences have none."""
    runs = F.filter(F.split(F.upper(F.col(seq)), "[^ACGT]+"), lambda x: F.length(x) >= k)
    return sequences.select(*by, F.explode(runs).alias("fragment"))


def _split_bytes(spark) -> int:
    """``spark.sql.files.maxPartitionBytes`` as a number."""
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 128 << 20


def even(sequences: DataFrame) -> DataFrame:
    """Deal out rows evenly where the input is in fewer files than there are cores and holds less than one full split for each.

    A stream, and what is not read from files, stays as it is; so does any larger input, whose splits keep all cores busy.
    """
    spark = sequences.sparkSession
    if sequences.isStreaming:
        return sequences
    cores, files = spark.sparkContext.defaultParallelism, sequences.inputFiles()
    if not files or len(files) >= cores:
        return sequences
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0  # lengths only: contents are not read
    return sequences.repartition(cores) if size < cores * _split_bytes(spark) else sequences


def cut_rows(rows: DataFrame, most: int, by: list[str] = (), size: int = 0) -> DataFrame:
    """``by, seq`` with sequences of more than ``size`` symbols cut; a piece goes on for ``most - 1`` symbols into the next.

    Windows of up to ``most`` symbols that start in the first ``size`` symbols of a row are those of the whole.
    """
    size = size or ROW
    n = F.length("seq")
    starts = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    pieces = F.transform(starts, lambda i: F.substring("seq", i * size + 1, F.lit(size + most - 1)))
    return rows.select(*by, F.explode(F.when(n > size, pieces).otherwise(F.array("seq"))).alias("seq"))


def count_kmers(sequences: DataFrame, k: int, by: list[str] = (), seq: str = "seq", spread: int | None = None) -> DataFrame:
    """``by, kmer, count``: how often each run of ``k`` ACGT symbols occurs, strands apart, windows over other symbols left out.

    Windows are counted where they are read, so what is shuffled is bounded by the distinct k-mers.
    """
    return count_all(sequences, [k], by, seq, spread).drop("k")


def count_packed(sequences: DataFrame, k: int, by: list[str] = (), seq: str = "seq", spread: int | None = None) -> DataFrame:
    """``by, kmer, count`` with k-mers as packed numbers, of at most ``LONGEST_CODE`` symbols."""
    if k > LONGEST_CODE:
        raise ValueError(f"k must be at most {LONGEST_CODE}")
    if 4**k > DENSE:
        counts = count_runs(sequences, k, by, seq, spread).withColumnRenamed("c0", "code").withColumnRenamed("n", "count")
    else:
        counts = code_tallies(sequences, [k], by, seq, spread)
        counts = counts.groupBy(*counts.columns[:-1]).agg(F.sum("n").alias("count"))
    return counts.select(*[F.col(f"b{i}").alias(b) for i, b in enumerate(by)], (F.col("code") + F.lit(4**k).cast("bigint")).alias("kmer"), "count")


def count_all(sequences: DataFrame, ks: list[int], by: list[str] = (), seq: str = "seq", spread: int | None = None) -> DataFrame:
    """``by, k, kmer, count`` for several lengths.

    Lengths of which a task holds a counter for each k-mer are counted in one pass over the sequences, as base-4 numbers over
    whole Arrow batches; expressions alone (``count_windows``) take about ten times as long for a window.  Each greater length
    is a pass of its own, in which runs of windows are shuffled (``count_runs``).
    """
    if not ks or min(ks) < 1:
        raise ValueError("k must be 1 or more")
    few, parts = [k for k in sorted(set(ks)) if 4**k <= DENSE], []
    many = [k for k in sorted(set(ks)) if 4**k > DENSE]
    if few:
        counts = code_tallies(sequences, few, by, seq, spread)
        counts = counts.groupBy(*counts.columns[:-1]).agg(F.sum("n").alias("count"))
        parts.append(counts.select(*[F.col(f"b{i}").alias(b) for i, b in enumerate(by)], "k", _letters().alias("kmer"), "count"))
    for k in many:
        kmer = F.concat(*[_letters(F.col(f"c{i}"), F.lit(n)) for i, n in enumerate(_digits(k))])
        parts.append(count_runs(sequences, k, by, seq, spread).select(*[F.col(f"b{i}").alias(b) for i, b in enumerate(by)], F.lit(k).alias("k"), kmer.alias("kmer"), F.col("n").alias("count")))
    return reduce(DataFrame.unionByName, parts)


def _letters(code: Column | None = None, k: Column | None = None) -> Column:
    """The k-mer of a base-4 ``code`` of ``k`` digits."""
    code, k = (F.col("code") if code is None else code), (F.col("k") if k is None else k)
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, F.lit("0")), "0123", "ACGT")


def tallies(sequences: DataFrame, ks: list[int], by: list[str] = (), seq: str = "seq") -> DataFrame:
    """``by, k, kmer, n``: what each task counted, not added up yet (a stream may have one aggregation only).  ``k`` is at most ``LONGEST_CODE``."""
    return code_tallies(sequences, ks, by, seq).select(*[F.col(f"b{i}").alias(b) for i, b in enumerate(by)], "k", _letters().alias("kmer"), "n")


def code_tallies(sequences: DataFrame, ks: list[int], by: list[str] = (), seq: str = "seq", spread: int | None = None) -> DataFrame:
    """``b0, b1 ..., k, code, n``: the same with model columns by place, and k-mers as base-4 numbers."""
    if not ks or min(ks) < 1 or max(ks) > LONGEST_CODE:
        raise ValueError(f"k must be from 1 to {LONGEST_CODE}")
    rows, limit = cut_rows(sequences.select(*by, F.col(seq).alias("seq")), max(ks), list(by)), ROW
    rows = rows.repartition(spread) if spread else even(rows)
    ks, by = sorted(set(ks)), list(by)
    keys = [rows.schema[b] for b in by]
    plain = rows.toDF(*[f"b{i}" for i in range(len(by))], "seq")
    schema = StructType([*[StructField(f"b{i}", f.dataType) for i, f in enumerate(keys)], StructField("k", IntegerType()), StructField("code", LongType()), StructField("n", LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(len(by), ks, limit)
        for b in batches:
            yield from tally.add(b)
        yield from tally.flush()

    return plain.mapInArrow(each, schema)


class _Tally:
    """Counts base-4 codes of windows, by model: those that start in the first ``limit`` symbols of a row."""

    def __init__(self, n_by: int, ks: list[int], limit: int):
        self.n_by, self.ks, self.limit = n_by, ks, limit
        self.code = np.full(256, 4, np.uint8)
        for i, c in enumerate("ACGT"):
            self.code[[ord(c), ord(c.lower())]] = i
        self.dense: dict[tuple, np.ndarray] = {}
        self.held = 0
        self.types: list[pa.DataType] = []

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.types = [c.type for c in batch.columns[: self.n_by]]
        models = list(zip(*[c.to_pylist() for c in batch.columns[: self.n_by]], strict=True)) if self.n_by else [()] * batch.num_rows
        text = batch.column(self.n_by).cast(pa.large_binary())
        at = np.frombuffer(text.buffers()[1], np.int64, count=len(text) + 1, offset=8 * text.offset) if len(text) else np.zeros(1, np.int64)
        data = text.buffers()[2] if len(text) else None
        data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        number: dict[tuple, int] = {}
        model = np.fromiter((number.setdefault(m, len(number)) for m in models), np.int64, len(models))
        known = list(number)
        most, cut = max(self.ks), len(at) > 1 and np.diff(at).max() > self.limit
        for begin in range(0, len(data), SLICE):
            stop = min(len(data), begin + SLICE)
            codes = self.code[data[begin : min(len(data), stop + most - 1)]]
            first, last = np.searchsorted(at, [begin, begin + len(codes) - 1], side="right") - 1
            own = np.arange(first, last + 1)
            row = np.repeat(own, np.minimum(at[own + 1], begin + len(codes)) - np.maximum(at[own], begin))
            bad = np.r_[0, np.cumsum(codes > 3)]

            def good(k: int) -> np.ndarray:
                """Which windows of ``k`` symbols that start in the slice are whole."""
                n = max(min(stop - begin, len(codes) - k + 1), 0)
                whole = (bad[k : n + k] == bad[:n]) & (row[:n] == row[k - 1 : n + k - 1])
                if cut:
                    whole &= np.arange(begin, begin + n) - at[row[:n]] < self.limit
                return whole

            yield from self._slice(codes, good, model[row], known)

    def _slice(self, codes: np.ndarray, good: Callable[[int], np.ndarray], model: np.ndarray, known: list[tuple]) -> Iterator[pa.RecordBatch]:
        value = {1: codes.astype(np.int64) & 3}
        for k in self.ks:
            whole = good(k)
            if len(whole):
                yield from self._count(k, self._codes(value, k)[: len(whole)][whole], model[: len(whole)][whole], known)

    @staticmethod
    def _codes(value: dict[int, np.ndarray], k: int) -> np.ndarray:
        """Codes of all windows of ``k`` symbols, put together from those of half the length."""
        if k not in value:
            a = k // 2
            left, right = _Tally._codes(value, k - a), _Tally._codes(value, a)
            value[k] = (left[: len(right) - (k - a)] << 2 * a) | right[k - a :]
        return value[k]

    def _count(self, k: int, codes: np.ndarray, model: np.ndarray, known: list[tuple]) -> Iterator[pa.RecordBatch]:
        space = 4**k
        if space <= DENSE and len(known) * space <= MOST_DENSE:
            counts = np.bincount(model * space + codes, minlength=len(known) * space).reshape(len(known), space)
            for m, row in zip(known, counts, strict=True):
                if (m, k) in self.dense:
                    self.dense[m, k] += row
                elif row.any():
                    if self.held + space > MOST_DENSE:
                        yield from self.flush()
                    self.dense[m, k] = row.copy()
                    self.held += space
            return
        order = np.argsort(model, kind="stable") if len(known) > 1 else None
        bounds = np.searchsorted(model[order], np.arange(len(known) + 1)) if order is not None else [0, len(codes)]
        for i, m in enumerate(known):
            found, n = np.unique(codes[order[bounds[i] : bounds[i + 1]]] if order is not None else codes, return_counts=True)
            if len(found):
                yield self._batch([(m, k, found, n)])

    def flush(self) -> Iterator[pa.RecordBatch]:
        parts = [(m, k, np.flatnonzero(row), row[row > 0]) for (m, k), row in self.dense.items()]
        self.dense, self.held = {}, 0
        for i in range(0, len(parts), 64):
            yield self._batch(parts[i : i + 64])

    def _batch(self, parts: list[tuple]) -> pa.RecordBatch:
        sizes = [len(p[2]) for p in parts]
        which = pa.array(np.repeat(np.arange(len(parts)), sizes))
        cols = [pa.array([p[0][i] for p in parts], self.types[i]).take(which) for i in range(self.n_by)]
        cols += [pa.array(np.repeat([p[1] for p in parts], sizes).astype(np.int32)), *(pa.array(np.concatenate([p[j] for p in parts]).astype(np.int64)) for j in (2, 3))]
        return pa.RecordBatch.from_arrays(cols, names=[*[f"b{i}" for i in range(self.n_by)], "k", "code", "n"])


def count_runs(sequences: DataFrame, k: int, by: list[str] = (), seq: str = "seq", spread: int | None = None) -> DataFrame:
    """``b0, b1 ..., c0, c1 ..., n``: k-mers of any length from 2, as base-4 numbers of ``_digits(k)`` symbols, with their counts.

    Windows that follow each other and have the same minimizer (of their m-mers that with the least hash) are shuffled as one run,
    four symbols a byte, so a window takes about a byte and not its ``k`` symbols.  Equal k-mers have equal minimizers and meet in
    a group.  A task goes through its groups in order and counts them by sorting, ``AT_ONCE`` windows at a time; what it
    holds on to are the distinct k-mers of one group and model.
    """
    rows = cut_rows(sequences.select(*by, F.col(seq).alias("seq")), k, list(by))
    rows, limit, n_by, m = rows.repartition(spread) if spread else even(rows), ROW, len(by), max(1, min(MINIMIZER, k // 2))
    keys = [StructField(f"b{i}", rows.schema[b].dataType) for i, b in enumerate(by)]
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(n_by, [k], limit, m)
        for b in batches:
            yield from runs.add(b)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _RunCounter(n_by, k)
        for b in batches:
            yield from counter.add(b)
        yield from counter.flush()

    found = rows.toDF(*[f"b{i}" for i in range(n_by)], "seq").mapInArrow(cut, StructType([*keys, StructField("part", IntegerType()), StructField("sizes", BinaryType()), StructField("data", BinaryType())]))
    order = [*[f.name for f in keys], "part"]
    dealt = found.repartition(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(each, StructType([*keys, *[StructField(f"c{i}", LongType()) for i in range(len(_digits(k)))], StructField("n", LongType())]))


def _digits(k: int) -> list[int]:
    """Symbols of each number of a k-mer."""
    return [min(DIGITS, k - i) for i in range(0, k, DIGITS)]


class _Runs(_Tally):
    """Runs of windows that have the same minimizer, by model and group."""

    def __init__(self, n_by: int, ks: list[int], limit: int, m: int):
        super().__init__(n_by, ks, limit)
        self.m = m

    def _slice(self, codes: np.ndarray, good: Callable[[int], np.ndarray], model: np.ndarray, known: list[tuple]) -> Iterator[pa.RecordBatch]:
        k, whole = self.ks[0], good(self.ks[0])
        if not whole.any():
            return
        n, codes = len(whole), codes & 3
        # an odd factor keeps different m-mers apart
        low = (self._codes({1: codes.astype(np.uint32)}, self.m) ^ np.uint32(0x2C1B3C6D)) * np.uint32(0x9E3779B1)
        low ^= low >> np.uint32(15)
        low = _least(low, k - self.m + 1)[:n]
        new = whole & np.r_[True, ~whole[:-1] | (low[1:] != low[:-1])]
        start = np.flatnonzero(new)
        size = np.add.reduceat(whole, start, dtype=np.int64)
        if size.max() > RUN:
            pieces = -(-size // RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, size = np.repeat(start, pieces) + RUN * nth, np.minimum(np.repeat(size, pieces) - RUN * nth, RUN)
        key = model[start] * GROUPS + (low[start] * np.uint32(0x85EBCA6B) >> np.uint32(8)) % np.uint32(GROUPS)
        by = np.argsort(key, kind="stable")
        key, start, size = key[by], start[by], size[by]
        n_bytes = (size + k + 2) // 4
        four = np.r_[codes, np.zeros(6, np.uint8)]
        four = four[:-3] << 6 | four[1:-2] << 4 | four[2:-1] << 2 | four[3:]
        ends = np.cumsum(n_bytes)
        data = four[np.repeat(start - 4 * (ends - n_bytes), n_bytes) + 4 * np.arange(ends[-1])]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        which = pa.array(key[first] // GROUPS)
        cols = [pa.array([x[i] for x in known], self.types[i]).take(which) for i in range(self.n_by)]
        sizes = _binary(size.astype(np.uint16), 2 * np.r_[first, len(size)])
        yield pa.RecordBatch.from_arrays([*cols, pa.array((key[first] % GROUPS).astype(np.int32)), sizes, _binary(data, np.r_[0, ends][np.r_[first, len(size)]])], names=[*[f"b{i}" for i in range(self.n_by)], "part", "sizes", "data"])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` elements in a row, from those of half as many."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row's begin and end."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1, offset=8 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


#: The four symbols of a byte.
_UNPACK = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3).astype(np.uint8)


class _RunCounter:
    """Counts the windows of runs that come sorted by model and group."""

    def __init__(self, n_by: int, k: int):
        self.n_by, self.k = n_by, k
        self.types: list[pa.DataType] = []
        self.model: tuple | None = None
        self.part = -1
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.held: tuple[list[np.ndarray], np.ndarray] | None = None

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        self.types = [c.type for c in batch.columns[: self.n_by]]
        models = list(zip(*[c.to_pylist() for c in batch.columns[: self.n_by]], strict=True)) if self.n_by else [()] * batch.num_rows
        part = np.asarray(batch.column(self.n_by))
        (sizes, size_at), (data, data_at) = _bytes(batch.column(self.n_by + 1)), _bytes(batch.column(self.n_by + 2))
        sizes = np.frombuffer(sizes.tobytes(), np.uint16).astype(np.int64)
        size_at = size_at // 2
        windows = np.r_[0, np.cumsum(sizes)][size_at]
        turns = [0, *(i for i in range(1, len(models)) if models[i] != models[i - 1]), len(models)]
        for a, z in zip(turns[:-1], turns[1:], strict=True):
            if models[a] != self.model:
                yield from self.flush()
                self.model = models[a]
            while a < z:
                b = min(z, max(a + 1, int(np.searchsorted(windows, windows[a] + AT_ONCE, side="right")) - 1))
                last = a + int(np.searchsorted(part[a:b], part[b - 1]))  # the last group may go on
                for lo, hi in ((a, last), (last, b)):
                    if lo == hi:
                        continue
                    done = part[lo] != self.part
                    if self.waiting and self.waiting + windows[hi] - windows[lo] > AT_ONCE:
                        self._settle()
                    if done and self.held is not None:
                        yield from self.flush()
                    self.runs.append((sizes[size_at[lo] : size_at[hi]], data[data_at[lo] : data_at[hi]]))
                    self.waiting += int(windows[hi] - windows[lo])
                    self.part = part[hi - 1]
                a = b

    def _settle(self) -> None:
        """Make counts of the runs that wait, added to those held."""
        size, data = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        self.runs, self.waiting = [], 0
        n_bytes = (size + self.k + 2) // 4
        start = 4 * (np.cumsum(n_bytes) - n_bytes)
        symbols = _UNPACK[data].ravel()
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        digits, codes = _digits(self.k), []
        value = {1: symbols.astype(np.int64)}
        for i, n in enumerate(digits):
            codes.append(_Tally._codes(value, n)[at + DIGITS * i])
        n = np.ones(len(at), np.int64)
        if self.held is not None:
            codes, n = [np.concatenate(x) for x in zip(self.held[0], codes, strict=True)], np.r_[self.held[1], n]
        if len(codes) == 1 and self.held is None:
            found, n = np.unique(codes[0], return_counts=True)
            self.held = [found], n
            return
        by = np.lexsort(codes[::-1]) if len(codes) > 1 else np.argsort(codes[0])
        codes = [c[by] for c in codes]
        first = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in codes])])
        self.held = [c[first] for c in codes], np.add.reduceat(n[by], first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The counts of all groups so far, which are complete."""
        if self.waiting:
            self._settle()
        if self.held is not None:
            (codes, n), self.held = self.held, None
            same = pa.array(np.zeros(len(n), np.int32))
            cols = [pa.array([x], t).take(same) for x, t in zip(self.model, self.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, codes), pa.array(n)], names=[*[f"b{i}" for i in range(self.n_by)], *[f"c{i}" for i in range(len(codes))], "n"])
        self.part = -1


def count_windows(sequences: DataFrame, ks: list[int], by: list[str] = (), seq: str = "seq", size: int = PIECE) -> DataFrame:
    """The same counts in expressions only, for any length: windows are cut out as bytes, exploded and grouped."""
    most = max(ks)
    raw = F.encode("fragment", "US-ASCII")
    found = fragments(sequences, min(ks), list(by), seq).select(*by, raw.alias("raw"))
    # a piece holds the windows that start in its first ``size`` symbols; bytes are cut, so a cut costs what it copies
    cut = found.select(*by, "raw", F.explode(F.sequence(F.lit(1), F.octet_length("raw"), F.lit(size))).alias("at")).select(*by, F.substring("raw", F.col("at"), F.lit(size + most - 1)).alias("piece"))
    windows = []
    for k in sorted(set(ks)):
        n = F.least(F.lit(size), F.octet_length("piece") - (k - 1))
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        windows.append(F.transform(starts, _window(k)))
    rows = cut.select(*by, F.explode(F.concat(*windows) if len(windows) > 1 else windows[0]).alias("w"))
    counts = rows.groupBy(*by, "w").agg(F.count("*").alias("count"))
    return counts.select(*by, F.octet_length("w").alias("k"), F.decode("w", "US-ASCII").alias("kmer"), "count")


def _window(k: int):
    """The ``k`` bytes of a piece that begin at a place."""
    return lambda at: F.substring(F.col("piece"), at, F.lit(k))


def union_counts(*tables: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by, kmer, count``: counts of the same k-mer in any of the tables added up (null counts add nothing)."""
    if not tables:
        raise ValueError("nothing to unite")
    whole = tables[0].select(*by, "kmer", "count")
    for t in tables[1:]:
        whole = whole.unionByName(t.select(*by, "kmer", "count"))
    return whole.groupBy(*by, "kmer").agg(F.coalesce(F.sum("count"), F.lit(0).cast("bigint")).alias("count"))
