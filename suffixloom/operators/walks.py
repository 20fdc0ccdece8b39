"""Scores of single sequences: each sequence is walked along once, under all trees.

A tree has all suffixes of its contexts, so the longest context before a symbol is found by making it longer by a symbol as
long as it is in the tree.  Trees of bounded size are laid out as a table for each depth (by the number of a context) and
broadcast; all places of a batch of sequences go down the depths together, and places whose context ends drop out.  No k-mers
are made and only sums leave a task.  Larger trees are joined with the sequences' k-mers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..config import ALPHABET
from ..functions.estimators import SYMBOLS, probabilities
from ..functions.forms import MOST, packed
from .kmers import cut_rows, even, tallies
from .metrics import log_likelihoods

#: Contexts (of all trees together) that are broadcast at most: 48 bytes each, and what tables of few symbols take.
MOST_CONTEXTS = 500_000
#: Contexts of up to so many symbols are looked up by their number, longer ones by search.
DIRECT = 9
#: Symbols of a row, and of a batch, that are walked at a time.
ROW, BATCH = 1 << 21, 1 << 22


class Layout:
    """One tree: for each depth the sorted numbers of its contexts (or a table of places), and all contexts' log-probabilities."""

    def __init__(self, numbers: np.ndarray, depths: np.ndarray, logs: np.ndarray, max_depth: int):
        order = np.lexsort((numbers, depths))
        numbers, depths, self.logs = numbers[order], depths[order], logs[order]
        bounds = np.searchsorted(depths, np.arange(max_depth + 2))
        self.levels = []
        for d in range(1, max_depth + 1):
            own = numbers[bounds[d] : bounds[d + 1]] - (1 << 2 * d)
            if d <= DIRECT:
                table = np.full(1 << 2 * d, -1, np.int32)
                table[own] = np.arange(bounds[d], bounds[d + 1])
                self.levels.append((table, None, 0))
            else:
                self.levels.append((None, own, int(bounds[d])))

    def places(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of the longest context that ends before each of the symbols ``at``."""
        best = np.zeros(len(at), np.int64)
        live, number = np.arange(len(at)), np.zeros(len(at), np.int64)
        for d, (table, own, first) in enumerate(self.levels, 1):
            number = number | codes[at[live] - d].astype(np.int64) << 2 * (d - 1)
            if table is not None:
                found = table[number]
                good = found >= 0
            else:
                found = np.minimum(np.searchsorted(own, number), max(len(own) - 1, 0))
                good = own[found] == number if len(own) else np.zeros(len(number), bool)
                found = found + first
            live, number = live[good], number[good]
            if not len(live):
                break
            best[live] = found[good]
        return best


def _windows(column: pa.Array, max_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all symbols of some rows, and for each of their windows its last symbol's place and its row."""
    text = column.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64, count=len(text) + 1, offset=8 * text.offset)
    data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]] if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    code = np.full(256, 4, np.uint8)
    for i, c in enumerate(ALPHABET):
        code[[ord(c), ord(c.lower())]] = i
    codes = code[data]
    row = np.repeat(np.arange(len(text)), np.diff(ends))
    n = max(0, len(codes) - max_depth)
    bad = np.r_[0, np.cumsum(codes > 3)]
    good = (bad[max_depth + 1 : n + max_depth + 1] == bad[:n]) & (row[:n] == row[max_depth : n + max_depth])
    start = np.flatnonzero(good)
    return codes, start + max_depth, row[start]


def score_each(sequences: DataFrame, tree: DataFrame, max_depth: int, pseudo_count: float = 1.0, by: list[str] = (), key: list[str] = ("seq_id",), seq: str = "seq", most: int = MOST_CONTEXTS) -> DataFrame:
    """``key, by, n_windows, log_likelihood, nll``: each sequence under each tree.

    ``nll`` is the mean negative log-likelihood in nats of the last symbols of the sequence's windows of ``max_depth + 1`` symbols, each
    under the longest context of the tree before it.  ``by`` are the trees' model columns; ``key`` the sequences'
    columns, rows of one key count together.  Sequences without a window (short or null ones) give no rows.  Up to
    ``most`` contexts are broadcast.
    """
    key, by = list(key), list(by)
    small_enough = max_depth <= MOST and tree.limit(most + 1).count() <= most
    sums = _walked(sequences, tree, max_depth, pseudo_count, by, key, seq) if small_enough else _joined(sequences, tree, max_depth, pseudo_count, by, key, seq)
    sums = sums.groupBy(*key, *by).agg(F.sum("n").alias("n_windows"), F.sum("log_p").alias("log_likelihood"))
    return sums.select(*key, *by, "n_windows", "log_likelihood", (-F.col("log_likelihood") / F.col("n_windows")).alias("nll"))


def _joined(sequences: DataFrame, tree: DataFrame, max_depth: int, pseudo_count: float, by: list[str], key: list[str], seq: str) -> DataFrame:
    """The same sums from a join of k-mers, by sequence, with contexts."""
    counts = tallies(sequences, [max_depth + 1], key, seq).groupBy(*key, "kmer").agg(F.sum("n").alias("count"))
    models = tree.select(*by).distinct() if by else None
    rows = log_likelihoods(counts.crossJoin(models) if by else counts, tree, max_depth, pseudo_count, by, key)
    return rows.select(*key, *by, F.col("count").alias("n"), (F.col("count") * F.col("log_p")).alias("log_p"))


def _walked(sequences: DataFrame, tree: DataFrame, max_depth: int, pseudo_count: float, by: list[str], key: list[str], seq: str) -> DataFrame:
    logs = [F.log(p).alias(f"log_{s}") for s, p in zip(SYMBOLS, probabilities(pseudo_count), strict=True)]
    nodes = packed(tree).select(*by, F.col("context").alias("number"), "depth", *logs).toArrow()  # bounded by ``most``
    models: dict[tuple, list[int]] = {}
    for i, name in enumerate(zip(*(nodes.column(b).to_pylist() for b in by), strict=True) if by else [()] * nodes.num_rows):
        models.setdefault(name, []).append(i)
    numbers, depths = nodes.column("number").to_numpy(), nodes.column("depth").to_numpy()
    values = np.stack([nodes.column(f"log_{s}").to_numpy() for s in SYMBOLS], axis=1) if nodes.num_rows else np.zeros((0, 4))
    layouts = [Layout(numbers[i], depths[i], values[i], max_depth) for i in models.values() if (depths[i] == 0).any()]
    names = [m for m, i in models.items() if (depths[i] == 0).any()]
    shared = sequences.sparkSession.sparkContext.broadcast(layouts)
    most = BATCH
    types = [nodes.schema.field(b).type for b in by]
    rows = cut_rows(even(sequences.select(*key, F.col(seq).alias("seq"))), max_depth + 1, key, ROW)
    plain = rows.toDF(*[f"k{i}" for i in range(len(key))], "seq")
    tree_fields = [StructField(f"m{i}", tree.schema[b].dataType) for i, b in enumerate(by)]
    schema = StructType([*plain.schema.fields[:-1], *tree_fields, StructField("n", LongType()), StructField("log_p", DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(len(key))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                before = lengths[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(lengths, before + most, side="right")))
                yield from scored(batch.slice(first, last - first))
                first = last

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes, at, row = _windows(batch.column(len(key)), max_depth)
        counts = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
        some = pa.array(np.flatnonzero(counts))
        keys = [c.take(some) for c in batch.columns[: len(key)]]
        for name, layout in zip(names, shared.value, strict=True):
            sums = np.bincount(row, weights=layout.logs[layout.places(codes, at), codes[at]], minlength=batch.num_rows).astype(np.float64)
            model = [pa.array([x] * len(some), t) for x, t in zip(name, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, *model, pa.array(counts).take(some), pa.array(sums).take(some)], names=schema.names)

    return plain.mapInArrow(each, schema).toDF(*key, *by, "n", "log_p")
