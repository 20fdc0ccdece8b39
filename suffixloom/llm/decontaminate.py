"""Benchmark decontamination: a broadcast hash set of benchmark word windows, and a scan of all training texts.

A window is ``n`` consecutive words of an item; an item of fewer words is one window.  All windows are
written, with their words and items.  Training texts are scanned once with array operations: each run of
words gets a hash, and those in the broadcast set are candidates.  Candidates are joined with the written
windows by hash and held against them word by word; the spans that remain are merged for each document.

The broadcast set never grows beyond ``set_bytes``: it holds all hashes while they fit, and beyond that it is a
Bloom table of that size, which lets more candidates through to the join and loses none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordScanner, alnum_bytes, cut_words, mix, named, numbered, slices, text_bytes, window_hashes, written

#: Words in a window.
WINDOW = 13
#: Bytes of the broadcast set, at most.
SET_BYTES = 128 << 20
#: Probes of the Bloom table, and bits for each hash in the table that is asked before the hashes themselves.
PROBES, BITS_EACH = 4, 64
#: Windows in a batch while they are made.
BATCH = 8192
#: Places of one repeated word that a row of candidates stands for, at most.
RUN = 4096

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_U = np.uint64


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then maximal runs of digits, a-z and characters over U+007F."""
    return _WORD.findall(text.lower())


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """``h, size, words, item``: each window's hash, number of words, words joined by blanks, and item id as a string.

    Null and wordless texts have none.
    """
    part = benchmark.select(named(item).cast("string").alias("item"), named(text).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner(alnum_bytes())
        for b in slices(batches, "text"):
            for name, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                raw = b" ".join(words_of(t or b""))
                data = np.frombuffer(raw, np.uint8)
                starts, ends, hashes, _ = scanner.scan(data, np.array([0, len(data)]))
                size = min(n, len(starts))
                if not size:
                    continue
                h = window_hashes(hashes, size).view(np.int64)
                for at in range(0, len(h), BATCH):
                    own = h[at : at + BATCH]
                    words = [raw[a:z] for a, z in zip(starts[at : at + len(own)].tolist(), ends[at + size - 1 : at + size - 1 + len(own)].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), size, np.int32)), pa.array(words, pa.binary()), pa.array([name] * len(own), pa.string())], names=["h", "size", "words", "item"])

    return part.mapInArrow(each, "h bigint, size int, words binary, item string")


def _next(h: np.ndarray) -> np.ndarray:
    """The hash whose first bits are the next probe's place in a Bloom table."""
    return mix(h ^ _U(0xA0761D6478BD642F))


def _get(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return table[place >> _U(6)] >> (place & _U(63)) & _U(1) != 0


class HashSet:
    """Hashes of windows: all of them behind a table of bits, or a Bloom table alone."""

    def __init__(self, sizes: list[int], bits: int, table: np.ndarray, known: np.ndarray | None):
        self.sizes, self.bits, self.table, self.known = sizes, bits, table, known

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes that may be in the set (surely, but for the Bloom table)."""
        at = np.flatnonzero(_get(self.table, h >> _U(64 - self.bits)))
        h = h[at]
        if self.known is not None:
            if not len(self.known):
                return at[:0]
            return at[self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h]
        for _ in range(PROBES - 1):
            h = _next(h)
            may = _get(self.table, h >> _U(64 - self.bits))
            at, h = at[may], h[may]
        return at


def hash_set(found: DataFrame, set_bytes: int = SET_BYTES) -> HashSet:
    """The set of the hashes of ``windows``, of ``set_bytes`` bytes at most.  Hashes are counted before any is fetched."""
    sizes = sorted(r[0] for r in found.select("size").distinct().collect())
    hashes = found.select("h").distinct()
    n = hashes.count()
    if n * (8 + BITS_EACH // 8) * 2 <= set_bytes:
        known = np.sort(hashes.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
        bits = max(6, int(n * BITS_EACH).bit_length())
        table = np.zeros(1 << bits - 6, np.uint64)
        place = known >> _U(64 - bits)
        np.bitwise_or.at(table, place >> _U(6), _U(1) << (place & _U(63)))
        return HashSet(sizes, bits, table, known)
    bits = max(6, int(set_bytes * 8).bit_length() - 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.asarray(b.column(0)).view(np.uint64)]
            for _ in range(PROBES - 1):
                h.append(_next(h[-1]))
            place = np.concatenate(h) >> _U(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((place >> _U(6)).astype(np.int64)), pa.array((_U(1) << (place & _U(63))).view(np.int64))], names=["at", "bit"])

    filled = hashes.mapInArrow(each, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[filled.column("at").to_numpy()] = filled.column("word").to_numpy().astype(np.int64).view(np.uint64)
    return HashSet(sizes, bits, table, None)


def _runs(at: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First candidate and number of those that follow each other in one row with one hash (a repeated word), ``RUN`` at most."""
    row = np.searchsorted(bounds, at, side="right") - 1
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(at)])
    n = np.diff(np.r_[new, len(at)])
    parts = -(-n // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(new, parts) + nth * RUN, np.minimum(np.repeat(n, parts) - nth * RUN, RUN)


def scan(docs: DataFrame, known: HashSet) -> DataFrame:
    """``doc, n_words`` for each row of ``docs`` (columns ``doc``, ``text``), and rows ``doc, at, size, n, h, words`` of candidates, whose ``n_words`` is null.

    A candidate is a window of ``size`` words at ``n`` places from ``at`` on that follow each other.  Rows are sent off by
    ``BATCH``, so what a worker holds does not grow with a text's candidates.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("words", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, hashes_of = WordScanner(alnum_bytes()), shared.value
        for b in slices(batches, "text"):
            data, offsets = text_bytes(b.column(1))
            starts, ends, hashes, bounds = scanner.scan(data, offsets)
            lengths = pa.array(np.diff(bounds).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), lengths, *(pa.nulls(b.num_rows, f.type) for f in list(schema)[2:])], schema=schema)
            doc = np.asarray(b.column(0))
            for size in hashes_of.sizes:
                h = window_hashes(hashes, size)
                at = hashes_of.candidates(h)
                row = np.searchsorted(bounds, at, side="right") - 1
                at = at[at + size <= bounds[row + 1]]
                if not len(at):
                    continue
                first, n = _runs(at, h[at], bounds)
                at = at[first]
                for a in range(0, len(at), BATCH):
                    found = []
                    for i, times in zip(at[a : a + BATCH].tolist(), n[a : a + BATCH].tolist(), strict=True):
                        words = words_of(data[starts[i] : ends[i + size + times - 2]].tobytes())
                        if times == 1 or len(set(words)) == 1:
                            found.append((i, times, b" ".join(words[:size])))
                        else:  # one hash of different words
                            found += [(i + t, 1, b" ".join(words[t : t + size])) for t in range(times)]
                    place, times, words = zip(*found, strict=True)
                    place = np.array(place)
                    row = np.searchsorted(bounds, place, side="right") - 1
                    columns = [pa.array(doc[row]), pa.nulls(len(place), pa.int64()), pa.array((place - bounds[row]).astype(np.int32)), pa.array(np.full(len(place), size, np.int32)), pa.array(np.array(times, np.int32)), pa.array(h[place].view(np.int64)), pa.array(words, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc", "text").mapInArrow(each, "doc bigint, n_words bigint, at int, size int, n int, h bigint, words binary")


def _covered(spans: Column) -> Column:
    """Words in spans (``at, size``) that are sorted by their start."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(a["end"], s["at"]))).alias("n"))
    return F.aggregate(spans, begin, step, lambda a: a["n"])


def _measured(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, n: int, set_bytes: int) -> DataFrame:
    """``doc, n_words, n_hit, items, spans`` for each row of ``docs`` (columns ``doc``, a unique long, and ``text``)."""
    # a row for each window, so that a passage which many items and many documents share makes no row for each pair of them
    known = windows(benchmark, item, item_text, n).groupBy("h", "size", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    known = written(known, "windows")
    scanned = written(scan(docs, hash_set(known, set_bytes)), "scanned")
    candidates = scanned.filter("n_words is null").select("doc", "at", "size", "n", "h", "words")
    span = F.struct("at", (F.col("size") + F.col("n") - 1).alias("size"))
    hits = candidates.join(known, ["h", "size", "words"]).groupBy("doc").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("items").alias("items"))
    hits = hits.withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))
    none = F.array().cast("array<string>")
    return scanned.filter("n_words is not null").select("doc", "n_words").join(hits, "doc", "left").select(
        "doc", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", none).alias("items"), "spans"
    )


def find(docs: DataFrame, benchmark: DataFrame, row: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """``row, n_words, n_hit, items`` for each row of ``docs``.

    ``n_hit`` counts the words of the document inside any occurrence of a benchmark window, ``items`` the
    distinct item ids (as strings, sorted) whose windows occur.  Null and wordless texts have no words and
    no hits; wordless items have no windows; an item with a null id hits words but has no id to report;
    repeated items count once.  Rows with null or repeated keys are told apart by a row number.  Empty
    tables are fine on either side.  What is gathered for a document is bounded by its length and its items.
    """
    docs, mark, same = numbered(docs.select(named(row).alias("row"), named(text).cast("string").alias("text")), "row")
    found = _measured(docs.select(named(mark).alias("doc"), "text"), benchmark, item, item_text, n, set_bytes)
    if same:
        return found.select(F.col("doc").alias("row"), "n_words", "n_hit", "items")
    return docs.select(named(mark).alias("doc"), "row").join(found, "doc").select("row", "n_words", "n_hit", "items")


def is_contaminated(n_hit: str, n_words: str) -> Column:
    """At least one word, and at least a twentieth of all words, is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "document", row: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` without contamination, same columns.

    ``document``: contaminated documents go, all others stay as they are.  ``span``: every document stays
    and loses the stretches from the first to the last word of each run of hit words.  Either works at any
    size of the benchmark.  Null keys, repeated rows and empty tables are as in ``find``.
    """
    if mode not in ("document", "span"):
        raise ValueError(mode)
    names = docs.columns
    docs, mark, _ = numbered(docs, row)
    found = _measured(docs.select(named(mark).alias("doc"), named(text).cast("string").alias("text")), benchmark, item, item_text, n, set_bytes)
    if mode == "document":
        gone = written(found.filter(is_contaminated("n_hit", "n_words")).select(F.col("doc").alias(mark)), "contaminated")
        return docs.join(gone, mark, "left_anti").select(*map(named, names))
    spans = F.transform("spans", lambda s: F.struct(s["at"].cast("bigint").alias("start"), s["size"].cast("bigint").alias("n_words")))
    spans = written(found.filter("n_hit > 0").select(F.col("doc").alias(mark), spans.alias("spans")), "spans")
    return cut_words(docs, mark, text, spans, alnum_bytes()).select(*map(named, names))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, words hit by benchmark windows, items that hit, and the verdict."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("row").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated("n_hit", "n_words").alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + least({WINDOW}, len(w)) - 1) AS win
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(win) AS l FROM bw),
dw AS (SELECT doc_id, i, l, list_slice(w, i, i + l - 1) AS win FROM d, lens, unnest(range(1, len(w) - l + 2)) t(i)),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + l)) t(p) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
