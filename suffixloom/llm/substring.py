"""Substring deduplication: seeds shared between documents, chained in order and aligned.

1. Seeds: of every ``window`` consecutive runs of ``k`` words, that with the least hash (a run of
   ``window + k - 1`` equal words always holds an equal seed).
2. Each seed is joined with its first occurrence in the corpus, so a passage that ``n`` documents share
   gives ``n - 1`` links to one place and not all pairs.
3. The links of a pair of documents are chained: ordered on both sides, gaps cost, best predecessor
   from a Fenwick tree.
4. The words around each chain are fetched from both documents and aligned; stretches in which at
   least ``similarity`` of the five-word shingles agree, and that are long enough, are passages.
5. Where seeds follow each other and no passage came of it, their first occurrences may be in other,
   shorter places: there, all runs of ``min_words`` words and all pairs of neighbouring seeds are joined with
   their first occurrences, and each seed with its occurrence in the document before and with one picked by
   hash, chained and aligned likewise.  So every exact repeat of so many words is found.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordScanner, cut_words, mix, named, nonspace_bytes, numbered, slices, text_bytes, window_hashes, written

#: Words of a seed, and seeds of which one is taken.  Every run of K + WINDOW - 1 = 16 equal words holds a seed: a
#: passage of 51 words or more at 0.8 has such a run, since each break in it costs 4 five-word shingles or more
#: (the weakest has 60 shingles, three breaks and four runs of 12 shingles).
K, WINDOW = 8, 9
#: A passage has at least so many words, and so great a share of equal shingles of so many words.
MIN_WORDS, SHINGLE, SIMILARITY = 51, 5, 0.8
#: Bytes of text whose seeds are made at once; a worker holds some twenty arrays of its words.
SEED_BYTES = 1 << 20
#: What a word of gap costs, in words, on either side; seeds on one diagonal and this near are one anchor.
GAP_COST, NEAR = 0.1, 25
#: Words fetched before and after a chain: more than a passage, so one seed is enough to find it; a quarter of the
#: chain is added, as at 0.8 a passage may have a gap of that length.
PAD = 60
#: Up to so many pairs of equal shingles between two anchors, all are looked at.
MOST_MATCHES = 1 << 16
#: Words of chains that are aligned at once.
ALIGN_WORDS = 1 << 17
#: Runs of words in a batch while they are made.
BATCH = 1 << 16
#: A document asked for more passages than this gets its requests dealt over several tasks.
HOT_REQUESTS = 500
#: Up to so many documents that passages are asked of, their keys are broadcast, so that no other texts are shuffled.
MOST_KEYS = 1_000_000

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill) -> np.ndarray:
    """``op`` over each run of ``w`` elements: two passes whatever ``w`` is."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, fill, x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, w)
    head = op.accumulate(padded, axis=1).ravel()
    tail = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def minimizers(hashes: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places that start a seed, and the seeds' hashes.  Row ``r`` has the words ``bounds[r]:bounds[r + 1]``."""
    h = window_hashes(hashes, k)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), h
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    rows = np.flatnonzero(counts)
    first, counts = bounds[:-1][rows], counts[rows]
    valid = np.zeros(n + 1, np.int64)
    np.add.at(valid, first, 1)
    np.add.at(valid, first + counts, -1)
    valid = np.cumsum(valid[:n]) > 0
    h = np.where(valid, h, _MAX)
    chosen = np.zeros(n, bool)
    if n >= window:
        low = _slide(h, window, np.minimum, _MAX)
        whole = np.zeros(len(low) + 1, np.int64)  # windows inside one row
        long = counts >= window
        np.add.at(whole, first[long], 1)
        np.add.at(whole, first[long] + counts[long] - window + 1, -1)
        low = np.where(np.cumsum(whole[:-1]) > 0, low, np.uint64(0))
        pad = np.zeros(window - 1, np.uint64)
        chosen = _slide(np.concatenate([pad, low, pad]), window, np.maximum, np.uint64(0)) == h
    short = counts < window
    for a, c in zip(first[short].tolist(), counts[short].tolist(), strict=True):
        chosen[a + int(np.argmin(h[a : a + c]))] = True
    at = np.flatnonzero(chosen & valid)
    # the same seed again and again (one word repeated) is taken once in each window
    new = np.r_[True, (h[at][1:] != h[at][:-1]) | (np.diff(at) >= window)][: len(at)]
    nth = (at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]) // window if len(at) else at
    at = at[new | np.r_[True, np.diff(nth) > 0][: len(at)]]
    return at, h[at]


def long_runs(hashes: np.ndarray, bounds: np.ndarray, least: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, ``step`` apart, from which one word is repeated ``least`` times or more, and a hash of that word.

    A run's ordinary seeds point to the first run of that word in the corpus, which may be a short one;
    these point to the first that is long enough to be a passage.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), hashes
    new = np.r_[True, hashes[1:] != hashes[:-1]]
    new[bounds[:-1][bounds[:-1] < n]] = True
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, n])
    long = np.flatnonzero(length >= least)
    at = [np.arange(start[i], start[i] + length[i] - least + 1, step) for i in long]
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    return at, mix(hashes[at] ^ np.uint64(0xA5A5A5A55A5A5A5A))


def seeds(docs: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """``h, doc, pos`` for each seed of ``docs`` (columns ``doc``, ``text``); ``pos`` counts words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner(nonspace_bytes())
        for b in slices(batches, "text", SEED_BYTES):
            data, offsets = text_bytes(b.column(1))
            _, _, hashes, bounds = scanner.scan(data, offsets)
            at, h = (np.concatenate(x) for x in zip(minimizers(hashes, bounds, k, window), long_runs(hashes, bounds, max(k, min_words), window), strict=True))
            row = np.searchsorted(bounds, at, side="right") - 1
            doc = np.asarray(b.column(0))[row]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc), pa.array((at - bounds[row]).astype(np.int32))], names=["h", "doc", "pos"])

    return docs.select("doc", "text").mapInArrow(each, "h bigint, doc bigint, pos int")


def links(docs: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """``h, doc, src, pos, spos``: each seed that several documents have, and its first occurrence (``doc = src``: in the first)."""
    return _to_first(written(seeds(docs, k, window, min_words), "seeds"))


def _to_first(found: DataFrame, *keep: str) -> DataFrame:
    """``h, doc, src, pos, spos`` and the columns ``keep`` for each row of ``found`` (``h, doc, pos``) whose ``h`` several documents have.

    First occurrences are written, so both sides of the join are plain tables and a seed that very many documents have can be split over tasks."""
    first = found.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last")).filter(F.col("last") > F.col("first.doc"))
    first = written(first.select("h", F.col("first.doc").alias("src"), F.col("first.pos").alias("spos")), "first")
    return found.join(first, "h").select("h", "doc", "src", "pos", "spos", *keep)


def _to_previous(found: DataFrame) -> DataFrame:
    """``h, doc, src, pos, spos``: each row of ``found`` (``h, doc, pos``) with the last occurrence of its ``h`` in the nearest earlier document that has it.

    Rows are gone through in order, dealt by ranges of ``h`` and ``doc``, so a seed that very many documents have lies in many
    tasks.  What comes before a range is looked up among the last rows of ranges, of which there is one a task.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, source = None, (-2, 0)  # the last row, and what comes before its document: -2 not known here, -1 nothing

        def out(h, doc, pos, src, spos, tail: bool) -> pa.RecordBatch:
            values = [np.asarray(h, np.int64), np.asarray(doc, np.int64), np.asarray(pos, np.int32), np.asarray(src, np.int64), np.asarray(spos, np.int32), np.full(len(h), part, np.int32), np.full(len(h), tail)]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["h", "doc", "pos", "src", "spos", "part", "tail"])

        for b in batches:
            if not b.num_rows:
                continue
            h, doc, pos = (np.asarray(b.column(i)).astype(np.int64) for i in range(3))
            new = np.r_[last is not None and last[:2] != (h[0], doc[0]), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            before = np.maximum(start - 1, 0)
            known = (start > 0) & (h[before] == h)
            src, spos = np.where(known, doc[before], -1), np.where(known, pos[before], 0)
            if start[0] == 0:
                source = (last[1], last[2]) if last[0] == h[0] else (-1, 0)
            src[start <= 0], spos[start <= 0] = source
            yield out(h, doc, pos, src, spos, False)
            last, source = (int(h[-1]), int(doc[-1]), int(pos[-1])), (int(src[-1]), int(spos[-1]))
        if last is not None:
            yield out([last[0]], [last[1]], [last[2]], [-1], [0], True)

    dealt = found.select("h", "doc", "pos").repartitionByRange("h", "doc").sortWithinPartitions("h", "doc", "pos")
    rows = written(dealt.mapInArrow(each, "h bigint, doc bigint, pos int, src bigint, spos int, part int, tail boolean"), "previous")
    tails = rows.filter("tail").select(F.col("h").alias("th"), F.struct("part", "doc", "pos").alias("before"))
    heads = rows.filter("not tail and src = -2").join(F.broadcast(tails), F.expr("h = th and before.part < part")).groupBy("h", "doc", "pos").agg(F.max("before").alias("before"))
    heads = heads.select("h", "doc", F.col("before.doc").alias("src"), "pos", F.col("before.pos").alias("spos"))
    return rows.filter("not tail and src >= 0").select("h", "doc", "src", "pos", "spos").unionByName(heads)


def _to_picked(found: DataFrame) -> DataFrame:
    """``h, doc, src, pos, spos``: each row of ``found`` (``h, doc, pos``) with one occurrence of its ``h``, picked by a hash of both, if that is in an earlier document."""
    picked = found.groupBy("h").agg(F.min(F.struct(F.xxhash64("h", "doc").alias("by"), "doc", "pos")).alias("one"))
    picked = written(picked.select("h", F.col("one.doc").alias("src"), F.col("one.pos").alias("spos")), "picked")
    return found.select("h", "doc", "pos").join(picked, "h").filter("doc > src").select("h", "doc", "src", "pos", "spos")


def _groups(pos: np.ndarray, k: int, window: int, min_words: int) -> list[tuple[int, int]]:
    """Numbers, from and to, of those groups of near places in ``pos`` that may be the seeds of ``min_words`` equal words."""
    start = np.flatnonzero(np.r_[True, np.diff(pos) > 2 * window])
    stop = np.r_[start[1:], len(pos)]
    may = pos[stop - 1] - pos[start] + k + 3 * window >= min_words
    return list(zip(start[may].tolist(), stop[may].tolist(), strict=True))


def unsettled(linked: DataFrame, found: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """``h`` of the seeds from which words outside the passages in ``found`` may be part of a passage.

    These are seeds near a place that an earlier document has and that no passage covers, where places
    follow each other closely over ``min_words``.
    """
    reach = window + k
    marks = linked.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "h", (F.col("doc") > F.col("src")).cast("int").alias("later")))).alias("marks"))
    spans = found.groupBy("doc").agg(F.collect_set(F.struct("start", "n_words")).alias("spans"))
    joined = marks.join(spans, "doc", "left").select("marks.pos", "marks.h", "marks.later", "spans.start", "spans.n_words")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*b.columns, strict=True):
                pos, h, later = (np.asarray(x.values) for x in row[:3])
                own = _groups(pos, k, window, min_words)
                if not own:
                    continue
                bare = np.ones(int(pos[-1]) + k + reach + 1, bool)
                for start, n in zip(row[3].as_py() or [], row[4].as_py() or [], strict=True):
                    bare[start : start + n] = False
                bare = np.r_[0, np.cumsum(bare)]
                open_ = (later == 1) & (bare[pos + k + reach] > bare[np.maximum(pos - reach, 0)])
                for a, z in own:
                    at = pos[a:z][open_[a:z]]
                    if len(at):
                        near = np.searchsorted(at, pos[a:z] + min_words, side="right") > np.searchsorted(at, pos[a:z] - min_words, side="left")
                        out.append(h[a:z][near])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["h"])

    return joined.mapInArrow(each, "h bigint").distinct()


def window_links(docs: DataFrame, linked: DataFrame, found: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, hot: int | None = None) -> DataFrame:
    """``h, doc, src, pos, spos, n`` for runs of ``min_words`` words around unsettled seeds, and for pairs of neighbouring ones, each with its first occurrence, and for the seeds with other occurrences.

    A seed may first occur in some short place although a whole passage around it is elsewhere; a run of
    ``min_words`` words cannot, as its first occurrence is a passage.  Of runs that come again within
    ``min_words`` in one document, one is taken.  Passages with edits may have no such run; of two seeds that
    follow each other where one short place ends and the next begins, the first occurrence is not in these.  Where
    short places overlap there may be no such seeds, so seeds are linked with the document before and with a picked one too.
    Pairs inside passages that are found already, and runs well inside, are left out: they can add no word.
    """
    loose = written(linked.join(written(unsettled(linked, found, k, window, min_words), "unsettled"), "h", "left_semi"), "loose")
    marks = written(loose.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("pos", "h"))).alias("marks")).select("doc", "marks.pos", "marks.h"), "marks")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, pos, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                pos, h = np.asarray(pos.values), np.asarray(h.values).view(np.uint64)
                near = np.flatnonzero(np.diff(pos) <= 2 * (window + k))
                out.append((mix(h[near] * np.uint64(0x9FB21C651E98DF25) + h[near + 1]).view(np.int64), np.full(len(near), doc), pos[near], (pos[near + 1] - pos[near] + k).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["h", "doc", "pos", "reach"])

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, pos in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                pos = np.asarray(pos.values)
                out += [(doc, doc, doc, a, 0, int(pos[a]) - 2 * window, int(pos[z - 1]) + k + 2 * window) for a, z in _groups(pos, k, window, min_words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "doc", "src", "no", "side", "lo", "hi"])

    asked = written(marks.mapInArrow(regions, "key bigint, doc bigint, src bigint, no bigint, side bigint, lo bigint, hi bigint"), "regions")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["h", "doc", "pos"])

        for b in batches:
            for doc, lo, words in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                h = window_hashes(np.frombuffer(words.as_py(), np.uint32).astype(np.uint64), min_words)
                ordered, at = np.sort(h), np.arange(len(h))
                if (ordered[1:] == ordered[:-1]).any():
                    by = np.argsort(h, kind="stable")
                    new = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]])
                    nth = (by - np.repeat(by[new], np.diff(np.r_[new, len(h)]))) // min_words
                    at = np.sort(by[np.r_[True, (h[by][1:] != h[by][:-1]) | (np.diff(nth) > 0)]])
                out.append((h[at].view(np.int64), np.full(len(at), doc), (lo + at).astype(np.int32)))
                size += len(at)
                if size >= BATCH:
                    yield made()
                    out, size = [], 0
        if out:
            yield made()

    runs = _fetch(docs, asked, hot or HOT_REQUESTS, each, "h bigint, doc bigint, pos int")
    two = written(marks.mapInArrow(pairs, "h bigint, doc bigint, pos int, reach int"), "pairs")
    both = _to_first(written(runs, "runs")).select("*", F.lit(min_words).alias("reach"), F.lit(min_words).alias("n"), F.lit(min_words).alias("near")).unionByName(_to_first(two, "reach").select("*", F.lit(k).alias("n"), F.lit(0).alias("near")))
    others = _to_previous(loose).unionByName(_to_picked(loose)).select("*", F.lit(k).alias("reach"), F.lit(k).alias("n"), F.lit(0).alias("near"))
    both = both.unionByName(others)
    spans = by_document(found.withColumnRenamed("doc", "row")).select(F.col("row").alias("of"), F.explode("passages").alias("p"))
    spans = written(spans.select("of", F.col("p.start").alias("a"), (F.col("p.start") + F.col("p.n_words")).alias("b")), "covered")
    return both.filter("doc > src").join(spans, F.expr("doc = of and greatest(pos - near, 0) >= a and pos + reach + near <= b"), "left_anti").drop("reach", "near")


class Fenwick:
    """Greatest value, and who has it, over a prefix of ranks."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, rank: int, value: float, who: int) -> None:
        while rank < len(self.best):
            if value > self.best[rank][0]:
                self.best[rank] = (value, who)
            rank += rank & -rank

    def get(self, rank: int) -> tuple[float, int]:
        """Over the ranks 1 to ``rank``."""
        best = (-np.inf, -1)
        while rank > 0:
            best = max(best, self.best[rank])
            rank -= rank & -rank
        return best


def chain(x0: list, y0: list, length: list, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Chains of anchors, each the numbers of its anchors in order.

    Anchor ``i`` covers ``length[i]`` words from ``x0[i]`` on one side and from ``y0[i]`` on the other;
    anchors are sorted by ``x0``.  An anchor follows another that ends before it starts on both sides;
    a chain's score is its words less ``gap_cost`` for each word skipped on either side.  Where the
    skipped words cost more than what came before brings, a new chain begins.
    """
    n = len(x0)
    ends = sorted({y + c for y, c in zip(y0, length, strict=True)})
    rank = {y: i + 1 for i, y in enumerate(ends)}
    tree, score, before = Fenwick(len(ends)), [0.0] * n, [-1] * n
    pending = sorted(range(n), key=lambda i: x0[i] + length[i])  # put in once x has passed their ends
    done = 0
    for i in sorted(range(n), key=lambda i: (x0[i], y0[i])):
        while done < n and x0[pending[done]] + length[pending[done]] <= x0[i]:
            j = pending[done]
            tree.put(rank[y0[j] + length[j]], score[j] + gap_cost * (x0[j] + y0[j] + 2 * length[j]), j)
            done += 1
        value, who = tree.get(bisect_right(ends, y0[i]))
        gain = value - gap_cost * (x0[i] + y0[i])
        score[i] = length[i]
        if gain > 0:
            score[i] += gain
            before[i] = who
    chains, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = before[i]
        if own:
            chains.append(own[::-1])
    return chains


def _anchors(pair: np.ndarray, pos: np.ndarray, spos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First link and words of each anchor: links of one pair, one after the other on one diagonal and near."""
    same = (pair[1:] == pair[:-1]) & (pos[1:] - pos[:-1] == spos[1:] - spos[:-1]) & (pos[1:] - pos[:-1] <= NEAR + n[:-1])
    start = np.flatnonzero(np.r_[True, ~same])
    return start, np.maximum.reduceat(pos + n, start) - pos[start]


def chains(linked: DataFrame) -> DataFrame:
    """``doc, src, no, a, b, sa, sb, turns`` for each chain: words a:b of ``doc`` follow words sa:sb of ``src``.

    ``linked`` has ``doc, src, pos, spos, n``: ``n`` equal words.  ``turns`` lists the anchors as triples: place in ``doc``, place in ``src``, words.
    """
    spark = linked.sparkSession

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            doc, src, pos, spos, length = rows
            new = np.r_[True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])]
            pair = np.cumsum(new) - 1
            a, n = _anchors(pair, pos, spos, length)
            of = pair[a]
            sizes = np.bincount(of, minlength=pair[-1] + 1)
            at = np.r_[0, np.cumsum(sizes)]
            x, y = pos[a], spos[a]
            got: list[tuple] = []
            for p in range(len(sizes)):
                own = slice(at[p], at[p + 1])
                xs, ys, ns = x[own].tolist(), y[own].tolist(), n[own].tolist()
                for c in [[0]] if len(xs) == 1 else chain(xs, ys, ns):
                    r = a[at[p]]
                    turns = [v for i in c for v in (xs[i], ys[i], ns[i])]
                    got.append((doc[r], src[r], len(got), xs[c[0]], xs[c[-1]] + ns[c[-1]], ys[c[0]], ys[c[-1]] + ns[c[-1]], turns))
            cols = list(zip(*got, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(np.array(c, np.int64)) for c in cols[:7]), pa.array(cols[7], pa.list_(pa.int64()))], names=names)

        names = ["doc", "src", "no", "a", "b", "sa", "sb", "turns"]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            turn = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            cut = int(turn[-1]) + 1 if len(turn) else 0  # the last pair may go on in the next batch
            goes_on = held and (held[-1][:2, -1] == rows[:2, 0]).all()
            if held and (cut or not goes_on) or cut:
                part = [*held, rows[:, :cut]] if cut else held
                yield out(np.concatenate(part, axis=1))
                held = []
            held.append(rows[:, cut:])
        if held:
            yield out(np.concatenate(held, axis=1))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = linked.select("doc", "src", "pos", "spos", "n").repartition(parts, "doc", "src").sortWithinPartitions("doc", "src", "pos", "spos", "n")
    return dealt.mapInArrow(each, "doc bigint, src bigint, no bigint, a bigint, b bigint, sa bigint, sb bigint, turns array<bigint>")


WORDS = "doc bigint, src bigint, no bigint, side bigint, lo bigint, words binary"


def _fetch(docs: DataFrame, asked: DataFrame, hot: int = HOT_REQUESTS, then=None, schema: str = WORDS) -> DataFrame:
    """``doc, src, no, side, lo, words`` for each request ``key, doc, src, no, side, lo, hi``: hashes of words lo:hi.

    Texts and requests meet by document; a document with very many requests is dealt over several tasks.
    ``then`` turns these rows into others in the same Python process (a second one would hold as much memory again).
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_key = written(asked.groupBy("key").count(), "asked")
    many = by_key.filter(F.col("count") > hot).select(F.col("key").alias("hot"), F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    if by_key.count() <= MOST_KEYS:
        docs = docs.join(F.broadcast(by_key.select(F.col("key").alias("doc"))), "doc", "left_semi")
    text = docs.select(F.col("doc").alias("key"), F.lit(0).alias("salt"), F.lit(0).alias("kind"), "text", *[F.lit(None).cast("bigint").alias(c) for c in ("doc", "src", "no", "side", "lo", "hi")])
    ask = asked.select("key", F.lit(0).alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "doc", "src", "no", "side", "lo", "hi")
    if not many.isEmpty():
        many, n = written(many, "many"), F.coalesce("parts", F.lit(1))
        text = text.join(many, text.key == many.hot, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("hot", "parts")
        ask = ask.join(many, ask.key == many.hot, "left").withColumn("salt", F.pmod(F.xxhash64("doc", "no"), n).cast("int")).drop("hot", "parts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, key, words = WordScanner(nonspace_bytes()), None, None
        for b in batches:
            keys, kinds = np.asarray(b.column(0)), np.asarray(b.column(2))
            ask = kinds == 1
            if not ask.any():
                key, words = keys[-1], b.column(3)[len(keys) - 1].as_py()
                continue
            want, got, starts = np.flatnonzero(ask), [], []
            lo, hi = (b.column(i).to_numpy(zero_copy_only=False) for i in (8, 9))
            for i in range(len(keys)):
                if not ask[i]:
                    key, words = keys[i], b.column(3)[i].as_py()
                    continue
                if isinstance(words, str):
                    data = np.frombuffer(words.encode(), np.uint8)
                    words = scanner.scan(data, np.array([0, len(data)]))[2].astype(np.uint32)
                a = max(0, int(lo[i]))
                starts.append(a)
                got.append(words[a : int(hi[i])].tobytes())
            take = pa.array(want)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in (4, 5, 6, 7)), pa.array(starts, pa.int64()), pa.array(got, pa.binary())], names=["doc", "src", "no", "side", "lo", "words"])

    both = text.unionByName(ask).repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "kind")
    return both.mapInArrow((lambda batches: then(each(batches))) if then else each, schema)


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words, quick to make; what it claims is held against the words later."""
    words = words.astype(np.uint64)
    h = words[: len(words) - n + 1] * np.uint64(0x9FB21C651E98DF25)
    for i in range(1, n):
        h += words[i : len(words) - n + 1 + i]
        h *= np.uint64(0x9FB21C651E98DF25)
    return h


def _shared(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``own`` are in ``other``."""
    other = np.sort(other)
    return other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own


def _turns_at(*arrays: np.ndarray) -> np.ndarray:
    """Where any of the arrays is not one more than before; the first place always."""
    new = np.ones(len(arrays[0]), bool)
    new[1:] = False
    for x in arrays:
        new[1:] |= x[1:] - x[:-1] != 1
    return np.flatnonzero(new)


def _in_order(xs: list[int], ys: list[int], ns: list[int]) -> list[int]:
    """Numbers of the runs, sorted by ``xs``, that follow each other on both sides and have most shingles together.

    Of the runs that have ended, those are held that no other beats by ending earlier on the right with as much.
    """
    if all(xs[i] + ns[i] <= xs[i + 1] and ys[i] + ns[i] <= ys[i + 1] for i in range(len(xs) - 1)):
        return list(range(len(xs)))
    ends, most, who = [], [], []
    score, before = [0] * len(xs), [-1] * len(xs)
    pending, done = sorted(range(len(xs)), key=lambda i: xs[i] + ns[i]), 0
    for i, (x, y, n) in enumerate(zip(xs, ys, ns, strict=True)):
        while (j := pending[done]) < i and xs[j] + ns[j] <= x:
            end, value = ys[j] + ns[j], score[j]
            at = bisect_right(ends, end)
            if not at or most[at - 1] < value:
                past = at
                while past < len(most) and most[past] <= value:
                    past += 1
                ends[at:past], most[at:past], who[at:past] = [end], [value], [j]
            done += 1
        at = bisect_right(ends, y)
        if at:
            score[i], before[i] = n + most[at - 1], who[at - 1]
        else:
            score[i] = n
    i, best = max(range(len(xs)), key=score.__getitem__), []
    while i >= 0:
        best.append(i)
        i = before[i]
    return best[::-1]


def _shared_runs(left: np.ndarray, right: np.ndarray, shared: np.ndarray, box: tuple[int, int, int, int], shingle: int) -> list[tuple[int, int, int]]:
    """Runs of equal shingles in order (left place, right place, shingles) in ``box``: left from, to, right from, to.

    ``left`` and ``right`` are shingle hashes; ``shared`` tells which of ``left`` are anywhere in ``right``.
    """
    x, x_end, y, y_end = box
    x, y = max(x, 0), max(y, 0)
    other = right[y : max(y_end - shingle + 1, 0)]
    place = shared[x : max(x_end - shingle + 1, 0)].nonzero()[0]
    if not len(place) or not len(other):
        return []
    own = left[x + place]
    order = np.argsort(other, kind="stable")
    ordered = other[order]
    low, high = ordered.searchsorted(own, "left"), ordered.searchsorted(own, "right")
    n = high - low
    total = int(n.sum())
    if not total:
        return []
    if total > MOST_MATCHES:  # one line again and again: each with as many-th on the other side
        by = np.argsort(own, kind="stable")
        new = np.concatenate([[True], own[by][1:] != own[by][:-1]])
        nth = np.empty(len(own), np.int64)
        nth[by] = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        at = np.flatnonzero(nth < n)
        to = order[low[at] + nth[at]]
        at = place[at]
    else:
        at = place.repeat(n)
        to = order[np.arange(total) + (low - (n.cumsum() - n)).repeat(n)]
    by = np.lexsort((at, to - at))
    at, to = at[by], to[by]
    first = _turns_at(at, to)
    size = np.append(first[1:], len(at)) - first
    by = np.lexsort((to[first], at[first]))
    xs, ys, ns = (v[by].tolist() for v in (at[first], to[first], size))
    return [(x + xs[i], y + ys[i], ns[i]) for i in _in_order(xs, ys, ns)]


def stretches(good: np.ndarray, least: int, similarity: float, one: bool = False) -> list[tuple[int, int]]:
    """The longest stretch of ``least`` or more that begins and ends with true and has a share of ``similarity`` of them, then those in what is left."""
    out, todo = [], [(0, len(good))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        at = a + np.flatnonzero(good[a:b])
        if len(at) < similarity * least - 1e-9:
            continue
        # from the i-th true to the j-th: (j - i + 1) >= similarity * (at[j] - at[i] + 1)
        nth = np.arange(len(at))
        low = np.minimum.accumulate(nth - similarity * at)
        first = np.searchsorted(-low, -(nth + 1 - similarity * (at + 1) + 1e-9), side="left")
        j = int(np.argmax(at - at[first]))
        start, stop = int(at[first[j]]), int(at[j]) + 1
        if stop - start < least:
            continue
        out.append((start, stop))
        if one:
            break
        todo += [(a, start), (stop, b)]
    return sorted(out)


def align(
    left: np.ndarray, right: np.ndarray, turns: list[tuple[int, int, int]], min_words: int, similarity: float, shingle: int = SHINGLE, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
) -> list[tuple[int, int, int, float]]:
    """Passages of ``left`` that ``right`` has: start, words, start in ``right``, share of equal shingles.

    ``known`` are hashes of the shingles of both, where they are made already, and which of the first are among the second.

    The path follows the diagonals of ``turns`` (left place, right place, words) and of runs of equal shingles
    between, before and after them; between two anchors on different diagonals it changes where most words
    agree.  Passages are the longest stretches of the path that are alike enough.
    """
    n, least = len(left), max(min_words - shingle + 1, 1)
    if n < max(min_words, shingle) or len(right) < shingle:
        return []
    own, other, shared = known or (_shingles(left, shingle), _shingles(right, shingle), None)
    if shared is None:
        shared = _shared(own, other)
    if not stretches(shared, least, similarity, True):  # no path has more
        return []
    ends = [(0, 0), *((x + c, y + c) for x, y, c in turns)]
    starts = [*((x, y) for x, y, _ in turns), (n, len(right))]
    path = []
    for i, ((x, y), (x_end, y_end)) in enumerate(zip(ends, starts, strict=True)):
        if shared[max(x, 0) : max(x_end - shingle + 1, 0)].any():
            path += _shared_runs(own, other, shared, (x, x_end, y, y_end), shingle)
        path += turns[i : i + 1]
    good, diagonal = _along(left, right, path, shingle)
    return [(a, b - a + shingle - 1, a + int(diagonal[a]), float(good[a:b].mean())) for a, b in stretches(good, least, similarity)]


def _along(left: np.ndarray, right: np.ndarray, path: list[tuple[int, int, int]], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles of ``left`` are equal along a path of diagonals, and the diagonal at each word."""
    n = len(left)
    diagonal = np.zeros(n, np.int64)
    d = path[0][1] - path[0][0]
    diagonal[:] = d
    done = path[0][0] + path[0][2]
    for x, y, length in path[1:]:
        new = y - x
        if new != d:
            span = np.arange(max(0, min(done, x)), min(n, x))
            on_old, on_new = (_equal(left, right, span, v) for v in (d, new))
            gain = np.zeros(len(span) + 1, np.int64)
            gain[1:] = on_old.cumsum()
            gain[:-1] += on_new[::-1].cumsum()[::-1]
            diagonal[(span[0] if len(span) else x) + int(np.argmax(gain)) :] = new
            d = new
        done = x + length
    run = np.zeros(n + 1, np.int64)
    run[1:] = _equal(left, right, np.arange(n), diagonal).cumsum()
    return (run[shingle:] - run[:-shingle] == shingle) & (diagonal[shingle - 1 :] == diagonal[: n - shingle + 1]), diagonal


def _equal(left: np.ndarray, right: np.ndarray, at: np.ndarray, diagonal) -> np.ndarray:
    there = at + diagonal
    inside = (there >= 0) & (there < len(right))
    out = np.zeros(len(at), bool)
    out[inside] = left[at[inside]] == right[there[inside]]
    return out


def align_all(lefts: list[np.ndarray], rights: list[np.ndarray], turns: list[np.ndarray], min_words: int, similarity: float, shingle: int = SHINGLE) -> list[list[tuple[int, int, int, float]]]:
    """``align`` for many chains at once; ``turns`` are arrays of three columns.

    Array operations over all chains find out which have enough shared shingles on either side at all, and which
    have theirs on one diagonal, so that no other path can have more; only the rest are aligned one by one.
    """
    least = max(min_words - shingle + 1, 1)
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (lefts, rights))
    left, right = np.concatenate(lefts), np.concatenate(rights)
    at, to = np.cumsum(n) - n, np.cumsum(m) - m
    if len(left) < shingle or len(right) < shingle:
        return [[] for _ in lefts]
    first = np.array([t[0, 1] - t[0, 0] for t in turns], np.int64)
    straight = np.array([(t[:, 1] - t[:, 0] == t[0, 1] - t[0, 0]).all() for t in turns], bool)
    chain_no = np.repeat(np.arange(len(n)), n)
    there = np.arange(len(left)) - at[chain_no] + first[chain_no]
    equal = (there >= 0) & (there < m[chain_no])
    equal[equal] = left[equal] == right[(there + to[chain_no])[equal]]
    run = np.cumsum(np.r_[0, equal])
    ends = np.arange(len(left) - shingle + 1) + shingle
    whole = ends <= (at + n)[chain_no[: len(ends)]]  # shingles inside one chain
    good = whole & (run[ends] - run[ends - shingle] == shingle)
    other_no = np.repeat(np.arange(len(m)), m)
    ends = np.arange(len(right) - shingle + 1) + shingle
    inside = ends <= (to + m)[other_no[: len(ends)]]
    salt = mix(np.arange(1, len(n) + 1).astype(np.uint64))
    rest = np.flatnonzero(whole & ~good)
    shared = good.copy()
    hashes = own = _shingles(left, shingle) ^ salt[chain_no[: len(good)]]
    other = (_shingles(right, shingle) ^ salt[other_no[: len(ends)]])[inside]
    if len(rest) and len(other):
        shared[rest] = _shared(own[rest], other)
    total, on_line = (np.bincount(chain_no[: len(good)][x], minlength=len(n)) for x in (shared, good))
    may = (total >= similarity * least - 1e-9) & (n >= max(min_words, shingle))
    if may.any():
        back = other_no[: len(ends)][inside]
        asked = may[back]
        there = np.bincount(back[asked][_shared(other[asked], own[shared])], minlength=len(n))
        may &= there >= similarity * least - 1e-9
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in lefts]
    n_other = np.maximum(m - shingle + 1, 0)
    first_other = np.cumsum(n_other) - n_other
    for i in np.flatnonzero(may).tolist():
        if straight[i] and total[i] == on_line[i]:
            own = good[at[i] : at[i] + n[i] - shingle + 1]
            out[i] = [(a, b - a + shingle - 1, a + int(first[i]), float(own[a:b].mean())) for a, b in stretches(own, least, similarity)]
        else:
            mine, his = slice(at[i], at[i] + n[i] - shingle + 1), slice(first_other[i], first_other[i] + n_other[i])
            out[i] = align(lefts[i], rights[i], [tuple(t) for t in turns[i].tolist()], min_words, similarity, shingle, (hashes[mine], other[his], shared[mine]))
    return out


def repeats_inside(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, start, n_words, src, src_start, similarity`` for each run of ``min_words`` words or more that the same document has earlier.

    Exact repeats only (``similarity`` is 1, ``src`` the document itself); a run may overlap the place that it repeats,
    as in a line that comes again and again.  Each document is worked on by itself.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner(nonspace_bytes())
        for b in slices(batches, "text", SEED_BYTES):
            data, offsets = text_bytes(b.column(1))
            _, _, hashes, bounds = scanner.scan(data, offsets)
            h = window_hashes(hashes, min_words)
            row = np.searchsorted(bounds, np.arange(len(h)), side="right") - 1
            at = np.flatnonzero(np.arange(len(h)) + min_words <= bounds[row + 1])
            row = row[at]
            if not len(at):
                continue
            _, first, which = np.unique(h[at] ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True)
            source = at[first[which]]
            again = source < at
            at, source, row = at[again], source[again], row[again]
            new = _turns_at(at, source) if len(at) else at
            n = np.append(new[1:], len(at)) - new + min_words - 1
            doc = np.asarray(b.column(0))[row[new]]
            values = [doc, at[new] - bounds[row[new]], n, doc, source[new] - bounds[row[new]]]
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int64)) for v in values), pa.array(np.ones(len(new)))], names=["doc", "start", "n_words", "src", "src_start", "similarity"])

    return docs.select("doc", "text").mapInArrow(each, "doc bigint, start bigint, n_words bigint, src bigint, src_start bigint, similarity double")


def passages(docs: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hot: int = HOT_REQUESTS, inside: bool = False) -> DataFrame:
    """``doc, start, n_words, src, src_start, similarity`` for each passage that an earlier document has.

    ``docs`` has ``doc`` (a unique long) and ``text``.  Words are runs of anything but ASCII white space,
    A-Z lower-cased; places count words.  With ``inside`` exact repeats inside one document are passages too.
    """
    linked = written(links(docs, k, window, min_words), "links")
    found = written(_aligned(docs, linked.withColumn("n", F.lit(k)), min_words, similarity, hot), "passages")
    more = _aligned(docs, window_links(docs, linked, found, k, window, min_words, hot), min_words, similarity, hot).alias("m")
    whole = found.select(F.col("doc").alias("of"), F.col("start").alias("a"), (F.col("start") + F.col("n_words")).alias("b"))
    more = more.join(whole, F.expr("doc = of and start >= a and start + n_words <= b"), "left_anti")
    found = found.unionByName(more)
    return found.unionByName(repeats_inside(docs, min_words)) if inside else found


def _aligned(docs: DataFrame, linked: DataFrame, min_words: int, similarity: float, hot: int) -> DataFrame:
    """The passages that the links from a later to an earlier document lead to; a link has ``n`` words."""
    found = written(chains(linked.filter("doc > src")), "chains")
    pad = F.lit(PAD) + F.expr("cast(greatest(b - a, sb - sa) div 4 as bigint)")
    asked = found.select(F.col("doc").alias("key"), "doc", "src", "no", F.lit(0).cast("bigint").alias("side"), (F.col("a") - pad).alias("lo"), (F.col("b") + pad).alias("hi"))
    asked = asked.unionByName(found.select(F.col("src").alias("key"), "doc", "src", "no", F.lit(1).cast("bigint").alias("side"), (F.col("sa") - pad).alias("lo"), (F.col("sb") + pad).alias("hi")))
    words = _fetch(docs, asked, hot)
    turns = found.select("doc", "src", "no", F.lit(2).cast("bigint").alias("side"), F.lit(0).cast("bigint").alias("lo"), F.lit(None).cast("binary").alias("words"), "turns")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = words.withColumn("turns", F.lit(None).cast("array<bigint>")).unionByName(turns).repartition(parts, "doc", "src", "no").sortWithinPartitions("doc", "src", "no", "side")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = right = None
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            found = align_all([h[2][1] for h in held], [h[3][1] for h in held], [h[4] for h in held], min_words, similarity)
            rows = [(h[0], s + h[2][0], n, h[1], r + h[3][0], share) for h, own in zip(held, found, strict=True) for s, n, r, share in own]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.array(c, np.int64)) for c in cols[:5]), pa.array(cols[5], pa.float64())], names=["doc", "start", "n_words", "src", "src_start", "similarity"])

        for b in batches:
            doc, src, side, lo = (np.asarray(b.column(i)).tolist() for i in (0, 1, 3, 4))
            words, path = b.column(5).to_pylist(), b.column(6)
            ends, values = np.asarray(path.offsets), np.asarray(path.values)
            for i in range(b.num_rows):
                if side[i] < 2:
                    part = lo[i], np.frombuffer(words[i], np.uint32)
                    left, right = (part, right) if side[i] == 0 else (left, part)
                    continue
                held.append((doc[i], src[i], left, right, values[ends[i] : ends[i + 1]].reshape(-1, 3) - np.array([left[0], right[0], 0])))
                size += len(left[1]) + len(right[1])
                if size >= ALIGN_WORDS:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return both.mapInArrow(each, "doc bigint, start bigint, n_words bigint, src bigint, src_start bigint, similarity double")


def repeated_passages(docs: DataFrame, row: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``row, start, n_words, src, src_start, similarity`` for each passage of a document that an earlier one has.

    ``row`` and ``src`` are the documents' keys as given.  The earlier document is that with the lesser key;
    where keys are null, repeated or not integers, it is the one that comes first in the table as it is read.
    Null and short texts have no passages; an empty table gives no rows; repeats inside one document are
    passages only with ``inside=True``.
    """
    docs, mark, same = numbered(docs.select(named(row).alias("row"), named(text).cast("string").alias("text")), "row")
    found = passages(docs.select(F.col(mark).alias("doc"), "text"), **options)
    if same:
        return found.select(F.col("doc").alias("row"), "start", "n_words", "src", "src_start", "similarity")
    keys = docs.select(F.col(mark).alias("doc"), "row")
    other = docs.select(F.col(mark).alias("src"), F.col("row").alias("src_row"))
    return found.join(keys, "doc").join(other, "src").select("row", "start", "n_words", F.col("src_row").alias("src"), "src_start", "similarity")


def by_document(found: DataFrame) -> DataFrame:
    """``row, n_repeated, n_passages, passages, sources``: a row for each document of ``repeated_passages``.

    Passages that overlap or touch, found in whatever earlier documents, are one (``start``, ``n_words``);
    ``sources`` lists the earlier documents.  What is gathered for a document is bounded by its length.
    """
    kind = found.schema["row"].dataType.simpleString()
    grouped = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n_words")).alias("stop")))).alias("spans"), F.sort_array(F.collect_set("src")).alias("sources"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged = []
            for spans in b.column(1).to_pylist():
                own: list[list[int]] = []
                for s in spans:
                    if own and s["start"] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], s["stop"])
                    else:
                        own.append([s["start"], s["stop"]])
                merged.append([{"start": a, "n_words": z - a} for a, z in own])
            words = [sum(m["n_words"] for m in own) for own in merged]
            spans = pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(list(map(len, merged)), pa.int64()), spans, b.column(2)], names=["row", "n_repeated", "n_passages", "passages", "sources"])

    return grouped.mapInArrow(each, f"row {kind}, n_repeated bigint, n_passages bigint, passages array<struct<start: bigint, n_words: bigint>>, sources array<{kind}>")


def deduplicate(docs: DataFrame, row: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the passages that an earlier document has, same columns, of whatever names.

    The first document that has a passage keeps it.  A document of which no word is left goes; one that
    loses nothing stays as it is, wordless or null ones too.  Keys and empty tables are as in ``repeated_passages``.
    """
    names = docs.columns
    docs, mark, _ = numbered(docs, row)
    found = passages(docs.select(named(mark).alias("doc"), named(text).cast("string").alias("text")), **options)
    spans = by_document(found.withColumnRenamed("doc", "row")).select(F.col("row").alias(mark), F.col("passages").alias("spans"))
    return cut_words(docs, mark, text, spans, nonspace_bytes(), drop_empty=True).select(*map(named, names))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that has passages of earlier documents: how many words, where, and of which documents."""
    found = by_document(repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(F.col("row").alias("doc_id"), F.col("n_repeated").alias("n_repeated_words"), "n_passages", "passages", F.col("sources").alias("source_doc_ids"))
