"""Toxicity: a learned lexicon, found with its misspellings by one automaton, and weighed by what stands around.

The lexicon's terms are learned from labelled texts: words, and stems that only such words have in common, whose presence tells
toxic texts from others beyond chance.  They are put in a trie, and the trie is intersected with Levenshtein automata:
a state of the product is a set of (trie node, edits so far), made when first met and remembered, so a
word takes a dictionary lookup a letter and most words end after a few.  Each hit is scored by its term (or, if misspelled, by how often
such misspellings of such terms are toxic) and by its context window: words and quotation marks around it that part
quoted from abusive uses in the labelled texts.  A text's score is that of its worst hit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import WordScanner, appended, mix, named, nonspace_bytes, slices, text_bytes, tidy, window_hashes, written

#: Words: letters and digits, with single marks between them that stand in for letters.
WORD = r"[0-9a-z\x80-\U0010ffff]+(?:[@$*!][0-9a-z\x80-\U0010ffff]+)*"
_WORD = re.compile(WORD)
_PLAIN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
#: A word is a term if its likelihood ratio statistic is so high (a chance of one in twenty million) and its odds are so many times those of texts at large.
SIGNIFICANT, LEAST_ODDS = 30.0, 4.0
#: Terms, stems, harmless words and context words that a model holds at most (the most significant; a model's size must be bounded, as it is broadcast).
MOST_TERMS, MOST_OTHERS = 5_000, 20_000
#: A model is fitted on so many labelled texts, about, at most.
MOST_TEACHERS = 200_000
#: Near copies share a vote: bands of min-hashes of shingles of so many words.
BANDS, BAND_ROWS, SHINGLE = 4, 2, 3
#: Letters of a stem, and terms that have it in common at least.
STEMS, LEAST_COMMON = (4, 5, 6, 7, 8), 3
#: Letters from which on one edit, and two, are allowed.
ONE_EDIT, TWO_EDITS = 5, 8
#: Words on either side that are a hit's context, and characters in which they are looked for.
WINDOW, REACH = 6, 160
#: What an edit takes from a term's weight, and toxic and other texts that a kind of misspelled hits counts as having besides those seen.
EDIT_COST, PRIOR = 1.0, (2.0, 1.0)
MIN_SCORE = 0.5
#: Positions (nodes with edits) in the states of the automaton that a worker remembers, and words.
MOST_POSITIONS, MOST_KNOWN = 2_000_000, 300_000
#: Bytes of a text that are lower-cased and scanned at a time.
CHUNK = 1 << 20
_OPEN, _CLOSE = "“„«‹‚", "”»›"


def edits_allowed(term: str) -> int:
    return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0


class Automaton:
    """The product of a trie of terms with their Levenshtein automata, made as it is walked.

    ``find(word)`` gives the nearest term (ties: the longest, then the least) and the edits, or None.  An open term (a stem) takes any
    word that begins with it as it is.
    """

    def __init__(self, terms: list[str], stems: list[str] = ()):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.budget = [0]
        for word, edits, is_stem in [*((t, edits_allowed(t), False) for t in terms), *((t, 0, True) for t in stems)]:
            at = 0
            self.budget[0] = max(self.budget[0], edits)
            for c in word:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.stem.append(None)
                    self.budget.append(0)
                at = self.children[at][c]
                self.budget[at] = max(self.budget[at], edits)
            (self.stem if is_stem else self.ends)[at] = word
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.held = 0
        self.next: list[dict[str, int]] = []
        self.positions: list[tuple] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.opens: list[str | None] = []
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, found: dict[int, int]) -> dict[int, int]:
        """Nodes reached by leaving letters of terms out, with the fewest edits."""
        todo = list(found.items())
        while todo:
            node, used = todo.pop()
            for child in self.children[node].values():
                if used + 1 <= self.budget[child] and found.get(child, 99) > used + 1:
                    found[child] = used + 1
                    todo.append((child, used + 1))
        return found

    def _state(self, found: dict[int, int]) -> int:
        key = tuple(sorted(found.items()))
        if key not in self.states:
            self.states[key] = len(self.next)
            self.next.append({})
            self.positions.append(key)
            self.held += len(key)
            ends = [(used, -len(self.ends[n]), self.ends[n]) for n, used in key if self.ends[n] and used <= edits_allowed(self.ends[n])]
            best = min(ends, default=None)
            self.accepts.append((best[2], best[0]) if best else None)
            self.opens.append(max((self.stem[n] for n, used in key if self.stem[n] and not used), key=len, default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        found: dict[int, int] = {}
        for node, used in self.positions[state]:
            if used + 1 <= self.budget[node]:  # a letter too many
                found[node] = min(found.get(node, 99), used + 1)
            for x, child in self.children[node].items():
                cost = used + (x != c)
                if cost <= self.budget[child]:
                    found[child] = min(found.get(child, 99), cost)
        to = self._state(self._closed(found))
        self.next[state][c] = to
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        if self.held > MOST_POSITIONS:
            self.clear()
        state, stem = self.start, None
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                break
            stem = self.opens[state] or stem
        hit = self.accepts[state]
        if hit and not hit[1]:
            return hit
        return (stem + "*", 0) if stem else hit


@dataclass
class Model:
    """What is learned: the log-odds of all texts, what terms and stems add to them, what misspelled hits add by kind, context weights, and a curve from all that to probabilities."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    harmless: frozenset[str] = frozenset()
    kinds: dict[str, float] = field(default_factory=dict)
    contexts: dict[str, float] = field(default_factory=dict)
    base: float = math.log(1 / 9)
    slope: float = 1.0
    shift: float = 0.0


def kind(term: str, edits: int) -> str:
    """Misspelled hits are weighed by edits and length of the term."""
    return f"{edits} edits, {min(len(term), 12)} letters"


def pieces(text: str) -> Iterator[tuple[str, int, int]]:
    """A text in lower case, cut where no word is: each piece with where its own words begin and end, and some of its neighbours around."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + CHUNK)
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        piece = text[max(0, at - REACH) : stop + REACH]
        low, first = piece.lower(), min(at, REACH)
        if len(low) != len(piece):  # a letter that becomes two
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in piece)
        yield low, first, first + stop - at
        at = stop


class Scanner:
    """Finds a model's hits in texts, each with its context."""

    def __init__(self, terms, stems, harmless=frozenset()):
        self.automaton, self.harmless = Automaton(sorted(terms), sorted(stems)), harmless
        self.known: dict[str, tuple[str, int] | None] = {}

    def hits(self, text: str) -> Iterator[tuple[str, str, int, str, int, int]]:
        """``word, term, edits, piece, start, end`` for each hit, with the lower-cased piece of the text that it stands in."""
        known = self.known
        for low, first, last in pieces(text):
            for m in _WORD.finditer(low, first, last):
                word = m.group()
                if word in known:
                    hit = known[word]
                else:
                    if len(known) > MOST_KNOWN:
                        known.clear()
                    hit = self.automaton.find(word)
                    if hit and hit[1] and word in self.harmless:
                        hit = None
                    known[word] = hit
                if hit:
                    yield word, *hit, low, m.start(), m.end()

    @staticmethod
    def context(low: str, start: int, end: int) -> set[str]:
        """Words of the window around a hit, and ``"`` if it stands in quotation marks there (on its line)."""
        left, right = low[max(0, start - REACH) : start], low[end : end + REACH]
        found = set(_PLAIN.findall(left)[-WINDOW:]) | set(_PLAIN.findall(right)[:WINDOW])
        left, right = left.rpartition("\n")[2], right.partition("\n")[0]
        opened = max(left.rfind(c) for c in _OPEN) > max(left.rfind(c) for c in _CLOSE) and any(c in right for c in _CLOSE)
        if opened or (left.count('"') % 2 and '"' in right):
            found.add('"')
        return found


def weight(toxic: float, other: float, prior: tuple[float, float] = (0.5, 0.5)) -> float:
    return math.log((toxic + prior[0]) / (other + prior[1]))


def _with_significance(stats: DataFrame, toxic: float, other: float) -> DataFrame:
    """``stats`` (``toxic, other`` texts that have a word) with its likelihood ratio statistic and odds against those of all texts."""
    n = toxic + other
    t, o = F.col("toxic"), F.col("other")
    cells = [(t, (t + o) * toxic / n), (o, (t + o) * other / n), (toxic - t, (n - t - o) * toxic / n), (other - o, (n - t - o) * other / n)]
    statistic = sum((F.when((x > 0) & (e > 0), x * F.log(x / e)).otherwise(0.0) for x, e in cells), F.lit(0.0)) * 2
    return stats.withColumn("statistic", statistic).withColumn("odds", (t + 0.5) / (o + 0.5) * ((other + 0.5) / (toxic + 0.5)))


def _sketch(texts: DataFrame) -> DataFrame:
    """``doc, text`` with ``h, h2`` (two hashes of the text) in place of the text, and ``bands``: keys that near copies have in common, most likely."""
    salts = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)).reshape(BANDS, BAND_ROWS)

    def each(column: pa.Array) -> list[pa.Array]:
        scanner, found = WordScanner(nonspace_bytes()), []
        data, offsets = text_bytes(column)
        _, _, words, at = scanner.scan(data, offsets)
        for i in range(len(column)):
            own = words[at[i] : at[i + 1]]
            own = window_hashes(own, SHINGLE) if len(own) >= SHINGLE else own
            least = [[mix(own ^ salt).min() if len(own) else 0 for salt in band] for band in salts]
            found.append([int(mix(np.array([p ^ (q + k + 1)], np.uint64))[0].view(np.int64)) for k, (p, q) in enumerate(np.array(least, np.uint64))])
        return [pa.array(found, pa.list_(pa.int64()))]

    out, names = appended(texts.select("doc", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"), "text"), "text", StructType([StructField("bands", ArrayType(LongType()))]), each)
    return out.drop("text")


def teachers(docs: DataFrame, labels: DataFrame, teaches: Column, row: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_TEACHERS) -> DataFrame:
    """``text, toxic, share``: texts with a label that teach, each distinct text once, by the label that most of its ids have.

    ``teaches`` is a condition on the labels' columns.  A text is read where its least id is; rows that repeat that share
    its one vote, and texts that are near copies of each other (by bands of min-hashes) share one too, so that a
    text which is copied often does not make terms of all its words.  Of more than ``most`` texts about so many teach, picked by
    hash, so their ids (28 bytes each) can be broadcast and no text is shuffled.
    """
    marks = labels.filter(teaches & named(row).isNotNull() & named(label).isNotNull()).groupBy(named(row).alias("doc")).agg(F.avg(named(label).cast("double")).alias("toxic"))
    texts = docs.select(named(row).alias("doc"), named(text).cast("string").alias("text")).filter(F.col("text").isNotNull() & F.col("doc").isNotNull())
    seen = _sketch(texts).join(marks, "doc").groupBy("h", "h2", "doc").agg(F.first("toxic").alias("toxic"), F.count("*").alias("rows"), F.first("bands").alias("bands"))
    chosen = seen.groupBy("h", "h2").agg(F.min(F.struct("doc", "rows", "bands")).alias("least"), F.avg("toxic").alias("toxic"))
    chosen = written(chosen.select("least.*", "h", (F.col("toxic") >= 0.5).cast("int").alias("toxic")), "teachers")
    bands = chosen.select("doc", "h", F.posexplode("bands").alias("k", "band"))
    crowds = written(bands.groupBy("k", "band").agg(F.count("*").alias("n")).filter("n > 1"), "crowds")
    crowd = bands.join(crowds, ["k", "band"]).groupBy("doc", "h").agg(F.max("n").alias("n"))
    share = 1 / (F.coalesce("n", F.lit(1)) * F.col("rows"))
    chosen = written(chosen.join(crowd, ["doc", "h"], "left").select("doc", F.col("h").alias("own"), "toxic", share.alias("share")), "votes")
    n = chosen.count()
    if n > most:  # a sample by hash, of about that size
        chosen = chosen.filter(F.pmod(F.xxhash64("doc", "own"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return texts.join(F.broadcast(chosen), "doc").filter(F.xxhash64("text") == F.col("own")).select("text", "toxic", "share")


def _tallies(rows: DataFrame, scanner_of, each_text) -> DataFrame:
    """``what, key, toxic, n`` summed over all texts: ``each_text(scanner, text)`` gives amounts by what and key, a text's share of which is added."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, seen = scanner_of(), Counter()
        for b in slices(batches, "text"):
            for text, toxic, share in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for x, n in each_text(scanner, text).items():
                    seen[*x, toxic] += share * n
            if len(seen) > 300_000:
                yield out(seen)
                seen = Counter()
        yield out(seen)
        tidy()

    def out(seen: Counter) -> pa.RecordBatch:
        what, key, toxic = zip(*seen, strict=True) if seen else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(key, pa.string()), pa.array(toxic, pa.int32()), pa.array(list(seen.values()), pa.float64())], names=["what", "key", "toxic", "n"])

    found = rows.select("text", "toxic", "share").mapInArrow(each, "what string, key string, toxic int, n double")
    n = lambda value: F.coalesce(F.sum(F.when(F.col("toxic") == value, F.col("n"))), F.lit(0.0))
    return found.groupBy("what", "key").agg(n(1).alias("toxic"), n(0).alias("other"))


def words_of(text: str) -> set[str]:
    found: set[str] = set()
    for low, first, last in pieces(text):
        found.update(_WORD.findall(low, first, last))
    return found


def train(docs: DataFrame, labels: DataFrame, teaches: Column, row: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from all texts that have a label and teach (see ``teachers``).

    Where no row teaches, or all have one label, the model has no terms and scores all texts alike.
    """
    rows = teachers(docs, labels, teaches, row, text, label)
    stats = written(_tallies(rows, lambda: None, lambda _, x: {("texts", ""): 1, **{("word", w): 1 for w in words_of(x)}}), "word-texts")
    whole = stats.filter("what = 'texts'").groupBy().agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
    toxic, other = whole.toxic or 0.0, whole.other or 0.0
    if not toxic or not other:
        return Model(base=min(weight(toxic, other), math.log(1 / 9)))
    base = weight(toxic, other)
    words = stats.filter("what = 'word'")
    tells = lambda df: _with_significance(df, toxic, other).filter((F.col("statistic") >= SIGNIFICANT) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("statistic"), "key").limit(MOST_TERMS).collect()
    terms = {r.key: weight(r.toxic, r.other) - base for r in tells(words)}
    stems = _stems(words, terms, tells, base)
    first = Model(terms, stems, base=base)
    seen = written(_tallies(rows, lambda: Scanner(first.terms, first.stems), lambda scanner, x: _observed(first, scanner, x)), "hits")
    # misspelled words that are as common in other texts are words of their own
    near = seen.filter((F.col("what") == "near") & (F.col("other") > F.col("toxic"))).orderBy(F.desc("other"), "key").limit(MOST_OTHERS).collect()
    kinds = {r.key: weight(r.toxic, r.other, PRIOR) - base for r in seen.filter("what = 'kind'").collect()}  # by length and edits: few
    second = Model(terms, stems, frozenset(r.key for r in near), kinds, _contexts(seen), base)
    bins = _tallies(rows, lambda: Scanner(second.terms, second.stems, second.harmless), lambda scanner, x: {("bin", f"{round(4 * evidence(second, scanner, x)) / 4:.2f}"): 1})
    slope, shift = fitted([(float(r.key), r.toxic, r.other) for r in bins.filter((F.col("toxic") > 0) | (F.col("other") > 0)).collect()])  # quarters from -32 to 32
    return replace(second, slope=slope, shift=shift)


def _contexts(seen: DataFrame) -> dict[str, float]:
    """What context words add: the odds of toxic texts around them against those that the terms by themselves let one expect."""
    sums = {w: F.sum(F.when(F.col("what") == w, F.col(c))) for w, c in (("context", "toxic"), ("expected", "amount"), ("variance", "amount"))}
    rows = seen.filter("what in ('context', 'expected', 'variance')").withColumn("amount", F.col("toxic") + F.col("other"))
    rows = rows.groupBy("key").agg(sums["context"].alias("o"), sums["expected"].alias("e"), sums["variance"].alias("v"), F.sum(F.when(F.col("what") == "context", F.col("amount"))).alias("n"))
    strong = (F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / (F.col("v") + 1)
    found = rows.withColumn("strong", strong).filter(F.col("strong") >= SIGNIFICANT / 2).orderBy(F.desc("strong"), "key").limit(MOST_OTHERS).collect()
    return {r.key: weight(r.o, r.n - r.o) - weight(r.e, r.n - r.e) for r in found}


def fitted(bins: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Slope and shift that make probabilities of log-odds, from texts of either label by log-odds; (1, 0) where nothing rises."""
    x, t, o = (np.array(c, float) for c in zip(*bins, strict=True))
    at = np.array([1.0, 0.0])
    for _ in range(50):  # Newton's method for a logistic curve, held to a slope of 1 by a little
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        slack, n = t - (t + o) * p, (t + o) * p * (1 - p)
        gradient = np.array([(slack * x).sum() - (at[0] - 1), slack.sum() - 0.01 * at[1]])
        curve = np.array([[(n * x * x).sum() + 1, (n * x).sum()], [(n * x).sum(), n.sum() + 0.01]])
        step = np.linalg.solve(curve, gradient)
        at = at + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if np.isfinite(at).all() and at[0] > 0 else (1.0, 0.0)


def _stems(words: DataFrame, terms: dict[str, float], tells, base: float) -> dict[str, float]:
    """Beginnings that several terms and hardly any other words have, as short as can be."""
    common = Counter(t[:n] for t in terms for n in STEMS if len(t) >= n)
    common = [s for s, n in common.items() if n >= LEAST_COMMON]  # fewer than terms times lengths
    if not common:
        return {}
    spark = words.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(s,) for s in common], "key string"))
    parts = words.filter(F.char_length("key") >= min(STEMS)).select("toxic", "other", F.explode(F.transform(F.array(*[F.lit(n) for n in STEMS]), lambda n: F.substring("key", F.lit(1), n))).alias("key"), F.char_length("key").alias("n"))
    sums = parts.join(wanted, "key").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    # a text may have several words of a stem, so sums are over words, and bounded by what texts there are
    found = {r.key: weight(r.toxic, r.other) - base for r in tells(sums)}
    return {s: w for s, w in found.items() if not any(s[:n] in found for n in STEMS if n < len(s))}


def _observed(model: Model, scanner: Scanner, text: str) -> dict[tuple[str, str], float]:
    """What a text that teaches tells of hits: contexts of terms with what the term lets one expect, misspelled words and their kinds."""
    found, kinds = {}, {}
    for word, term, edits, low, start, end in scanner.hits(text):
        if edits:
            kinds |= {("near", word): 1, ("kind", kind(term, edits)): 1}
        else:
            p = probability(model.base + (model.stems[term[:-1]] if term.endswith("*") else model.terms[term]))
            for x in scanner.context(low, start, end):
                found |= {("context", x): 1, ("expected", x): p, ("variance", x): p * (1 - p)}
    return found or kinds  # a text with a term as it is tells nothing of misspelled ones


def evidence(model: Model, scanner: Scanner, text: str) -> float:
    """The log-odds that a text is toxic: those of all texts, and what each distinct term adds where its context tells most against the text."""
    found: dict[str, float] = {}
    for _, term, edits, low, start, end in scanner.hits(text):
        if edits:
            value = model.terms[term] - EDIT_COST * edits
            value = min(value, model.kinds.get(kind(term, edits), value))
        else:
            value = model.stems[term[:-1]] if term.endswith("*") else model.terms[term]
        if model.contexts:
            value += sum(model.contexts.get(x, 0.0) for x in scanner.context(low, start, end))
        found[term] = max(found.get(term, 0.0), value)
    return model.base + sum(found.values())


def probability(log_odds: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds))))


def predict(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``MIN_SCORE`` on), and the names those got.

    Every whole text is scanned, a piece at a time.  Null, empty and wordless texts have the score of texts without a hit; repeated rows are scored
    alike; other columns, of any name, pass through, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded
    fields = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def each(texts: pa.Array) -> list[pa.Array]:
        found = shared.value
        scanner = _scanner(found)
        values = [probability(found.slope * evidence(found, scanner, x or "") + found.shift) for x in texts.to_pylist()]
        return [pa.array(values, pa.float64()), pa.array([int(v >= MIN_SCORE) for v in values], pa.int32())]

    return appended(docs, text, fields, each)


_SCANNERS: list[tuple[Model, Scanner]] = []


def _scanner(model: Model) -> Scanner:
    """A worker's scanner for a model, kept between slices."""
    if not _SCANNERS or _SCANNERS[0][0] is not model:
        _SCANNERS[:] = [(model, Scanner(model.terms, model.stems, model.harmless))]
    return _SCANNERS[0][1]


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, from the labels of those that are not held out."""
    held = lambda c: F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out, names = predict(docs, train(docs, labels, ~held(F.col("doc_id"))))
    return out.select("doc_id", held(F.col("doc_id")).alias("held_out"), *[F.col(c) for c in names])
