"""Language identification in two steps: the language family, then one-versus-one linear SVMs inside it.

Texts become hashed byte n-gram frequencies (Hellinger-scaled, so every vector has length 1).
Linear SVMs are trained by dual coordinate descent on a bounded sample of labelled rows; each
SVM's margin becomes a probability through a fitted sigmoid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import appended, named, slices, text_bytes

#: Languages that are told apart inside one family; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "da", "sv", "no", "nb", "nn", "is", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "sl", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "arabic script": ("ar", "fa", "ur", "ps", "ckb"),
    "han": ("zh", "ja", "yue", "wuu"),
    "indic": ("hi", "mr", "ne", "sa", "bn", "as", "gu", "pa"),
    "malayic": ("id", "ms", "jv", "su", "tl"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
}
#: Size of the feature space, and labelled rows (in expectation, for each language) that models are fitted on.
DIMENSIONS, SAMPLE = 1 << 12, 500
#: Rows of other families that a family's SVM is fitted against, as many of each language, and languages that are learned
#: (those of most rows).  With these the work of fitting grows with the languages, not with their square.
REST, MOST_LANGUAGES = 4000, 200
#: Penalty of the SVMs and passes over the sample.
PENALTY, PASSES = 10.0, 30
#: Rows whose score is lower are rejected, as are those without a language.
MIN_SCORE = 0.3
UNKNOWN = "und"
_CHUNK = 1 << 20


def _folded() -> np.ndarray:
    """Byte table: a-z for either case, bytes over 0x7F as they are, a blank for the rest."""
    t = np.full(256, 0x20, np.uint32)
    t[0x61:0x7B] = t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


def features(column: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row for each text: square roots of the shares of its hashed byte bigrams and trigrams."""
    data, offsets = text_bytes(column)
    rows, table, bits = len(column), _folded(), int(dimensions).bit_length() - 1
    counts = np.zeros(rows * dimensions, np.float32)
    lengths = np.diff(offsets)
    for at in range(0, len(data), _CHUNK):
        stop = min(len(data), at + _CHUNK)
        part = table[data[at : min(len(data), stop + 2)]]
        first, last = np.searchsorted(offsets, [at, min(len(data), stop + 2) - 1], side="right") - 1
        own = np.arange(first, last + 1)
        row = np.repeat(own, np.minimum(offsets[own + 1], min(len(data), stop + 2)) - np.maximum(offsets[own], at)) if len(own) else own
        for n in (2, 3):
            here = min(stop - at, len(part) - n + 1)
            if here <= 0:
                continue
            code = part[:here].copy()
            for i in range(1, n):
                code = code << np.uint32(8) | part[i : here + i]
            solid = (row[:here] == row[n - 1 : here + n - 1]) & ~((part[:here] == 0x20) & (part[1 : here + 1] == 0x20))
            solid &= ~((part[n - 2 : here + n - 2] == 0x20) & (part[n - 1 : here + n - 1] == 0x20))
            code = (code + np.uint32(n << 28)) * np.uint32(2654435761) >> np.uint32(32 - bits)
            where = row[:here][solid] * dimensions + code[solid]
            if rows * dimensions <= 4 * len(where):
                counts += np.bincount(where, minlength=rows * dimensions)
            else:
                places, n_each = np.unique(where, return_counts=True)
                counts[places] += n_each
    counts = counts.reshape(rows, dimensions)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)) if len(lengths) else counts


def solve_svm(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the bias) of a linear SVM, its dual variables and their bounds, by dual coordinate descent; ``y`` is 1 or -1."""
    n, d = x.shape
    w, alpha = np.zeros(d + 1), np.zeros(n)
    x = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float64)
    norm = (x * x).sum(axis=1)
    # both sides weigh the same, however many rows each has
    cost = penalty * n / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))
    order = np.random.default_rng(0)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(n):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, alpha, cost


def slope(margins: np.ndarray, y: np.ndarray) -> float:
    """The slope of a sigmoid through 0 that fits the margins' signs best, between 1 and 20."""
    tries = np.geomspace(1, 20, 30)
    loss = [np.logaddexp(0, -a * y * margins).mean() + 0.002 * a for a in tries]
    return float(tries[int(np.argmin(loss))])


class Sample:
    """Feature rows kept sparse, as bytes of places and values; ``sample[rows]`` is a dense matrix of those rows."""

    def __init__(self, rows: list[tuple[bytes, bytes]], dimensions: int = DIMENSIONS):
        self.rows, self.shape = rows, (len(rows), dimensions)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), self.shape[1]), np.float32)
        for i, k in enumerate(rows.tolist()):
            at, value = self.rows[k]
            x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
        return x


@dataclass
class Model:
    """Learned languages by family, and the weights of all SVMs as columns of one matrix."""

    families: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS + 1, 0), np.float32))
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: For each column: ("family", name) or ("pair", first language, second language).
    columns: list[tuple] = field(default_factory=list)
    dimensions: int = DIMENSIONS

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; a text that is null or without a letter has no language and score 0."""
        texts = column.to_pylist()
        some = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.families:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x = features(column, self.dimensions)
        p = 1 / (1 + np.exp(-np.clip((x @ self.weights[:-1] + self.weights[-1]) * self.slopes, -50, 50)))
        at = {c: i for i, c in enumerate(self.columns)}
        names = list(self.families)
        if len(names) > 1:
            fam = np.stack([p[:, at["family", f]] for f in names], axis=1)
            fam = fam / np.maximum(fam.sum(axis=1, keepdims=True), 1e-12)
        else:
            fam = np.ones((len(texts), 1))
        best = fam.argmax(axis=1)
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        for f, name in enumerate(names):
            own, rows = self.families[name], np.flatnonzero(some & (best == f))
            votes = np.zeros((len(rows), len(own)))
            for i, j in combinations(range(len(own)), 2):
                q = p[rows, at["pair", own[i], own[j]]]
                votes[:, i] += q
                votes[:, j] += 1 - q
            share = votes / (len(own) - 1) if len(own) > 1 else np.ones((len(rows), 1))
            pick = share.argmax(axis=1)
            lang[rows] = np.array(own, object)[pick]
            score[rows] = fam[rows, f] * share[np.arange(len(rows)), pick]
        return lang.tolist(), np.clip(score, 0, 1)


def fit(x: np.ndarray | Sample, labels: list[str], families: dict[str, tuple] | None = None, rest: int = REST) -> Model:
    """A model of the labels in the sample; no rows give a model without languages.

    A family's SVM is fitted on its rows and at most about ``rest`` others, a pair's on its rows.
    """
    known = {lang: f for f, langs in (families or FAMILIES).items() for lang in langs}
    labels = np.array(labels, object)
    found: dict[str, list[str]] = {}
    for lang in sorted(set(labels.tolist())):
        found.setdefault(known.get(lang, f"={lang}"), []).append(lang)
    family = np.array([known.get(lang, f"={lang}") for lang in labels], object)
    columns, weights, slopes = [], [], []

    def add(name: tuple, rows: np.ndarray, y: np.ndarray) -> None:
        part = x[rows]
        w = solve_svm(part, y)[0]
        columns.append(name)
        weights.append(w)
        slopes.append(slope(part @ w[:-1] + w[-1], y))

    places = {lang: np.flatnonzero(labels == lang) for own in found.values() for lang in own}

    def against(f: str) -> np.ndarray:
        """Rows of a family, and of the others as many of each language as there is room for, evenly over its rows."""
        others = [places[lang] for g, own in found.items() if g != f for lang in own]
        room, left = rest, sum(map(len, others))
        parts = [places[lang] for lang in found[f]]
        for k, rows in enumerate(sorted(others, key=len)):  # what a small language leaves over goes to the others
            take = len(rows) if left <= room else min(len(rows), max(1, room // (len(others) - k)))
            parts.append(rows[np.arange(take) * len(rows) // take])
            room, left = max(0, room - take), left - len(rows)
        return np.sort(np.concatenate(parts))

    names = list(found)
    for k, f in enumerate(names if len(names) > 1 else []):
        if k == 1 and len(names) == 2:  # the other side of the first
            columns.append(("family", f))
            weights.append(-weights[0])
            slopes.append(slopes[0])
        else:
            rows = against(f)
            add(("family", f), rows, np.where(family[rows] == f, 1.0, -1.0))
    for own in found.values():
        for a, b in combinations(own, 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            add(("pair", a, b), rows, np.where(labels[rows] == a, 1.0, -1.0))
    w = np.stack(weights, axis=1).astype(np.float32) if weights else np.zeros((x.shape[1] + 1, 0), np.float32)
    return Model(found, w, np.array(slopes), columns, x.shape[1])


def held_out(row: str):
    """True where crc32 of the id as text leaves 2 when divided by 4; false for null ids."""
    return F.coalesce(F.crc32(named(row).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, row: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, families: dict[str, tuple] | None = None, languages: int = MOST_LANGUAGES) -> Model:
    """Fit on labelled rows that are not held out: all of a language's, or about ``sample`` picked by hash of id and language.

    Rows with null id, text or language teach nothing.  Rows that share id and language are picked together and teach
    once, by the least of their texts, so a repeated id cannot swell the sample.  Of more than ``languages`` languages those
    of most rows are learned.  A table without labelled rows gives a model without languages.
    """
    rows = docs.filter(named(lang).isNotNull() & named(row).isNotNull() & ~held_out(row))
    counts = rows.groupBy(named(lang).cast("string").alias("lang")).count().orderBy(F.col("count").desc(), "lang").limit(languages).collect()
    if not counts:
        return Model()
    spark = docs.sparkSession
    rates = F.broadcast(spark.createDataFrame([(r[0], min(1.0, sample / r[1])) for r in counts], "lang string, rate double"))  # ``languages`` rows at most
    unit = F.shiftrightunsigned(F.xxhash64(named(row).cast("string"), named(lang)), 11) / float(1 << 53)
    part = rows.filter(named(text).isNotNull()).select(named(row).alias("row"), named(lang).cast("string").alias("lang"), named(text).alias("text"), unit.alias("unit"))
    part = part.join(rates, "lang").filter("unit < rate")
    part = part.groupBy("row", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = features(b.column(1))
            at = [np.flatnonzero(r) for r in x]
            values = [r[i].astype(np.float32).tobytes() for r, i in zip(x, at, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.astype(np.uint16).tobytes() for i in at], pa.binary()), pa.array(values, pa.binary())], names=["lang", "at", "value"])

    got = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in part.mapInArrow(each, "lang string, at binary, value binary").collect())
    return fit(Sample([g[1:] for g in got]), [g[0] for g in got], families)


def predict(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with ``lang_pred`` and ``score`` from each whole text, and the names these columns got.

    Null, empty and letterless texts get ``und`` and 0, and so does every text where the model knows no language; ties go to
    the family, then the language, that comes first.  All rows and columns stay, repeated rows alike; an empty table gives none; a new name
    that ``docs`` has already gets an underscore; very long texts are read whole, by pieces.  The model is broadcast: at most
    ``MOST_LANGUAGES`` families and their pairs, each 16 kB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(column: pa.Array) -> list[pa.Array]:
        lang, score = shared.value.predict(column)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return appended(docs, text, StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]), each)


def keep(docs: DataFrame, row: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = MIN_SCORE, **options) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``min_score`` or more, same columns.

    The model learns from the same rows.  Where no row has a label nothing can be told and all rows with a letter stay.
    Null and empty texts go; repeated rows each stay or go alike; rows with a null id teach nothing and are judged
    like any other; an empty table gives none; columns of any name pass through.
    """
    model = train(docs, row, text, lang, **options)
    if not model.families:
        return docs.filter(named(text).rlike(r"\p{L}"))
    out, (pred, score) = predict(docs, model, text)
    return out.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).drop(pred, score)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's predicted language and score, and whether its label was kept from the training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    out, (pred, score) = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col(pred).alias("lang_pred"), F.col(score).alias("score"))
