"""Spelling variants: words that one edit parts, and the form that each is a variant of.

Each letter has a bit of its own, and a word's mask says which letters it has an odd number of.  A replaced
letter flips two bits of the mask, an inserted or deleted one flips one, so if masks are split into three bands
two words that one edit parts have a band in common.  Masks (with their words' length) are joined on each
band, which finds all pairs of masks that differ in one bit and one in length, or in two bits and not in length;
only then do words come in: those of the smaller of two such groups are sent to the larger one and verified
there, first by hashes of their halves (an edit leaves one half as it was), then letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, slices, tidy, written

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF, whose UTF-8 form is C3 80 to C3 BF; only A-Z are lower-cased.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
BANDS, BAND_BITS = 3, 30
#: Of so many runs one (by hash) loses a letter in the query.
TYPO = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form is so many times as frequent as its variant, at least.
RATIO = 2
#: Distinct words that a task holds before it passes their counts on, and bytes of a text from which on runs are taken one at a time.
HELD, LONG = 200_000, 1 << 20


def _runs(text: bytes) -> Iterator[bytes]:
    text = text.lower()
    return iter(_RUN.findall(text)) if len(text) < LONG else (m.group() for m in _RUN.finditer(text))


def _shortened(run: bytes, h: int) -> bytes:
    """The run without its code point ``h`` modulo its length."""
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def count_words(docs: DataFrame, row: str = "doc_id", text: str = "text", typo: int | None = None, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of ``letters`` or more code points that occur ``least`` times or more in all texts.

    With ``typo`` a run loses a code point where ``typo`` divides the CRC-32 of ``<row>:<run>``.  Texts are
    read whole, in slices; null and empty ones have no words, a null ``row`` counts as an empty one, and repeated
    rows count each time.  An empty table gives no rows; other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in slices(batches, "text"):
            for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{key or ''}:".encode())
                for run in _runs((x or "").encode()):
                    if typo:
                        h = zlib.crc32(run, start)
                        if h % typo == 0:
                            run = _shortened(run, h)
                    if len(run) >= letters:  # bytes; code points are counted later
                        seen[run] = seen.get(run, 0) + 1
                if len(seen) > HELD:
                    yield counted(seen)
                    seen = {}
        yield counted(seen)
        tidy()

    def counted(seen: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(named(row).cast("string").alias("key"), named(text).cast("string").alias("text"))
    counts = rows.mapInArrow(each, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter((F.char_length("word") >= letters) & (F.col("n") >= least))


def _bits(words: DataFrame) -> dict[str, int]:
    """A bit for each letter (at most ninety): frequent letters are dealt to the bands in turn, so that each band tells words apart."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    order = [r.letter for r in letters.orderBy(F.desc("n"), "letter").collect() if r.letter in set(LETTERS)]
    order += [x for x in LETTERS if x not in order]
    return {x: BAND_BITS * (i % BANDS) + i // BANDS for i, x in enumerate(order)}


def masks(words: DataFrame) -> DataFrame:
    """``words`` with ``length``, the bands ``m0, m1, m2`` of its letters' parity, and hashes of its halves.

    ``head`` and ``tail`` are the first half and the rest; ``head_less`` and ``tail_less`` are as long as those of
    a word that is one letter shorter.
    """
    bits = _bits(words)

    def parity(word: str) -> list[int]:
        mask = 0
        for x in word:
            mask ^= 1 << bits[x]
        return [mask >> BAND_BITS * i & (1 << BAND_BITS) - 1 for i in range(BANDS)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parity(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[i] for m in found], pa.int32()) for i in range(BANDS))], names=["word", "n", "m0", "m1", "m2"])

    rows = words.select("word", "n").mapInArrow(each, "word string, n bigint, m0 int, m1 int, m2 int").withColumn("length", F.char_length("word"))
    half = lambda n: F.floor(n / 2).cast("int")
    size = F.col("length")
    head = lambda n: F.xxhash64(F.substring("word", F.lit(1), half(n)))
    tail = lambda n: F.xxhash64(F.right("word", n - half(n)))
    return rows.select("*", head(size).alias("head"), tail(size).alias("tail"), head(size - 1).alias("head_less"), tail(size - 1).alias("tail_less"))


def _flips(a: str, b: str) -> Column:
    counts = [F.bit_count(F.col(f"{a}.m{i}").bitwiseXOR(F.col(f"{b}.m{i}"))) for i in range(BANDS)]
    return counts[0] + counts[1] + counts[2]


def near_masks(groups: DataFrame) -> DataFrame:
    """``few, many, longer``: pairs of groups (mask and length) whose words one edit may part, once each.

    ``groups`` has ``id, length, m0, m1, m2, words``; ``few`` is the one with fewer words, and ``longer`` says by how many
    letters ``many`` is longer.  A pair is found in the first band that both have in common.
    """
    shorter = F.explode(F.array(F.lit(0), F.lit(1)))
    found = None
    for i in range(BANDS):
        a = groups.select("*", shorter.alias("more")).withColumn("wanted", F.col("length") + F.col("more")).alias("a")
        b = groups.alias("b")
        same = (F.col(f"a.m{i}") == F.col(f"b.m{i}")) & (F.col("a.wanted") == F.col("b.length"))
        earlier = [F.col(f"a.m{j}") != F.col(f"b.m{j}") for j in range(i)]
        one = (F.col("a.more") == 1) & (_flips("a", "b") == 1)
        two = (F.col("a.more") == 0) & (F.col("a.id") < F.col("b.id")) & (_flips("a", "b") == 2)
        match = same & (one | two)
        for e in earlier:
            match = match & e
        swap = F.col("a.words") > F.col("b.words")
        pair = a.join(b, match).select(
            F.when(swap, F.col("b.id")).otherwise(F.col("a.id")).alias("few"), F.when(swap, F.col("a.id")).otherwise(F.col("b.id")).alias("many"),
            F.when(swap, -F.col("a.more")).otherwise(F.col("a.more")).alias("longer"),
        )
        found = pair if found is None else found.unionByName(pair)
    return found


def near_words(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of words that exactly one inserted, deleted or replaced code point parts, once.

    ``words`` has distinct ``word``s over ``LETTERS`` with their counts ``n``; fewer than two give no rows.
    """
    named_words = written(masks(words), "words")
    key = ["m0", "m1", "m2", "length"]
    # a hash of 64 bits names a group; should two groups share it, words that do not match are verified in vain
    group = F.xxhash64(*key)
    groups = written(named_words.groupBy(*key).agg(F.count("*").alias("words")).withColumn("id", group), "groups")
    pairs = written(near_masks(groups), "near-masks")
    rows = named_words.select("word", "n", group.alias("id"), "head", "tail", "head_less", "tail_less")
    sent = pairs.join(rows.withColumnRenamed("id", "few"), "few").select("many", "longer", *[F.col(c).alias(f"s_{c}") for c in ("word", "n", "head", "tail", "head_less", "tail_less")])
    equal = (F.col("s_head") == F.col("head")) | (F.col("s_tail") == F.col("tail"))
    more = (F.col("s_head") == F.col("head_less")) | (F.col("s_tail") == F.col("tail_less"))
    less = (F.col("s_head_less") == F.col("head")) | (F.col("s_tail_less") == F.col("tail"))
    half = F.when(F.col("longer") == 0, equal).when(F.col("longer") == 1, more).otherwise(less)
    met = sent.join(rows, (F.col("many") == F.col("id")) & half & (F.levenshtein("s_word", "word", 1) == 1))
    return met.select(F.col("s_word").alias("a"), F.col("s_n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form`` (unique words): where following forms ends, by pointer doubling.

    Forms grow in frequency by ``RATIO`` at each step, so a chain's length is at most the logarithm of the greatest count.
    """
    step = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        # an outer join from the side that may have a very common root: large partitions of it can be split
        step = written(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        step = step.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words`` (distinct ``word`` and ``n``, as ``count_words`` gives them).

    ``n_near`` counts the words that one edit parts from it.  ``form`` is the most frequent of these (ties: the least in
    code-point order) if it is ``ratio`` times as frequent, else null; ``root`` is where following forms ends.
    """
    words = written(words.select("word", "n"), "vocabulary")
    pairs = written(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    good = F.col("form_n") >= ratio * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, some of which lose a letter by rule."""
    return variants(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), typo=TYPO))


#: CRC-32 is made of its definition: a table of 256 remainders, then a step a byte.
OP13_SQL = """
WITH bits AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each_run AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT run, c, list_transform(range(1, 2 * strlen(doc_id || ':' || run), 2), lambda i: CAST('0x' || substr(hex(encode(doc_id || ':' || run)), i, 2) AS BIGINT)) AS b FROM each_run),
hashed AS (SELECT run, c, xor(list_reduce(b, lambda h, x: xor(h >> 8, t[xor(h % 256, x) + 1]), 4294967295), 4294967295) AS h FROM bytes, bits),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT word, other, other_n FROM (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word)),
ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r FROM near),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
chain(word, at_word) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at_word = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at_word AS root FROM chain c JOIN forms f ON c.at_word = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word
"""
OP13_SQL = OP13_SQL.replace("WITH bits", "WITH RECURSIVE bits", 1)
