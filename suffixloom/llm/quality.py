"""Quality rules by distribution divergence, in DataFrame functions only.

Each document gets a histogram of character classes and one of its language's common words.  Both are
compared, by Jensen-Shannon distance, with references of the language: the shares of the classes over all
its documents that pass the base rules, and the shares of its common words over all its words.  Which words
are common is learned from all documents.  A histogram of too few counts is not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import small
from .common import fresh, named, written

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
PUNCTUATION = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in SYMBOLS)
#: Character classes in the histogram, besides all other characters; white space is none.
CLASSES = (LOWER, UPPER, DIGITS, SYMBOLS, PUNCTUATION)

#: A word is common in a language if it is at least one in so many of all its words; so there are at most as many.
COMMON_PART = 250
#: Up to so many languages have their references broadcast (a reference has under ``COMMON_PART + 10`` numbers and words).
MOST_LANGUAGES = 5000
#: Up to so many common words, of all languages together, are looked for by one look-up.
MOST_LOOKED_UP = 2000

#: Base rules: fewer words, or a greater share (in percent) of words in repeated three-word windows, fail.
LEAST_WORDS, MOST_REPEAT = 50, 50
#: Guards: histograms of fewer characters or words are not judged.
LEAST_CHARS, LEAST_COUNTED = 200, 100
#: Greatest distance from the language's reference, by characters and by common words.
MOST_CLASS, MOST_WORDS = 0.35, 0.29


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _three(w: Column, i: Column) -> list[Column]:
    return [F.get(w, i + k) for k in range(3)]


def _neighbours(ordered: Column, f) -> Column:
    """What ``f`` says of each two neighbours, as one array."""
    n = F.size(ordered)
    return F.flatten(F.zip_with(F.slice(ordered, F.lit(1), n - 1), F.slice(ordered, F.lit(2), n - 1), f))


def _covered(starts: Column) -> Column:
    """Words in windows of three that begin at ``starts``, which are sorted."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, s: F.struct((s + 3).alias("end"), (a["n"] + 3 - F.greatest(F.lit(0), a["end"] - s)).alias("n"))
    return F.aggregate(starts, begin, step, lambda a: a["n"])


def with_repeats(df: DataFrame, words: str, keep: list[str], bits: int | None = None) -> DataFrame:
    """``keep`` of ``df`` and ``repeat``: words in three-word windows that occur twice or more, the first included.

    Windows' hashes, with places in their last bits, are sorted as numbers, and neighbours of equal hash are
    compared word by word.  Where such neighbours differ, windows are sorted by their words instead.
    """
    w = F.col(words)
    none = F.array().cast("array<int>")
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    b = F.lit(bits) if bits else F.length(F.bin(F.size(w)))
    cut = lambda h: F.call_function("shiftright", h, b)
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - 1).cast("int")

    def pair(x: Column, y: Column) -> Column:
        i, j = place(x), place(y)
        alike = F.lit(True)
        for p, q in zip(_three(w, i), _three(w, j), strict=True):
            alike = alike & (p == q)
        return F.when(cut(x) != cut(y), none).otherwise(F.when(alike, F.array(i, j)).otherwise(F.array(F.lit(-1))))

    same = lambda x, y: F.when((x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]), F.array(x["i"], y["i"])).otherwise(none)
    by_words = F.array_sort(F.transform(starts, lambda i: F.struct(*[x.alias(f"w{k}") for k, x in enumerate(_three(w, i))], i.alias("i"))))
    packed = F.sort_array(F.transform("grams", lambda h, i: F.call_function("shiftleft", cut(h), b).bitwiseOR(i.cast("bigint"))))
    grams = F.when(F.size(w) >= 4, F.transform(starts, lambda i: F.xxhash64(*_three(w, i))))
    # each step is a projection of its own, so nothing is worked out twice
    df = df.select(*keep, words, grams.alias("grams"))
    df = df.select(*keep, words, F.when(F.size(F.array_distinct("grams")) < F.size("grams"), packed).alias("packed"))
    df = df.select(*keep, words, F.when(F.col("packed").isNotNull(), _neighbours(F.col("packed"), pair)).alias("places"))
    df = df.select(*keep, F.when(F.array_contains("places", -1), _neighbours(by_words, same)).otherwise(F.col("places")).alias("places"))
    df = df.select(*keep, F.sort_array(F.array_distinct("places")).alias("places"))
    return df.select(*keep, F.coalesce(_covered(F.col("places")), F.lit(0).cast("bigint")).alias("repeat"))


def vocabulary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``v_lang, vocab, ref_common``: each language's common words, and their shares of all its words, the last that of all other words.

    The row with null language is over all documents together.  A language without words has no row.
    """
    words = docs.select(named(lang).alias("v_lang"), F.explode(words_of(named(text).cast("string"))).alias("word"))
    counts = written(words.groupBy("v_lang", "word").agg(F.count("*").alias("n")), "words")
    whole = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(None).cast(counts.schema["v_lang"].dataType).alias("v_lang"), "word", "n")
    counts = counts.filter("v_lang is not null").unionByName(whole)
    total = small(counts.groupBy(F.col("v_lang").alias("t_lang")).agg(F.sum("n").alias("total")), "totals", MOST_LANGUAGES)
    common = counts.join(total, F.col("v_lang").eqNullSafe(F.col("t_lang"))).filter(COMMON_PART * F.col("n") >= F.col("total"))
    top = common.groupBy("v_lang").agg(F.sort_array(F.collect_list(F.struct("n", "word")), False).alias("top"), F.first("total").alias("total"))
    found = total.join(top.drop("total"), F.col("v_lang").eqNullSafe(F.col("t_lang")), "left")
    top = F.coalesce("top", F.array().cast("array<struct<n: bigint, word: string>>"))
    other = F.col("total") - F.aggregate(top["n"], F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(F.col("t_lang").alias("v_lang"), top["word"].alias("vocab"), shares(F.concat(top["n"], F.array(other))).alias("ref_common"))


def measures(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``keys, lang, m, ref_common``: a struct of the columns of ``docs`` but ``text``, the language, a struct of counts, and the language's words' shares.

    The counts are ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the histograms ``classes``
    and ``common``.  Null text counts as empty.  What is derived stands beside structs of what was there, so
    no name can clash.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    keys = F.struct(*[plain[f"c{i}"] for i, n in enumerate(docs.columns) if n != text] or [F.lit(0).alias("none")])
    df = plain.select(keys.alias("keys"), plain[f"c{docs.columns.index(lang)}"].alias("lang"), F.coalesce(plain[f"c{docs.columns.index(text)}"].cast("string"), F.lit("")).alias("t"))
    vocab = small(vocabulary(docs, text, lang), "vocabulary", MOST_LANGUAGES)
    words = vocab.select(F.explode("vocab").alias("word")).distinct().limit(MOST_LOOKED_UP + 1).collect()
    df = df.join(vocab, F.col("lang").eqNullSafe(F.col("v_lang")), "left").drop("v_lang").withColumn("vocab", F.coalesce("vocab", F.array().cast("array<string>")))
    # what is left of the text after each class is taken out of it: most characters go in the first step
    df, sizes = df.select("*", F.length("t").alias("s0"), F.regexp_replace("t", "[a-z]+", "").alias("rest")), ["s0"]
    for k, chars in enumerate((SPACE, *CLASSES[1:]), 1):
        df = df.select("keys", "lang", "vocab", "ref_common", "t", *sizes, F.length("rest").alias(f"s{k}"), F.translate("rest", chars, "").alias("rest"))
        sizes.append(f"s{k}")
    left = [F.col(c).cast("bigint") for c in sizes] + [F.length("rest").cast("bigint")]
    lower, space, upper, digits, symbols, punctuation = (a - b for a, b in zip(left, left[1:], strict=False))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = df.select("keys", "lang", "vocab", "ref_common", (left[0] - space).alias("chars"), symbols.alias("symbols"), F.array(lower, upper, digits, symbols, punctuation, left[-1]).alias("classes"), words_of(F.col("t")).alias("w"), lines.alias("lines"))
    here = (lambda w: w.isin([r[0] for r in words])) if len(words) <= MOST_LOOKED_UP else (lambda w: F.array_contains("vocab", w))
    counted = F.filter("w", here) if words else F.array().cast("array<string>")
    df = df.select(
        "keys", "lang", "vocab", "ref_common", "w", counted.alias("counted"), F.size("w").cast("bigint").alias("n"), "chars", "symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("dup"), "classes",
    )
    common = F.transform("vocab", lambda v: (F.size("counted") - F.size(F.array_remove("counted", v))).cast("bigint"))
    df = df.withColumn("common", common).drop("counted", "vocab")
    df = with_repeats(df, "w", [c for c in df.columns if c != "w"])
    other = F.col("n") - F.aggregate("common", F.lit(0).cast("bigint"), lambda a, x: a + x)
    m = F.struct(
        F.col("n").alias("n_words"), F.col("chars").alias("word_chars"), F.col("symbols").alias("n_symbols"), F.col("dup").alias("n_dup_lines"), F.col("repeat").alias("n_repeat_words"),
        F.col("classes"), F.concat("common", F.array(other)).alias("common"),
    )
    return df.select("keys", "lang", m.alias("m"), "ref_common")


def base_failed() -> Column:
    """The base rules on the struct ``m`` of measures."""
    return (F.col("m.n_words") < LEAST_WORDS) | (100 * F.col("m.n_repeat_words") > MOST_REPEAT * F.col("m.n_words"))


def shares(counts: Column) -> Column:
    """A histogram's counts as shares; all zero where there are none."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two share arrays, 0 to 1 (base 2)."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def references(measured: DataFrame) -> DataFrame:
    """``r_lang, ref_classes``: shares of the character classes over all documents of a language that pass the base rules.

    The row with null language is over all documents together; it serves documents without one.
    """
    size = len(CLASSES) + 1
    sums = [F.sum(F.col("m.classes")[i]).alias(f"s{i}") for i in range(size)]
    by = written(measured.filter(~base_failed()).groupBy(F.col("lang").alias("r_lang")).agg(*sums), "sums")
    whole = by.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]).select(F.lit(None).cast(by.schema["r_lang"].dataType).alias("r_lang"), "*")
    both = by.filter("r_lang is not null").unionByName(whole)
    return both.select("r_lang", shares(F.array(*[F.coalesce(f"s{i}", F.lit(0).cast("bigint")) for i in range(size)])).alias("ref_classes"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, str]:
    """``docs`` with one struct column in place of ``text``, and its name: the measures, ``class_distance``,
    ``word_distance``, ``base_failed`` and ``kept``.

    A document is kept if the base rules pass and neither distance that its counts suffice for is too great.
    A language of which no document passes the base rules has no reference, and its documents are judged by
    the base rules alone, which they fail.  Documents without a language are compared with all documents.
    Repeated rows each get a row; an empty table gives none.  Columns of any name pass through.
    """
    measured = written(measures(docs, text, lang), "measures")
    joined = measured.join(small(references(measured), "references", MOST_LANGUAGES), F.col("lang").eqNullSafe(F.col("r_lang")), "left")
    by_class = jensen_shannon(shares(F.col("m.classes")), F.col("ref_classes"))
    by_word = F.when(F.col("ref_classes").isNotNull(), jensen_shannon(shares(F.col("m.common")), F.col("ref_common")))
    joined = joined.select("keys", "m", by_class.alias("by_class"), by_word.alias("by_word"), base_failed().alias("failed"))
    far = (F.col("m.word_chars") >= LEAST_CHARS) & (F.col("by_class") > MOST_CLASS) | (F.col("m.n_words") >= LEAST_COUNTED) & (F.col("by_word") > MOST_WORDS)
    out = F.struct(F.col("m.*"), F.col("by_class").alias("class_distance"), F.col("by_word").alias("word_distance"), F.col("failed").alias("base_failed"), (~F.col("failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))
    names = [n for n in docs.columns if n != text]
    mark = fresh("_m", names)
    places = [i for i, n in enumerate(docs.columns) if n != text]
    return joined.select(*[F.col(f"keys.c{i}").alias(n) for i, n in zip(places, names, strict=True)], out.alias(mark)), mark


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's base counts, its distances from its language's references, and the verdicts."""
    out, m = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return out.select("doc_id", *[f"{m}.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], *[F.round(f"{m}.{k}", 6).alias(k) for k in ("class_distance", "word_distance")])


def _sql_chars(chars: str) -> str:
    return "".join(f"\\x{ord(c):02X}" if not c.isalnum() else c for c in chars)


def _sql_js(p: str, q: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p[i] + q[i]) / 2)) ELSE 0.0 END"
    return f"(SELECT sqrt(greatest(sum(({part('p[i]')} + {part('q[i]')}) / 2), 0.0)) FROM (SELECT {p} AS p, {q} AS q) z, unnest(range(1, len({p}) + 1)) u(i))"


_COUNT = lambda chars: f"length(regexp_replace(t, '[^{_sql_chars(chars)}]', '', 'g'))"
_SPACES = "length(regexp_replace(t, '[^ \\x09-\\x0D]', '', 'g'))"
_NAMED = ", ".join(f"{_COUNT(c)} AS k{i}" for i, c in enumerate(CLASSES))
_KS = ", ".join(f"k{i}" for i in range(len(CLASSES)))
_REST = " - ".join(f"k{i}" for i in range(len(CLASSES)))
_SUMS = "[" + ", ".join(f"sum(classes[{i + 1}])" for i in range(len(CLASSES) + 1)) + "]"
_SHARE = lambda x: f"list_transform({x}, lambda v: CASE WHEN list_sum({x}) > 0 THEN v::DOUBLE / list_sum({x}) ELSE 0.0 END)"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
cw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d) GROUP BY ALL),
ca AS (SELECT lang, word, n FROM cw WHERE lang IS NOT NULL UNION ALL SELECT NULL, word, sum(n) FROM cw GROUP BY word),
ct AS (SELECT lang, sum(n) AS total FROM ca GROUP BY lang),
cc AS (SELECT ca.lang, list(word ORDER BY n DESC, word) AS vocab, list(n::BIGINT ORDER BY n DESC, word) AS vn FROM ca JOIN ct ON ca.lang IS NOT DISTINCT FROM ct.lang WHERE {COMMON_PART} * n >= total GROUP BY ca.lang),
v AS (SELECT ct.lang, coalesce(vocab, []) AS vocab, list_append(coalesce(vn, []), (total - coalesce(list_sum(vn), 0))::BIGINT) AS vs FROM ct LEFT JOIN cc ON ct.lang IS NOT DISTINCT FROM cc.lang),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM d, unnest(range(1, len(w) - 1)) u(i)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM g, unnest(range(i, i + 3)) u(p) WHERE n > 1 GROUP BY doc_id),
f AS (SELECT doc_id, d.lang, vs, len(w) AS n_words, length(t) - {_SPACES} AS word_chars, {_NAMED},
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines,
  list_transform(coalesce(vocab, []), lambda c: len(list_filter(w, lambda x: x = c))) AS cw, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN v ON d.lang IS NOT DISTINCT FROM v.lang),
m AS (SELECT doc_id, lang, vs, n_words, word_chars, k{CLASSES.index(SYMBOLS)} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
  [{_KS}, word_chars - {_REST}] AS classes, list_append(cw, n_words - coalesce(list_sum(cw), 0)) AS common,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT} * n_words AS base_failed FROM f),
s AS (SELECT lang, {_SUMS} AS a FROM m WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang UNION ALL SELECT NULL, {_SUMS} FROM m WHERE NOT base_failed),
h AS (SELECT m.*, {_SHARE("m.classes")} AS pa, {_SHARE("s.a")} AS qa, {_SHARE("m.common")} AS pb, CASE WHEN s.a IS NOT NULL THEN {_SHARE("m.vs")} END AS qb FROM m LEFT JOIN s ON m.lang IS NOT DISTINCT FROM s.lang),
j AS (SELECT *, {_sql_js("pa", "qa")} AS ja, {_sql_js("pb", "qb")} AS jb FROM h)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(word_chars >= {LEAST_CHARS} AND ja > {MOST_CLASS} OR n_words >= {LEAST_COUNTED} AND jb > {MOST_WORDS}, false) AS kept,
  round(ja, 6) AS class_distance, round(jb, 6) AS word_distance
FROM j
"""
