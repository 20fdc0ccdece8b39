"""Spelling variants against all pairs, and what odd rows give."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from suffixloom.llm import spelling

WORDS = "word string, n bigint"


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=2):
    near = {w: [x for x in words if distance_one(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("letters", ["ab", "abcdeéÀ"])
def test_against_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): rng.choice([3, 4, 7, 8, 15, 30, 30, 61]) for _ in range(500)}
    got = rows(spelling.variants(spark.createDataFrame(list(words.items()), WORDS)))
    assert got == brute(words) and len(got) == len(words)


def test_a_long_chain_ends_at_its_root(spark):
    words = {"a" * (5 + i): 3 * 2**i for i in range(24)}
    got = rows(spelling.variants(spark.createDataFrame(list(words.items()), WORDS)))
    assert got == brute(words) and {r[2] for r in got} == {"a" * 28}


def test_a_form_with_very_many_variants(spark):
    base = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"
    words = {base[:i] + x + base[i:] for i in range(len(base) + 1) for x in "bdfhjz"} | {base[:i] + base[i + 1 :] for i in range(len(base))}
    words = dict.fromkeys(words, 3) | {base: 1000}
    assert rows(spelling.variants(spark.createDataFrame(list(words.items()), WORDS))) == brute(words)


def counts(texts, typo):
    seen = {}
    letters = {*map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x100))}
    for key, text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in "".join(c if c in letters else " " for c in low).split(" "):
            if not run:
                continue
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] = seen.get(run, 0) + 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def test_counts_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    texts = [(1, "Straße straße ÉTÉÉÉ étééé naïveté’s O’Brienne"), (1, "Straße straße ÉTÉÉÉ étééé naïveté’s O’Brienne"), (None, "Straße straße"), (2, None), (3, ""), (4, "x÷y×z… 12 – ☃"), (5, "lettersà" * 3 + " " + "straße " * 40)]
    texts += [(10 + i, " ".join(f"word{'abcdefghij'[(i * j) % 10]}{'xyz'[j % 3]}" for j in range(60))) for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").select("*", F.lit("clash").alias("word"), F.lit(1).alias("n"), F.lit(2).alias("m0"))
    got = {r.word: r.n for r in spelling.count_words(df, typo=3).collect()}
    assert got == counts(texts, 3)
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == counts(texts, 1 << 40)


def test_a_very_long_text(spark):
    text = "Wörtlich, " * 400_000 + "b" * 3_000_000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [tuple(r) for r in spelling.count_words(df).collect()] == [("wörtlich", 400_000)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(spelling.count_words(docs)).collect() == []
    assert rows(spelling.variants(spark.createDataFrame([("alone", 3)], WORDS))) == {("alone", None, "alone", 3, 0, None)}


def test_pairs_are_joined_by_equal_bands_only(spark):
    words = spelling.masks(spark.createDataFrame([("aaaaa", 3), ("aaaab", 4)], WORDS))
    groups = words.select("length", "m0", "m1", "m2", F.xxhash64("word").alias("id"), F.lit(1).alias("words"))
    plan = spelling.near_masks(groups)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert spelling.near_masks(groups).count() == 1
