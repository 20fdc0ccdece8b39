"""Toxicity: the automaton against plain distances, models on made texts, held-out texts, and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from suffixloom.llm import toxicity
from suffixloom.llm.toxicity import Automaton, Model, Scanner, edits_allowed

SF = "/root/testdata/sf0.001"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def nearest(word, terms, stems):
    found = min(((levenshtein(word, t), -len(t), t) for t in terms if levenshtein(word, t) <= edits_allowed(t)), default=None)
    if found and not found[0]:
        return found[2], 0
    stem = max((s for s in stems if word.startswith(s)), key=len, default=None)
    return (stem + "*", 0) if stem else (found[2], found[0]) if found else None


def test_automaton_against_plain_distances(monkeypatch):
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(2, 10))) for _ in range(60)})
    stems = ["abca", "cab", "éé"]
    one, small = Automaton(terms, stems), Automaton(terms, stems)
    monkeypatch.setattr(toxicity, "MOST_POSITIONS", 500)  # states are dropped and made again
    for _ in range(4000):
        word = "".join(rng.choice("abcéx") for _ in range(rng.randint(0, 11))) if rng.random() < 0.5 else _typo(rng, rng.choice(terms))
        assert one.find(word) == small.find(word) == nearest(word, terms, stems)


def _typo(rng, word):
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(word) + 1)
        word = rng.choice([word[:i] + rng.choice("abcx") + word[i:], word[:i] + word[i + 1 :], word[:i] + "b" + word[i + 1 :]])
    return word


BAD = ["blockhead", "nitwit", "scoundrel"]


def made(n, seed, quoted=0, first=0):
    """Texts of chance words; toxic ones say a bad word, others may quote one."""
    rng = random.Random(seed)
    chance = lambda k: ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(k)]
    rows = []
    for i in range(n):
        words, toxic = chance(40), int(i % 4 == 0)
        if toxic:
            words[rng.randrange(40)] = rng.choice(BAD) + rng.choice(["", ",", "!"])
        elif i % 8 == 1 and quoted:
            words[20] = f'reported "{rng.choice(BAD)}" yesterday'
        rows.append((first + i, " ".join(words).capitalize(), toxic))
    return rows


def taught(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return toxicity.train(df, df.select("doc_id", "toxic"), F.lit(True), **options)


def predicted(spark, rows, model):
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    out, (score, label) = toxicity.predict(df, model)
    got = {r.doc_id: (r[score], r[label]) for r in out.collect()}
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())
    return {k: p for k, (_, p) in got.items()}


def test_terms_misspellings_and_other_words(spark):
    model = taught(spark, made(400, 1))
    assert set(model.terms) == set(BAD)
    fresh = made(80, 2)
    assert predicted(spark, fresh, model) == {i: t for i, _, t in fresh}
    odd = [(1, "you are a blockhaed, no: a bl0ckhead", 1), (2, "what a scoundr3l", 1), (3, "what a s$oundrel!", 1), (4, "a block and a head", 0), (5, "SCOUNDREL!!!", 1)]
    assert predicted(spark, odd, model) == {i: t for i, _, t in odd}


def test_quotation_is_told_from_abuse(spark):
    model = taught(spark, made(800, 3, quoted=1))
    assert set(model.terms) == set(BAD) and model.contexts["reported"] < 0 and model.contexts['"'] < 0
    fresh = made(80, 4, quoted=1)
    assert predicted(spark, fresh, model) == {i: t for i, _, t in fresh}


def test_a_near_word_of_other_texts_is_harmless(spark):
    rows = made(400, 5) + [(1000 + i, f"number {i} says nitwits and more {i * 7} of it", 0) for i in range(100)]
    model = taught(spark, rows)
    assert "nitwits" in model.harmless
    assert predicted(spark, [(1, "nitwits all", 0), (2, "nitwit all", 1)], model) == {1: 0, 2: 1}


def test_stems_of_terms(spark):
    rng = random.Random(6)
    rows = [(i, t.replace(next((b for b in BAD if b in t), "~"), "grumblo" + rng.choice(["x", "yy", "zet", "wig"])), toxic) for i, t, toxic in made(600, 6)]
    model = taught(spark, rows)
    assert len(model.terms) == 4 and list(model.stems) == ["grum"]
    assert predicted(spark, [(1, "grumbloquatsch", 1), (2, "gruel", 0)], model) == {1: 1, 2: 0}


def test_copies_share_a_vote(spark):
    rows = made(400, 7)
    copied = "quillon abrazo marmoset " * 10 + " ".join(f"w{i}" for i in range(60))
    copies = [(1000 + i, copied, 1) for i in range(60)] + [(2000 + i, f"{copied} n{i}", 1) for i in range(60)]
    rows += copies + [(3000, rows[0][1], 1)] * 50  # rows that repeat an id and text
    model = taught(spark, rows)
    assert set(model.terms) == set(BAD)


def test_a_bounded_sample_teaches(spark):
    df = spark.createDataFrame(made(400, 9), "doc_id bigint, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    assert toxicity.teachers(df, labels, F.lit(True)).count() == 400
    some = toxicity.teachers(df, labels, F.lit(True), most=100)
    assert 60 < some.count() < 140 and "SortMergeJoin" not in some._jdf.queryExecution().executedPlan().toString()


def test_odd_rows_and_empty_tables(spark):
    rows = made(200, 8) + [(None, "blockhead", 1), (900, None, 1), (901, "", 0), (902, "... !!", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = df.select("doc_id", F.when(F.col("doc_id") % 50 == 1, None).otherwise(F.col("toxic")).alias("toxic"))
    model = toxicity.train(df, labels.unionByName(labels.limit(30)), F.lit(True))
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "..."), (None, "Blockhead!")], "doc_id bigint, text string").select("*", F.lit("x").alias("score"), F.lit(3).alias("n0"), F.lit("y").alias("a.b"))
    out, names = toxicity.predict(odd, model)
    assert names == ["score_", "predicted"] and out.columns == [*odd.columns, *names]
    got = out.collect()
    assert [r.score for r in got] == ["x"] * 5 and sorted((str(r.doc_id), r.predicted) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("3", 0), ("None", 1)]
    assert len({r.score_ for r in got if r.doc_id}) == 1
    for some in (df.limit(0), df.filter("toxic = 1")):
        plain = toxicity.train(some, labels, F.lit(True))
        assert plain.terms == {} and {r.predicted for r in toxicity.predict(df, plain)[0].collect()} == {0}
    assert toxicity.predict(odd.limit(0), model)[0].count() == 0


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_a_long_text_is_scanned_whole(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    text = "İ stands here. " + "and so on it goes\n" * 500 + 'he said "nitwit" to' + " x" * 3000 + " nitwit"
    hits = list(Scanner(BAD, []).hits(text))
    assert [(h[0], h[1], h[2]) for h in hits] == [("nitwit", "nitwit", 0)] * 2
    assert ['"' in Scanner.context(*h[3:]) for h in hits] == [True, False]
    model = Model({b: 9.0 for b in BAD})
    assert toxicity.evidence(model, Scanner(BAD, []), text) == pytest.approx(model.base + 9)


def test_query_is_whole_and_holds_rows_out(spark):
    import zlib

    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    df = toxicity.op11_toxicity(spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = df.collect()
    assert {r.doc_id for r in got} == docs and len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
