"""The pipeline's stages against brute force, each on what its predecessor kept."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import test_decontaminate
import test_langid
import test_simhash
from tokenizers import Tokenizer

import corpus_pipeline
from suffixloom.llm import langid, substring
from suffixloom.llm.common import named, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output, with some odd documents besides the table's."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34 %%", None, "s", 8), (10**6 + 3, "The and of it with the thing", None, None, None), (10**6 + 3, "The and of it with the thing", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{k}")
        done = spark.read.parquet(f"{base}/{k}")
        out.append((name, docs, done))
        docs = done
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_keep_the_columns(stages):
    assert len(stages) == 5
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage(spark, stages):
    _, before, after = stages[0]
    model = langid.train(before)
    keep = []
    for i, t in rows(before):
        lang, score = test_langid.plain_prediction(model, t)
        if lang != "und" and score >= langid.MIN_SCORE:
            keep.append((i, t))
    assert rows(after) == keep
    gone = {r[0] for r in rows(before)} - {r[0] for r in rows(after)}
    assert {10**6, 10**6 + 1, 10**6 + 2} <= gone and len(gone) < 8


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    texts = rows(before)
    classes = test_simhash.brute(texts)
    keep = {i for i, _, c in classes if i == c}
    assert [r[0] for r in rows(after)] == sorted(keep, key=str)
    assert set(rows(after)) <= set(texts)


def in_order(a, b):
    """The greatest number of items that two lists have in the same order."""
    best = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            above = best[j + 1]
            best[j + 1] = max(best[j + 1], best[j], left + 1 if x == y else 0)
            left = above
    return best[-1]


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_passage_stage(spark, stages):
    """All words in 51-word windows that an earlier document has are gone; what else is gone is as alike as a passage must be."""
    _, before, after = stages[2]
    old, new = dict(rows(before)), dict(rows(after))
    assert set(new) <= set(old)
    spans = {r.row: [(p.start, p.n_words) for p in r.passages] for r in substring.by_document(substring.repeated_passages(before)).collect()}
    by_source = substring.repeated_passages(before).collect()
    lower = {i: [w.decode() for w in t.encode().lower().split()] for i, t in old.items()}
    seen, checked = set(), 0
    for i in sorted(old):
        words, hit = lower[i], set()
        windows = [tuple(words[a : a + 51]) for a in range(len(words) - 50)]
        for a, w in enumerate(windows):
            if w in seen:
                hit |= set(range(a, a + 51))
        seen.update(windows)
        gone = {w for a, n in spans.get(i, []) for w in range(a, a + n)}
        assert hit <= gone
        left = [w for k, w in enumerate(old[i].encode().split()) if k not in gone]
        assert new.get(i, "").encode().split() == left and (i in new or not left)
        if not gone:
            assert new[i] == old[i]
    for p in by_source:
        if p.n_words < 400:
            own = shingles(lower[p.row][p.start : p.start + p.n_words])
            assert p.src < p.row and p.n_words >= 51 and in_order(own, shingles(lower[p.src])) >= 0.8 * len(own) - 1e-9
            checked += 1
    assert checked or not by_source


def test_extra_columns_with_clashing_names(spark, stages):
    """Columns that operators use inside pass through every stage but the last as they are."""
    names = ["_number", "a.b", "n_hit", "fp", "row", "cut", "lang_pred", "score", "spans", "c0"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, whole, SF), name)
        assert out.columns == whole.columns
        for r in out.select("doc_id", *[named(n) for n in names]).collect():
            assert tuple(r)[1:] == tuple(f"{n}{r.doc_id}" for n in names)
        whole = out
    last = corpus_pipeline.STAGES[-1][1](spark, whole, SF)
    assert last.columns == stages[-1][2].columns and last.count() == whole.count()


def test_benchmark_stage(spark, stages):
    _, before, after = stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in test_decontaminate.brute(rows(before), items) if r[-1]}
    assert rows(after) == [r for r in rows(before) if r[0] not in bad]


def test_token_stage(stages):
    _, before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in after.collect()}
    assert len(got) == before.count()
    for i, text in rows(before):
        ids = np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        assert got[i].n_tokens == len(ids) and bytes(got[i].ids) == ids.tobytes()
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_run_and_empty_table(spark, stages, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == stages[-1][2].columns and whole.count() > 50
