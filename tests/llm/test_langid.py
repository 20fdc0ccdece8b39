"""Language identification: held-out accuracy, score range, and odd rows."""

import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from suffixloom.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_whole_texts(spark):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = langid.op5_langid(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id]["lang"] for r in test)
    assert len(test) > 150 and right / len(test) > 0.97


def test_features_do_not_depend_on_the_slices():
    texts = ["Der Hund", "", None, "x", "éàü ça", "a" * 50, "  %% 12 ", "The of and"]
    whole = langid.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert np.array_equal(whole[i], langid.features(pa.array([t], pa.string()))[0])
    old, langid._CHUNK = langid._CHUNK, 7
    try:
        assert np.allclose(whole, langid.features(pa.array(texts, pa.string())))
    finally:
        langid._CHUNK = old


def sentences(lang, n, seed):
    r = np.random.default_rng(seed)
    words = {"en": "the and of to with thing that".split(), "de": "der und die nicht ein mit sich".split(), "fr": "le et les que dans pour une".split(), "xx": "zzq qqz zqzq qzz".split()}[lang]
    return [" ".join(r.choice(words, 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def mixed():
    rows = [(k * 10 + i, t, lang) for i, lang in enumerate(("en", "de", "fr", "xx")) for k, t in enumerate(sentences(lang, 40, i))]
    rows += [(5000, None, "en"), (5001, "", "en"), (5002, "123 ... %%", "de"), (None, "the and of to that", "fr"), (5003, "the and of with that thing", None), (5003, "the and of with that thing", None), (5004, "der und die nicht " * 200_000, None)]
    return rows


def test_families_unknown_labels_and_odd_rows(spark, mixed):
    docs = spark.createDataFrame(mixed, "doc_id bigint, text string, lang string").withColumnRenamed("doc_id", "score").selectExpr("score as doc_id", "text", "lang", "'s' as score")
    model = langid.train(docs)
    assert sorted(model.families) == ["=xx", "germanic", "romance"]
    out, (pred, score) = langid.predict(docs, model)
    assert (pred, score) == ("lang_pred", "score_")
    for r in out.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r[pred], r[score]) == ("und", 0.0)
        elif r.lang and r.doc_id is not None:
            assert r[pred] == r.lang
        assert 0 <= r[score] <= 1
    kept = langid.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(mixed) - 3


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the and", None), (2, "..", None)], "doc_id bigint, text string, lang string")
    out, (pred, score) = langid.predict(docs, langid.train(docs))
    assert [(r[pred], r[score]) for r in out.collect()] == [("und", 0.0)] * 2
    assert [r.doc_id for r in langid.keep(docs).collect()] == [1]
    one = spark.createDataFrame([(1, "the and", "en"), (3, "of it", "en"), (2, "..", None)], "doc_id bigint, text string, lang string")
    out, (pred, _) = langid.predict(one, langid.train(one))
    assert sorted(r[pred] for r in out.collect()) == ["en", "en", "und"]
    assert langid.keep(docs.limit(0)).count() == 0


def plain_features(text, dimensions=langid.DIMENSIONS):
    """Counts of byte pairs and triples, one by one."""
    letters = [b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in (text or "").encode()]
    counts, bits = np.zeros(dimensions), dimensions.bit_length() - 1
    for n in (2, 3):
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            if gram[:2] == [0x20, 0x20] or gram[-2:] == [0x20, 0x20]:
                continue
            code = sum(b << 8 * (n - 1 - k) for k, b in enumerate(gram))
            counts[((code + (n << 28)) % 2**32 * 2654435761 % 2**32) >> (32 - bits)] += 1
    return np.sqrt(counts / max(1, counts.sum()))


def plain_prediction(model, text):
    """The family with the greatest share of the families' probabilities, then all pairs of its languages vote."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = plain_features(text)
    chance = lambda *name: 1 / (1 + np.exp(-(x @ model.weights[:-1, at[name]] + model.weights[-1, at[name]]) * model.slopes[at[name]]))
    at = {c: i for i, c in enumerate(model.columns)}
    families = {f: chance("family", f) if len(model.families) > 1 else 1.0 for f in model.families}
    family = max(families, key=families.get)
    votes = {}
    for lang in model.families[family]:
        rest = [o for o in model.families[family] if o != lang]
        votes[lang] = sum(chance("pair", lang, o) if ("pair", lang, o) in at else 1 - chance("pair", o, lang) for o in rest) / len(rest) if rest else 1.0
    best = max(votes, key=votes.get)
    return best, families[family] / sum(families.values()) * votes[best]


def test_features_against_brute_force():
    r = np.random.default_rng(2)
    texts = ["", None, "a", "ab", "  a  b ", "Ünï cödé", "日本 語", *["".join(r.choice(list("abC é.9 \n"), 60)) for _ in range(50)]]
    got = langid.features(pa.array(texts, pa.string()))
    for row, t in zip(got, texts):
        assert np.allclose(row, plain_features(t), atol=1e-6)


def test_predictions_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    out, (pred, score) = langid.predict(docs, model)
    for r in out.collect():
        lang, s = plain_prediction(model, r.text)
        assert r[pred] == lang and abs(r[score] - s) < 1e-3


def test_svm_is_solved():
    """Weights are the dual's, the dual is feasible, and the gap to the primal objective is small."""
    r = np.random.default_rng(1)
    for _ in range(5):
        n, d = 120, 30
        y = np.where(r.random(n) < 0.3, 1.0, -1.0)
        x = (r.normal(size=(n, d)) + 0.4 * y[:, None]).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        w, alpha, cost = langid.solve_svm(x, y, passes=2000)
        whole = np.hstack([x, np.ones((n, 1))]).astype(np.float64)
        assert np.allclose(w, (alpha * y) @ whole) and (alpha >= 0).all() and (alpha <= cost).all()
        primal = w @ w / 2 + (cost * np.maximum(0, 1 - y * (whole @ w))).sum()
        dual = alpha.sum() - w @ w / 2
        assert dual <= primal + 1e-9 and primal - dual < 0.02 * primal


def test_a_repeated_id_teaches_once(spark, monkeypatch):
    texts = [(i, f"the cat and the dog number {i}", "en") for i in range(1, 40)] + [(i, f"der Hund und die Katze Nummer {i}", "de") for i in range(101, 140)]
    hot = [(2, f"the very same id again {i}", "en") for i in range(3000)]
    sizes = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, labels, families=None: sizes.append(len(labels)) or fit(x, labels, families))
    schema = "doc_id bigint, text string, lang string"
    langid.train(spark.createDataFrame(texts, schema), sample=10_000)
    langid.train(spark.createDataFrame(texts + hot, schema), sample=10_000)
    assert sizes[0] == sizes[1] > 0


def test_fitting_grows_with_the_languages_not_their_square():
    """100 languages: each is fitted against a bounded rest, and rows are sparse, so the driver stays under 2 GB."""
    import resource

    r, names = np.random.default_rng(5), [f"l{k:02}" for k in range(92)] + ["en", "de", "fr", "es", "ar", "fa", "zh", "ja"]
    rows, labels = [], []
    for name in names:
        own = r.choice(langid.DIMENSIONS, 300, replace=False)
        for _ in range(100):
            at = np.unique(np.r_[r.choice(own, 60), r.integers(0, langid.DIMENSIONS, 60)])
            rows.append((at.astype(np.uint16).tobytes(), np.full(len(at), len(at) ** -0.5, np.float32).tobytes()))
            labels.append(name)
    began = time.time()
    model = langid.fit(langid.Sample(rows), labels, rest=800)
    took = time.time() - began
    print(f"{took:.0f} s, {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10} MB")
    assert sum(c[0] == "family" for c in model.columns) == 92 + 4
    assert took < 120 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2 << 20
    some = np.arange(0, len(rows), 20)
    x = langid.Sample(rows)[some]
    margins = x @ model.weights[:-1] + model.weights[-1]
    families = [k for k, c in enumerate(model.columns) if c[0] == "family"]
    got = np.array([model.columns[k][1].lstrip("=") for k in families], object)[margins[:, families].argmax(axis=1)]
    known = {lang: f for f, langs in langid.FAMILIES.items() for lang in langs}
    assert np.mean([g == known.get(labels[i], labels[i]) for g, i in zip(got, some)]) > 0.98


def test_the_rest_is_dealt_evenly():
    r = np.random.default_rng(6)
    sizes = {"aa": 40, "bb": 3, "cc": 200, "dd": 200}
    labels = [lang for lang, n in sizes.items() for _ in range(n)]
    x = r.normal(size=(len(labels), 16)).astype(np.float32)
    seen, solve = [], langid.solve_svm
    langid.solve_svm = lambda part, y, **o: seen.append((len(y), int((y > 0).sum()))) or solve(part, y, **o)
    try:
        langid.fit(x, labels, rest=103)
        langid.fit(x, labels, rest=10_000)
    finally:
        langid.solve_svm = solve
    assert seen[:4] == [(143, 40), (106, 3), (303, 200), (303, 200)]
    assert seen[4:] == [(443, n) for n in sizes.values()]


def test_languages_of_most_rows_are_learned(spark):
    rows = [(k, "the and of", "en") for k in range(9)] + [(k, "der und die", "de") for k in range(20, 28)] + [(40, "le et les", "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, languages=2)
    assert sorted(lang for own in model.families.values() for lang in own) == ["de", "en"]
