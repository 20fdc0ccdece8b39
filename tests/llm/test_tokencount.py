"""Token counts against a plain best-path search for each pre-token."""

import random

import public_tokenizers
import pytest
import regex

from suffixloom.llm import tokencount as t

SCORES = t.load_scores(public_tokenizers.path(t.VOCABULARY))


def plain(token, scores=SCORES):
    best = [(0, 0)] + [None] * len(token)
    for i in range(1, len(token) + 1):
        for j in range(i):
            s = scores.get(token[j:i])
            if s is not None and (best[i] is None or (best[j][0] + s, best[j][1] - 1) > best[i]):
                best[i] = best[j][0] + s, best[j][1] - 1
    return -best[-1][1]


def tokens():
    r = random.Random(1)
    alphabets = ["abc", "therinsao ", "éèçñ", "日本語🎉", "0123", "!?.=", "\x00\xff"]
    return ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randrange(1, 30))).encode() for _ in range(1500)] + [b" the", b" then", b" the", b"thethethe"]


def test_trie_against_plain_search():
    trie = t.Trie(SCORES)
    for token in tokens():
        assert trie.tokens(token) == plain(token)
    assert len(trie.score) < 1 + sum(map(len, tokens()))  # prefixes are shared


def test_long_pretokens_need_no_nodes():
    trie = t.Trie(SCORES)
    r = random.Random(2)
    for n in (t.LONG + 1, 700, 1500):
        for a in ("a", "ab", "therin", "é", "="):
            token = "".join(r.choice(a) for _ in range(n)).encode()
            assert trie.tokens(token) == plain(token)
    assert len(trie.score) == 1


def test_scores_are_negative_and_fall_with_rank():
    ordered = sorted(SCORES.values(), reverse=True)
    assert ordered[0] < 0 and ordered[-1] > -30e6 and all(bytes([b]) in SCORES for b in range(256))


def test_frames(spark, monkeypatch):
    r = random.Random(3)
    text = lambda: " ".join(r.choice(["the", "Größe", "x1", "don't", "=====", "日本"]) for _ in range(50))
    rows = [(k, text(), "s") for k in range(30)] + [(None, None, None), (1, "", "s"), (1, "", "s"), (2, "z" * 100_000, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    out, (a, b) = t.count_tokens(df)
    assert out.columns == [*df.columns, "n_pretokens", "n_tokens_"] and b == "n_tokens_"
    for x in out.collect():
        parts = regex.findall(public_tokenizers.PATTERN, x.text or "")
        assert x[a] == len(parts)
        if len(x.text or "") < 1000:
            assert x[b] == sum(plain(p.encode()) for p in parts)
    assert t.count_tokens(df.limit(0))[0].count() == 0


def test_starting_afresh_changes_nothing(monkeypatch):
    c = t.Counter(public_tokenizers.path(t.VOCABULARY))
    texts = ["the thing that then there", "other another mother", "the thing", ""] * 3
    want = [c.text(x) for x in texts]
    monkeypatch.setattr(t, "MOST_NODES", 5)
    monkeypatch.setattr(t, "MOST_KNOWN", 2)
    assert [c.text(x) for x in texts] == want


def unigram(r, tmp_path, fallback=False):
    """A tokenizers JSON of made pieces and scores, the library's own reading of it, and the same as lines where lines can say it."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = "abcdeté日本"
    pieces = {t.SPACE, *letters[:7]} | {r.choice([t.SPACE, ""]) + "".join(r.choice(letters) for _ in range(r.randrange(1, 5))) for _ in range(400)}
    vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", -20.0) for b in range(256)] * fallback + [(p, -r.uniform(2, 15)) for p in sorted(pieces)]
    own = Tokenizer(models.Unigram(vocab, 0, fallback))
    own.pre_tokenizer = pre_tokenizers.Metaspace()
    own.save(str(tmp_path / "unigram.json"))
    (tmp_path / "unigram.vocab").write_text("".join(f"{p}\t{x!r}\n" for p, x in vocab))
    return own


def texts(r):
    made = ["".join(r.choice("abcdeté日本  zß🎉") for _ in range(r.randrange(0, 60))) for _ in range(600)]
    return made + ["", " ", "  a", "zzz", "🎉🎉a🎉", "zz ab zz", "abc" * 300, "z" * 700, "日z" * 200, "\n\ta"]


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_models_count_as_their_tokenizer(tmp_path, fallback):
    r = random.Random(7)
    own = unigram(r, tmp_path, fallback)
    for name in ("unigram.json", "unigram.vocab"):
        c = t.Counter(str(tmp_path / name))
        for x in texts(r):
            assert c.text(x)[1] == len(own.encode(x, add_special_tokens=False).ids), (name, x)


def test_unigram_models_in_frames(spark, tmp_path):
    r = random.Random(8)
    own = unigram(r, tmp_path)
    rows = [(k, x) for k, x in enumerate(texts(r))] + [(None, None), (3, "abc"), (3, "abc")]
    out, (_, n) = t.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), path=str(tmp_path / "unigram.json"))
    got = out.collect()
    assert len(got) == len(rows) and all(x[n] == len(own.encode(x.text or "", add_special_tokens=False).ids) for x in got)


def test_files_that_are_no_unigram_model_are_refused(tmp_path):
    (tmp_path / "empty.vocab").write_text("<unk>\t0\n")
    for path in (public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "empty.vocab")):
        with pytest.raises(ValueError):
            t.load_model(path)
