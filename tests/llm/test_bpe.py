"""BPE against the tokenizers library, id for id."""

import hashlib
import os
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from suffixloom.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(None)


def check(own, library, texts):
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        got = np.frombuffer(own.encode(t), np.uint32).tolist()
        assert got == want.ids, repr(t[:80])
        assert own.decode(own.encode(t)).decode(errors="replace") == library.decode(got, skip_special_tokens=False)


def test_every_character(own, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0 or c > 0xF000 and c < 0x20000)]
    check(own, library, [f"a{c}b {c}{c} 1{c}2 {c}  {c}" for c in chars])


def test_random_texts(own, library):
    r = random.Random(4)
    parts = ["'s", "'ll", " ", "  ", "\n", "\t", "é", "日本", "don't", "<|endoftext|>", "<|endoftext", "123", "!?", "the", " ", " ", "\x1c", "🎉", "ﬀ", "́", "x" * 40]
    check(own, library, ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(3000)])


def test_long_unsplit_texts(own, library):
    r = random.Random(6)
    long = ["a" * 5000, "ab" * 4000, "é" * 3000, "=" * 7001, " " * 5001, "\n" * 3003 + "x", "日本語" * 2000, "the" * 3000]
    long += ["".join(r.choice(a) for _ in range(n)) for a in ("ab", "abc", "etaoin", "thern", "éèa", "!?.", "01") for n in (1025, 2049, 6000)]
    check(own, library, long)
    small = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), long=3)
    check(small, library, [x[:400] for x in long])


def test_join_is_exact_wherever_the_cut(own):
    r = random.Random(8)
    for _ in range(400):
        s = "".join(r.choice(r.choice(["ab", "therin ", "éaç日"])) for _ in range(r.randrange(2, 60))).encode()
        cut = r.randrange(1, len(s))
        left, right = (np.array(own.merge(x), np.uint32) for x in (s[:cut], s[cut:]))
        assert own.join(left, right).tolist() == own.merge(s) == own.piece(s).tolist()


@pytest.mark.parametrize("text", ["a" * 1_000_000, "x" + "a" * 300_001, "=-" * 200_000 + "=", "日本語" * 70_000, "ab" * 5_000 + "a" * 200_000 + "é" * 90_001, "-" * 999_999])
def test_repeating_runs_take_no_longer(own, library, text):
    """The windows do not grow over the whole run: such text takes a second or less (this machine may be slow)."""
    began = time.process_time()
    got = own.encode(text)
    assert time.process_time() - began < 3
    assert np.frombuffer(got, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_of_runs(own):
    r = random.Random(3)
    for _ in range(200):
        raw = "".join(r.choice(["a" * r.randrange(9000), "xyz" * r.randrange(3000), "".join(r.choice("qwe") for _ in range(r.randrange(5000)))]) for _ in range(4)).encode()
        cuts = own.cuts(raw)
        assert cuts[0] == 0 and cuts[-1] == len(raw) and all(0 < b - a <= own.long for a, b in zip(cuts, cuts[1:])) or not raw


def test_cuts_are_between_characters(own):
    r = random.Random(5)
    for long in (1, 3, 7, 4096):
        e = bpe.Encoder.__new__(bpe.Encoder)
        e.long = long
        for _ in range(20):
            s = "".join(r.choice(["a", "é", "日", "🎉", "日本語" * 30]) for _ in range(r.randrange(300)))
            raw = s.encode()
            cuts = e.cuts(raw)
            assert cuts[0] == 0 and cuts[-1] == len(raw) and "".join(raw[a:b].decode() for a, b in zip(cuts, cuts[1:])) == s


def test_threads_do_not_matter(library):
    r = random.Random(9)
    text = "".join(r.choice("etaoinshr") for _ in range(60_000))
    want = library.encode(text, add_special_tokens=False).ids
    for threads in (1, 2, 8):
        assert bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), threads=threads).tree(text).tolist() == want


def test_halves_run_in_parallel(own, library):
    """10 MB without a split: four threads are at least half again as fast as one (twice on four free cores), id for id the library's."""
    if len(os.sched_getaffinity(0)) < 4:
        pytest.skip("fewer than four cores")
    r = random.Random(10)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(10_000_000))
    took, got = {}, {}
    for threads in (1, 4):
        e = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), threads=threads)
        e.tree(text[:100_000])
        began = time.perf_counter()
        got[threads] = e.tree(text)
        took[threads] = time.perf_counter() - began
    print(took)
    assert got[1].tolist() == got[4].tolist()
    assert took[1] > 1.5 * took[4], took
    part = text[:1_000_000]
    assert own.tree(part).tolist() == library.encode(part, add_special_tokens=False).ids


def test_the_query_takes_long_texts_through_the_tree(spark, library, tmp_path):
    r = random.Random(11)
    texts = ["".join(r.choice(a) for _ in range(200_000)) for a in ("etaoin", "éèça", "日本語")]
    assert all(max(len(p.encode()) for p in own_pieces(t)) > 4 * bpe.LONG for t in texts)
    rows = [(k, t) for k, t in enumerate(["short one", None, *texts, *[f"before {t} after" for t in texts]])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in bpe.op8_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(want) and got[k].ids_sha256 == hashlib.sha256(np.array(want, np.uint32).tobytes()).hexdigest()


def own_pieces(text):
    return bpe.encoder(None).pieces(text)


def test_frames(spark, library):
    rows = [(1, "Hello wörld", "x"), (2, None, "y"), (None, "", None), (1, "Hello wörld", "x"), (5, "z" * 300_000, "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out, (n, ids) = bpe.encode(docs)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "ids_"]
    back, (decoded,) = bpe.decode(out, ids)
    assert all(r[decoded] == (r.text or "") and r[n] * 4 == len(r[ids]) for r in back.collect())
    trip, names = bpe.round_trip(docs)
    for r in trip.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r[names[0]] == len(want)
        assert r[names[1]] == hashlib.sha256(np.array(want, np.uint32).tobytes()).hexdigest()
        assert r[names[2]] == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0))[0].count() == 0
