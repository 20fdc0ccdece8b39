"""Substring deduplication: planted passages, parts against brute force, odd rows."""

import random

import numpy as np
import pytest

from suffixloom.llm import substring as s
from suffixloom.llm.common import WordScanner, nonspace_bytes, window_hashes


def words(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def edited(r, passage, every):
    out = list(passage)
    for at in range(every // 2, len(out), every):
        out[at] = f"e{r.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def planted():
    """Rows, and for each document the words that repeat an earlier one."""
    r = random.Random(11)
    rows, want, known = [], {}, []
    for k in range(60):
        doc, hit, new = [], set(), []
        for _ in range(r.randrange(1, 4)):
            doc += words(r, r.randrange(0, 200))
            if known and r.random() < 0.7:
                p = r.choice(known)
                a = r.randrange(len(p) - 51)
                p = p[a : a + r.randrange(51, len(p) - a + 1)]
                if r.random() < 0.4:
                    p = edited(r, p, 60)
                hit |= set(range(len(doc), len(doc) + len(p)))
                doc += p
            elif r.random() < 0.5:
                p = words(r, r.randrange(60, 400))
                new.append(p)
                doc += p
        known += new
        rows.append((k, " \n".join(doc)))
        want[k] = hit
    return rows, want


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as doc", "'x' as src", "2 as h")
    return s.repeated_passages(df, **options).collect()


def covered(out):
    got = {}
    for x in out:
        got.setdefault(x.row, set()).update(range(x.start, x.start + x.n_words))
    return got


def test_planted_passages_are_found_and_no_others(spark, planted):
    rows, want = planted
    texts = {k: t.lower().split() for k, t in rows}
    for options in ({}, {"hot": 3}):
        out = found(spark, rows, **options)
        got = covered(out)
        for k, hit in want.items():
            own = got.get(k, set())
            assert len(hit - own) <= 0.1 * len(hit), k  # an edit near an end may cost what lies beyond it
            assert not own - hit, k
        for x in out:
            assert x.src < x.row and x.n_words >= s.MIN_WORDS and x.similarity >= s.SIMILARITY
            a, b = texts[x.row][x.start : x.start + 5], texts[x.src][x.src_start : x.src_start + 5]
            assert a == b


def test_every_exact_passage_of_51_words_is_found(spark):
    r = random.Random(5)
    rows = []
    for k in range(40):
        p = words(r, 51)
        rows += [(2 * k, " ".join([*words(r, r.randrange(80)), *p, *words(r, r.randrange(80))]))]
        rows += [(2 * k + 1, "  ".join([*words(r, r.randrange(80)), *p, *words(r, r.randrange(80))]).upper())]
    out = found(spark, rows)
    assert sorted((x.row, x.src, x.n_words) for x in out) == [(2 * k + 1, 2 * k, 51) for k in range(40)]


def test_shorter_or_looser_repeats_are_left_alone(spark):
    r = random.Random(6)
    p, q = words(r, 50), words(r, 300)
    rows = [(1, " ".join([*words(r, 90), *p, *words(r, 90), *q])), (2, " ".join([*words(r, 40), *p, *words(r, 90)])), (3, " ".join(edited(r, q, 12)))]
    assert found(spark, rows) == []


def test_odd_rows(spark):
    r = random.Random(7)
    p = " ".join(words(r, 80))
    rows = [(1, None), (2, ""), (3, "short text"), (4, p), (4, p), (None, p), (None, None), (9, f"{p} {p}")]
    out = found(spark, rows)
    # of the rows with this passage the first in the table keeps it; the last has it twice
    assert sorted((str(x.row), x.start, x.n_words) for x in out) == [("4", 0, 80), ("9", 0, 80), ("9", 80, 80), ("None", 0, 80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'y' as _doc", "1 as _numbers", "2 as `a.b`", "3 as cut")
    cut = s.deduplicate(df)
    assert cut.columns == df.columns
    assert sorted(((x.doc_id, x.text) for x in cut.collect()), key=str) == sorted([(1, None), (2, ""), (3, "short text"), (4, p), (None, None)], key=str)
    assert {tuple(x)[2:] for x in cut.collect()} == {("y", 1, 2, 3)}
    assert s.repeated_passages(df.limit(0)).count() == 0 and s.deduplicate(df.limit(0)).count() == 0


def test_repeats_inside_a_document(spark):
    r = random.Random(21)
    line, p, q = words(r, 12), words(r, 60), words(r, 51)
    texts = [line * 8, [*words(r, 5), *p, *words(r, 3), *p, *words(r, 9), *p], [*p, *words(r, 30), *q, *p[:50], *q], words(r, 200), ["a"] * 300, [], words(r, 51) * 2]
    texts += [[r.choice("ab") for _ in range(r.randrange(400))] for _ in range(20)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]

    def brute(t):
        seen, hit = {}, set()
        for i in range(len(t) - 50):
            if seen.setdefault(tuple(t[i : i + 51]), i) < i:
                hit |= set(range(i, i + 51))
        return hit

    docs = spark.createDataFrame(rows, "doc bigint, text string")
    out = s.repeats_inside(docs).collect()
    got = {}
    for x in out:
        t = texts[x.doc]
        assert x.src == x.doc and x.src_start < x.start and t[x.start : x.start + x.n_words] == t[x.src_start : x.src_start + x.n_words]
        got.setdefault(x.doc, set()).update(range(x.start, x.start + x.n_words))
    assert got == {k: brute(t) for k, t in enumerate(texts) if brute(t)}
    df = docs.withColumnRenamed("doc", "doc_id")
    left = {x.doc_id: x.text.split() for x in s.deduplicate(df.filter("doc_id < 2"), inside=True).collect()}
    assert left[0] == line and left[1] == [w for i, w in enumerate(texts[1]) if i not in brute(texts[1])]


def test_many_chains_at_once_are_as_one_by_one():
    r = np.random.default_rng(4)
    lefts, rights, turns = [], [], []
    for _ in range(200):
        p = r.integers(0, r.choice([6, 10**6]), 90).astype(np.uint32)
        noise = lambda n: r.integers(0, r.choice([6, 10**6]), n).astype(np.uint32)
        q = p.copy()
        q[r.integers(0, 90, r.integers(0, 8))] = 7
        cut = int(r.integers(0, 90))
        q = np.concatenate([q[:cut], noise(int(r.integers(0, 4))), q[cut:]])
        a, b = noise(int(r.integers(0, 60))), noise(int(r.integers(0, 60)))
        lefts.append(np.concatenate([a, p, noise(20)]))
        rights.append(np.concatenate([b, q, noise(30)]))
        turns.append(np.array([[len(a), len(b), 8]]))
    got = s.align_all(lefts, rights, turns, 51, 0.8)
    cover = lambda found: sum(n for _, n, _, _ in found)
    for x, y, t, found in zip(lefts, rights, turns, got):
        one = s.align(x, y, [tuple(v) for v in t.tolist()], 51, 0.8)
        assert cover(found) >= cover(one) and (found or not one)
        for a, n, b, share in found:
            assert n >= 51 and share >= 0.8 - 1e-9
    assert sum(map(bool, got)) > 100


def test_long_text_and_repeated_words(spark):
    long = " ".join(f"v{k}" for k in range(120_000))
    rows = [(1, long), (2, "intro " + long), (3, "the " * 30_000), (4, "the " * 20_000)]
    got = covered(found(spark, rows))
    assert got[2] == set(range(1, 120_001)) and len(got[4]) > 19_000


def test_runs_of_one_word(spark):
    r = random.Random(12)
    lone = lambda n: " ".join(words(r, n))
    rows = [(1, f"{lone(9)} " + "to " * 30 + lone(9)), (2, f"{lone(7)} " + "to " * 90 + lone(9)), (3, f"{lone(4)} " + "to " * 200 + lone(9)), (4, "to " * 50 + lone(30))]
    out = found(spark, rows)
    assert {(x.row, x.src) for x in out} == {(3, 2)}
    assert covered(out)[3] == set(range(4, 204))


def test_deduplicate_cuts_passages_only(spark):
    r = random.Random(9)
    a, p, b, c = (" ".join(words(r, n)) for n in (30, 70, 40, 20))
    df = spark.createDataFrame([(5, f"{a}\n{p}\n{b}", "x"), (6, f"{c}\t{p} {a}", "y"), (7, p, "z")], "doc_id bigint, text string, lang string")
    got = {x.doc_id: x.text for x in s.deduplicate(df).collect()}
    assert got == {5: f"{a}\n{p}\n{b}", 6: f"{c}\t {a}"}


def test_by_document_merges(spark):
    df = spark.createDataFrame([(1, 0, 60, 7), (1, 50, 60, 8), (1, 200, 51, 7), (2, 3, 51, 1)], "row bigint, start bigint, n_words bigint, src bigint")
    got = {x.row: (x.n_repeated, x.n_passages, [tuple(p) for p in x.passages], x.sources) for x in s.by_document(df).collect()}
    assert got == {1: (161, 2, [(0, 110), (200, 51)], [7, 8]), 2: (51, 1, [(3, 51)], [1])}


def test_minimizers_against_brute_force():
    r = np.random.default_rng(1)
    scanner = WordScanner(nonspace_bytes(), step=64)
    for _ in range(60):
        rows = [" ".join(f"w{x}" for x in r.integers(0, r.integers(2, 50), r.integers(0, 70))) for _ in range(r.integers(1, 6))]
        data = "".join(rows).encode()
        offsets = np.r_[0, np.cumsum([len(x) for x in rows])]
        starts, ends, hashes, bounds = scanner.scan(np.frombuffer(data, np.uint8), offsets)
        assert [data[a:b].decode() for a, b in zip(starts, ends)] == [w for x in rows for w in x.split()]
        k, w = int(r.integers(1, 6)), int(r.integers(1, 9))
        want = {}
        for i in range(len(rows)):
            h = window_hashes(hashes[bounds[i] : bounds[i + 1]], k)
            for at in range(max(1, len(h) - w + 1)) if len(h) else ():
                part = h[at : at + w]
                for j in np.flatnonzero(part == part.min())[: None if len(h) >= w else 1]:
                    want[int(bounds[i]) + at + int(j)] = int(part.min())
        at, h = s.minimizers(hashes, bounds, k, w)
        got = dict(zip(at.tolist(), h.tolist()))
        assert got.items() <= want.items()
        for x in set(want) - set(got):  # left out only where the same seed was taken shortly before
            assert any(got.get(x - d) == want[x] for d in range(1, w))


def plain_chain(x, y, n, cost):
    score = [0.0] * len(x)
    for i in sorted(range(len(x)), key=lambda i: (x[i], y[i])):
        score[i] = n[i] + max([0.0] + [score[j] - cost * (x[i] - x[j] - n[j] + y[i] - y[j] - n[j]) for j in range(len(x)) if x[j] + n[j] <= x[i] and y[j] + n[j] <= y[i]])
    return max(score)


def test_chain_scores_against_all_predecessors():
    r = random.Random(2)
    for _ in range(300):
        m = r.randrange(1, 14)
        x, y, n = sorted(r.randrange(120) for _ in range(m)), [r.randrange(120) for _ in range(m)], [r.randrange(3, 15) for _ in range(m)]
        best = 0
        out = s.chain(x, y, n, 0.1)
        assert sorted(i for c in out for i in c) == list(range(m))
        for c in out:
            got = n[c[0]]
            for a, b in zip(c, c[1:]):
                assert x[a] + n[a] <= x[b] and y[a] + n[a] <= y[b]
                got += n[b] - 0.1 * (x[b] - x[a] - n[a] + y[b] - y[a] - n[a])
            best = max(best, got)
        assert abs(best - plain_chain(x, y, n, 0.1)) < 1e-9


def test_replaced_and_inserted_phrases_do_not_end_a_passage(spark):
    r = random.Random(21)
    rows, want = [], {}
    for n in range(1, 21):
        for kind in ("replaced", "inserted", "left out"):
            p, at = words(r, 140 + n), 45 + r.randrange(40)
            q = p[:at] + (words(r, n) if kind != "left out" else []) + p[at + n * (kind != "inserted") :]
            a, b = words(r, r.randrange(70)), words(r, r.randrange(70))
            rows += [(len(rows), " ".join([*words(r, r.randrange(70)), *p, *words(r, r.randrange(70))]))]
            want[len(rows)] = (len(a), len(q))
            rows += [(len(rows), " ".join([*a, *q, *b]))]
    assert {x.row: (x.start, x.n_words) for x in found(spark, rows)} == want
    p = words(r, 106)
    assert [(x.n_words, round(x.similarity, 2)) for x in found(spark, [(1, " ".join(p)), (2, " ".join(p[:50] + words(r, 6) + p[56:]))])] == [(106, 0.90)]


def plain_stretches(good, least, similarity):
    best = None
    for a in range(len(good)):
        for b in range(a + least, len(good) + 1):
            if good[a] and good[b - 1] and sum(good[a:b]) >= similarity * (b - a) - 1e-9 and (best is None or b - a > best[1] - best[0]):
                best = a, b
    if best is None:
        return []
    a, b = best
    return plain_stretches(good[:a], least, similarity) + [best] + [(b + x, b + y) for x, y in plain_stretches(good[b:], least, similarity)]


def test_stretches_against_all_stretches():
    r = random.Random(22)
    for _ in range(400):
        good = [r.random() < p for p in [r.choice((0.5, 0.8, 0.95))] for _ in range(r.randrange(0, 60))]
        least, similarity = r.randrange(1, 20), r.choice((0.6, 0.8, 1.0))
        got, want = s.stretches(np.array(good, bool), least, similarity), plain_stretches(good, least, similarity)
        assert [b - a for a, b in got][:1] == [b - a for a, b in want][:1] or max(b - a for a, b in got) == max(b - a for a, b in want)
        assert bool(got) == bool(want)
        for a, b in got:
            assert b - a >= least and good[a] and good[b - 1] and sum(good[a:b]) >= similarity * (b - a) - 1e-9


@pytest.mark.parametrize("equal", [(24, 24, 24), (34, 35)])
def test_a_loosely_alike_tail_does_not_hide_a_passage(equal):
    r = random.Random(23)
    left = []
    for n in equal:
        left += [*range(len(left), len(left) + n), *(-1 - r.randrange(10**6) for _ in range(1 if len(equal) == 3 else 5))]
    size = len(left) - (1 if len(equal) == 3 else 5)
    for _ in range(12):  # one equal shingle after every five that are not
        left += [*range(len(left), len(left) + 5), -1 - r.randrange(10**6)]
    right = np.arange(len(left), dtype=np.uint32)
    out = s.align(np.array(left).astype(np.uint32), right, [(0, 0, equal[0])], 51, 0.8)
    assert len(out) == 1 and out[0][0] == 0 and out[0][1] >= size and out[0][3] >= 0.8


def test_weakest_passages_hold_a_seed(spark):
    r = random.Random(24)
    rows, want = [], {}
    for k in range(360):
        p = words(r, (54, 56, 60)[k % 3])
        q = list(p)
        for at in (len(p) // 3, 2 * len(p) // 3):
            q[at] = words(r, 1)[0]
        if k % 6 == 5:  # three words left out, four runs of 16
            p = words(r, 67)
            q = [w for i, w in enumerate(p) if i not in (16, 33, 50)]
        rows += [(2 * k, " ".join([*words(r, 70), *p, *words(r, 70)])), (2 * k + 1, " ".join([*words(r, 70), *q, *words(r, 70)]))]
        want[2 * k + 1] = (70, len(q))
    assert {x.row: (x.start, x.n_words) for x in found(spark, rows)} == want


def exact_words(rows, n=51):
    """For each document the words in runs of ``n`` that an earlier one has."""
    seen, out = set(), {}
    for k, text in rows:
        w = text.split()
        runs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        out[k] = {j for i, x in enumerate(runs) if x in seen for j in range(i, i + n)}
        seen |= set(runs)
    return out


def test_passages_of_lines_that_occur_before_in_short_places(spark):
    r = random.Random(25)
    line, l1, l2, l3 = words(r, 12), *(words(r, 20) for _ in range(3))
    lone = lambda: words(r, r.randrange(5, 40))
    rows = [lone() + line * 2 + lone(), lone() + line * 10 + lone(), lone() + line * 10 + lone(), lone() + l1 + l2 + lone(), lone() + l2 + l3 + lone()]
    rows += [lone() + l1 + l2 + l3 + lone(), lone() + l1 + l2 + l3 + lone()]
    rows = [(k, " ".join(x)) for k, x in enumerate(rows)]
    want = exact_words(rows)
    assert len(want[2]) >= 120 and len(want[6]) >= 60
    got = covered(found(spark, rows))
    assert all(want[k] <= got.get(k, set()) for k in want) and not set(got) - {2, 6}


def test_recombined_lines_against_all_exact_repeats(spark):
    r = random.Random(26)
    lines = [words(r, r.randrange(3, 45)) for _ in range(40)] + [["to"], ["ha", "ho"]]
    rows = [(k, " ".join(w for _ in range(r.randrange(1, 14)) for w in (words(r, 9) if r.random() < 0.3 else r.choice(lines) * r.choice((1, 1, 1, 2, 9))))) for k in range(250)]
    want = exact_words(rows)
    got = covered(found(spark, rows))
    assert sum(map(len, want.values())) > 5000
    assert {k: len(v - got.get(k, set())) for k, v in want.items() if v - got.get(k, set())} == {}


@pytest.mark.parametrize("every", [None, 30])
def test_passages_whose_pieces_are_elsewhere(spark, every):
    """Passages of 100 words, exact or edited, all pieces of which (40 words each) occur in earlier documents."""
    r = random.Random(41)
    short, pairs = [], []
    for _ in range(30):
        p, off = words(r, 100), r.randrange(1, 40)
        cuts = [0, *range(off, 100, 40), 100]
        short += [" ".join([*words(r, 20), *p[a:b], *words(r, 20)]) for a, b in zip(cuts, cuts[1:])]
        pairs.append((p, edited(r, p, every) if every else p))
    r.shuffle(short)
    docs = [*short, *(" ".join([*words(r, 30), *p, *words(r, 30)]) for p, _ in pairs), *(" ".join([*words(r, 25), *q, *words(r, 25)]) for _, q in pairs)]
    got = {(x.row, x.src): x.n_words for x in found(spark, list(enumerate(docs)))}
    first = len(short)
    want = {(first + 30 + k, first + k) for k in range(30)}
    # with edits, a passage is missed if none of its seeds or pairs of seeds goes over the end of a piece
    assert len(want - set(got)) <= (1 if every else 0)
    assert sum(got.get(w, 0) for w in want) >= (2800 if every else 3000)


@pytest.mark.parametrize(("every", "piece", "step"), [(30, 40, 20), (40, 48, 16), (30, 40, 40)])
def test_edited_passages_whose_overlapping_pieces_are_earlier(spark, every, piece, step):
    """60 passages of 120 words, one word in ``every`` replaced; their pieces, ``step`` apart, occur in earlier documents."""
    r = random.Random(42)
    short, pairs = [], []
    for _ in range(60):
        p = words(r, 120)
        short += [" ".join([*words(r, 20), *p[a : a + piece], *words(r, 20)]) for a in range(0, 120 - piece + step, step)]
        q = list(p)
        for at in range(r.randrange(5, every), 120, every):
            q[at] = words(r, 1)[0]
        pairs.append((p, q))
    r.shuffle(short)
    docs = [*short, *(" ".join([*words(r, 30), *p, *words(r, 30)]) for p, _ in pairs), *(" ".join([*words(r, 25), *q, *words(r, 25)]) for _, q in pairs)]
    got = covered(found(spark, list(enumerate(docs))))
    first = len(short) + 60
    share = [len(got.get(first + k, set()) & set(range(25, 145))) / 120 for k in range(60)]
    print(sum(s > 0.8 for s in share), sum(share) / 60)
    assert sum(s > 0.8 for s in share) >= 57 and sum(share) >= 57


def test_previous_occurrences_against_a_plain_reading(spark):
    r = random.Random(43)
    rows = sorted({(r.choice([1, 1, 1, 2, -5]) if i % 3 else i, r.randrange(40), r.randrange(9)) for i in range(600)})
    want = {}
    for h, doc, pos in rows:
        before = [(d, p) for g, d, p in rows if g == h and d < doc]
        if before:
            want[h, doc, pos] = max(before)
    for parts in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            out = s._to_previous(spark.createDataFrame(rows, "h bigint, doc bigint, pos int")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(out) == len(want) and {(x.h, x.doc, x.pos): (x.src, x.spos) for x in out} == want


def test_many_chains_align_as_each_does_alone():
    """Shingles and what is shared are made once for all chains; the passages are those of every chain by itself."""
    r, lefts, rights, turns = random.Random(5), [], [], []
    for _ in range(60):
        right = np.array([r.randrange(1 << 30) for _ in range(r.randrange(80, 200))], np.uint32)
        left = right.tolist()
        for _ in range(r.randrange(5)):
            at = r.randrange(10, len(left))
            left[at : at + r.randrange(3)] = [r.randrange(1 << 30) for _ in range(r.randrange(3))]
        lefts.append(np.array(left, np.uint32))
        rights.append(right)
        turns.append(np.array([[0, 0, 8]]))
    alone = [s.align(a, b, [tuple(t) for t in x.tolist()], 51, 0.8) for a, b, x in zip(lefts, rights, turns)]
    assert s.align_all(lefts, rights, turns, 51, 0.8) == alone
    own, other = s._shingles(lefts[0], 5), s._shingles(rights[0], 5)
    known = own, other, s._shared(own, other)
    assert s.align(lefts[0], rights[0], [(0, 0, 8)], 51, 0.8, known=known) == alone[0]
    assert any(alone)
