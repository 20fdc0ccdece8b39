"""Context trees against naive counting, hand-made goldens, laws, and fixed distances of three genomes."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from suffixloom.config import PERES_SHIELDS, Build, Sequencing
from suffixloom.functions import estimators, symbols
from suffixloom.functions.estimators import by_kullback_leibler
from suffixloom.operators import contexts as C
from suffixloom.operators import kmers as K
from suffixloom.operators import metrics as M
from suffixloom.operators import prune as P
from suffixloom.plans.build import bic_sequences, contexts_from_kmers, score_sequences, tree_from_kmers, tree_from_sequences
from suffixloom.sources.sequences import read_fasta

#: A folder of FASTA files of public genomes, found by their accession numbers.
GENOMES = os.environ.get("GENOME_DIR", "")
NODE = "context string, depth int, n_a bigint, n_c bigint, n_g bigint, n_t bigint, count bigint"


def dna(seed, n, alphabet="ACGT"):
    r = random.Random(seed)
    out = ""
    while len(out) < n:  # some structure, so that contexts matter
        out += r.choice(["ACG", "TTTA", "GCGC", "".join(r.choice(alphabet) for _ in range(5))])
    return out[:n]


@pytest.fixture(scope="module")
def sequences(spark):
    rows = [("x", dna(1, 900)), ("x", dna(2, 300).lower()), ("y", dna(3, 700, "ACGTN")), ("y", None), ("y", ""), ("x", "ACG")]
    return spark.createDataFrame(rows, "model string, seq string")


def naive_counts(rows, k):
    out = {}
    for model, s in rows:
        s = (s or "").upper()
        for i in range(len(s) - k + 1):
            if set(s[i : i + k]) <= set("ACGT"):
                out[model, s[i : i + k]] = out.get((model, s[i : i + k]), 0) + 1
    return out


def test_kmer_counts(spark, sequences):
    rows = [tuple(r) for r in sequences.collect()]
    for k in (1, 4, 7):
        got = {(r.model, r.kmer): r["count"] for r in K.count_kmers(sequences, k, ["model"], spread=3).collect()}
        assert got == naive_counts(rows, k)
    for many in (K.count_all(sequences, [2, 5, 9], ["model"]), K.count_windows(sequences, [2, 5, 9], ["model"], size=13)):
        many = many.collect()
        for k in (2, 5, 9):
            assert {(r.model, r.kmer): r["count"] for r in many if r.k == k} == naive_counts(rows, k)
    assert K.count_kmers(sequences.limit(0), 4, ["model"]).count() == 0


def test_kmer_counts_in_slices(spark, sequences, monkeypatch):
    """Slices, dense and sparse counters, many models and long k-mers give the same counts."""
    import pyarrow as pa

    r = random.Random(4)
    rows = [(f"m{k % 7}" if k % 7 else None, "".join(r.choice("ACGTacgtN-") for _ in range(r.randrange(60)))) for k in range(50)] + [("m1", None)]
    want = {k: naive_counts(rows, k) for k in (1, 3, 12)}
    batch = pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows]), pa.array([s for _, s in rows])], names=["b0", "seq"])
    for size, dense, most in ((1 << 20, 1 << 20, 1 << 22), (11, 1 << 20, 1 << 22), (7, 0, 0), (50, 64, 150)):
        monkeypatch.setattr(K, "SLICE", size)
        monkeypatch.setattr(K, "DENSE", dense)
        monkeypatch.setattr(K, "MOST_DENSE", most)
        tally, got = K._Tally(1, [1, 3, 12], K.ROW), {1: {}, 3: {}, 12: {}}
        for out in [*tally.add(batch), *tally.add(batch.slice(3, 40)), *tally.flush()]:
            for m, k, code, n in zip(*(c.to_pylist() for c in out.columns)):
                key = (m, "".join("ACGT"[code >> 2 * i & 3] for i in range(k))[::-1])
                got[k][key] = got[k].get(key, 0) + n
        for k in want:
            part = naive_counts(rows[3:43], k)
            assert got[k] == {x: want[k].get(x, 0) + part.get(x, 0) for x in {*want[k], *part}}
    long = {(r.model, r.kmer): r["count"] for r in K.count_kmers(sequences, 40, ["model"]).collect()}
    assert long == naive_counts([tuple(r) for r in sequences.collect()], 40)


def test_union_adds_up(spark, sequences):
    counts = K.count_kmers(sequences, 4)
    both = {r.kmer: r["count"] for r in K.union_counts(counts, counts.limit(0), counts).collect()}
    assert both == {r.kmer: 2 * r["count"] for r in counts.collect()}


def test_roll_up_counts_windows_that_start_with_a_context(spark, sequences):
    rows = [tuple(r) for r in sequences.collect()]
    depth = 5
    windows = naive_counts(rows, depth + 1)
    got = {(r.model, r.context): r for r in C.roll_up(K.count_kmers(sequences, depth + 1, ["model"]), depth, ["model"]).collect()}
    want = {}
    for (model, w), n in windows.items():
        for d in range(depth + 1):
            node = want.setdefault((model, w[:d]), dict.fromkeys("ACGT", 0))
            node[w[d]] += n
    assert set(got) == set(want)
    for key, node in want.items():
        r = got[key]
        assert [r.n_a, r.n_c, r.n_g, r.n_t, r["count"], r.depth] == [*node.values(), sum(node.values()), len(key[1])]


def naive_tree(nodes, build, root):
    """Bottom-up pruning as a recursion over children; nodes: context -> [a, c, g, t]."""
    a = build.pseudo_count
    adjust = lambda d: build.sequencing.depth * (1 - build.sequencing.error_rate) ** d if build.sequencing.adjust else 1
    some = {w for w, c in nodes.items() if not w or sum(c) >= build.min_count * adjust(len(w))}
    some = {w for w in some if all(w[i:] in some for i in range(1, len(w)))}
    p = lambda c: [(x + a) / (sum(c) + 4 * a) for x in c]
    out = {}

    def visit(w):
        kids = [s + w for s in "ACGT" if s + w in some]
        n = sum([visit(k) for k in kids])
        if w:
            pc, pp, count = p(nodes[w]), p(nodes[w[1:]]), sum(nodes[w])
            if build.estimator == PERES_SHIELDS:
                div, least = max(0, max((x - y) * count for x, y in zip(pc, pp))), root**0.75 * adjust(len(w))
            else:
                div, least = count * sum(x * math.log(x / y) for x, y in zip(pc, pp)), build.threshold * adjust(len(w))
            if not n and div < least:
                return 0
        out[w] = (sum(nodes[w]), -1 if n or not w else div, bool(w) and n < 4)
        return 1

    visit("")
    return out


@pytest.mark.parametrize("build", [
    Build(4, 2, 3.9075), Build(5, 1, 0.5), Build(3, 3, 1e9), Build(4, 2, estimator=PERES_SHIELDS), Build(5, 6, 1.2, sequencing=Sequencing(True, 2.0, 0.3)), Build(4, 2, 2.0, 0.1),
])
def test_trees_against_bottom_up_pruning(spark, sequences, build):
    tree = tree_from_sequences(sequences, build, ["model"]).collect()
    raw = C.roll_up(K.count_kmers(sequences, build.k, ["model"]), build.max_depth, ["model"]).collect()
    for model in "xy":
        nodes = {r.context: [r.n_a, r.n_c, r.n_g, r.n_t] for r in raw if r.model == model}
        want = naive_tree(nodes, build, sum(nodes[""]))
        got = {r.context: (r["count"], r.divergence, r.is_terminal) for r in tree if r.model == model}
        assert set(got) == set(want)
        for w, (count, div, terminal) in want.items():
            assert got[w][0] == count and got[w][2] == terminal and got[w][1] == pytest.approx(div, abs=1e-9)


def test_estimator_goldens(spark):
    row = spark.createDataFrame([(3, 0, 1, 1, 1, 3, 1, 1, 1)], "count bigint, n_a bigint, n_c bigint, n_g bigint, n_t bigint, parent_n_a bigint, parent_n_c bigint, parent_n_g bigint, parent_n_t bigint")
    kl, ps = row.select(estimators.kullback_leibler(1.0), estimators.peres_shields(1.0)).first()
    p, q = [1 / 7, 2 / 7, 2 / 7, 2 / 7], [4 / 10, 2 / 10, 2 / 10, 2 / 10]
    assert kl == pytest.approx(3 * sum(x * math.log(x / y) for x, y in zip(p, q)))
    assert ps == pytest.approx((2 / 7 - 1 / 5) * 3)


def test_only_a_significant_extension_keeps_a_context(spark):
    rows = [("", 0, 40, 40, 40, 40, 160), ("T", 1, 10, 10, 10, 10, 40), ("TT", 2, 10, 10, 10, 10, 40), ("ATT", 3, 40, 0, 0, 0, 40), ("A", 1, 10, 10, 10, 10, 40), ("C", 1, 9, 10, 10, 11, 40)]
    tree = P.prune(spark.createDataFrame(rows, NODE), Build(3, 1, 3.9075))
    got = {r.context: (r.divergence < 0, r.is_terminal) for r in tree.collect()}
    assert got == {"": (True, False), "T": (True, True), "TT": (True, True), "ATT": (False, True)}


def test_closure_drops_orphans(spark):
    rows = [("", 0, 1, 1, 1, 1, 4), ("T", 1, 1, 1, 1, 1, 4), ("AC", 2, 1, 1, 1, 1, 4), ("TAC", 3, 1, 1, 1, 1, 4), ("AT", 2, 1, 1, 1, 1, 4)]
    nodes = spark.createDataFrame(rows, NODE)
    assert sorted(r.context for r in C.close(nodes).collect()) == ["", "AT", "T"]
    assert sorted(r.context for r in C.orphans(nodes).collect()) == ["AC", "TAC"]


def test_reprune_gives_the_harder_tree(spark, sequences):
    soft, hard = (tree_from_sequences(sequences, Build(4, 2, t), ["model"]) for t in (1.2, 8.0))
    again = P.reprune(soft, 8.0, by=["model"])
    key = lambda r: (r.model, r.context, r["count"], round(r.divergence, 9), r.is_terminal)
    assert sorted(map(key, again.collect())) == sorted(map(key, hard.collect()))


def naive_nll(windows, tree):
    total = n = 0
    for w, count in windows.items():
        c = next(tree[w[i:-1]] for i in range(len(w)) if w[i:-1] in tree)
        total -= count * math.log((c["ACGT".index(w[-1])] + 1) / (sum(c) + 4))
        n += count
    return total / n, n


def test_score_uses_the_longest_context(spark, sequences):
    x = sequences.filter("model = 'x'")
    tree = tree_from_sequences(x, Build(4, 2, 1.2))
    nodes = {r.context: [r.n_a, r.n_c, r.n_g, r.n_t] for r in tree.collect()}
    windows = {k: v for (_, k), v in naive_counts([("", r.seq) for r in sequences.collect()], 5).items()}
    row = score_sequences(sequences, tree, 4).first()
    nll, n = naive_nll(windows, nodes)
    assert row.nll == pytest.approx(nll) and row.n_windows == n


def test_score_of_a_tree_with_gaps(spark, sequences):
    """The longest context counts also where shorter ones are not in the tree, and windows without any are left out."""
    x = sequences.filter("model = 'x'")
    tree = tree_from_sequences(x, Build(4, 2, 1.2))
    counts = naive_counts([("", r.seq) for r in sequences.collect()], 5)
    for some in (tree.filter("depth <> 1"), tree.filter("depth > 1 or context = 'A'"), tree.filter("context in ('', 'CA')"), tree.limit(0)):
        nodes = {r.context: [r.n_a, r.n_c, r.n_g, r.n_t] for r in some.collect()}
        windows = {k: v for (_, k), v in counts.items() if any(k[i:-1] in nodes for i in range(5))}
        row = score_sequences(sequences, some, 4).first()
        if not windows:
            assert row.n_windows is None and row.nll is None
            continue
        nll, n = naive_nll(windows, nodes)
        assert row.nll == pytest.approx(nll) and row.n_windows == n


def test_distance_laws(spark, sequences):
    tree = tree_from_sequences(sequences, Build(4, 2, 1.2), ["model"])
    x, y = (tree.filter(F.col("model") == m).drop("model") for m in "xy")
    a, b, same, none, nothing = (M.distance(*p).first() for p in ((x, y), (y, x), (x, x), (x, y.limit(0)), (x.limit(0), x.limit(0))))
    assert a.distance == pytest.approx(b.distance) and 0 < a.distance < 1 and a.n_missing == b.n_missing > 0
    assert same.distance == pytest.approx(0, abs=1e-7) and same.n_missing == 0
    assert (none.distance, none.penalized, none.n_shared, none.n_missing) == (1.0, 1.0, 0, x.count())
    assert (nothing.distance, nothing.penalized) == (1.0, 0.75)
    assert a.penalized == pytest.approx(0.75 * a.distance + 0.25 * a.n_missing / (a.n_missing + a.n_shared))
    pairs = M.distances(tree, "model").collect()
    assert [(r.left_id, r.right_id) for r in pairs] == [("x", "y")] and pairs[0].distance == pytest.approx(a.distance)
    wanted = spark.createDataFrame([("y", "x"), ("x", "x"), ("x", "nobody"), ("y", "x")], "left_id string, right_id string")
    some = {(r.left_id, r.right_id): r.distance for r in M.distances(tree, "model", wanted).collect()}
    assert set(some) == {("y", "x"), ("x", "x")} and some["y", "x"] == pytest.approx(a.distance) and some["x", "x"] == pytest.approx(0, abs=1e-7)
    deeper = M.distance(x, y, background_order=1).first()
    assert 0 < deeper.distance < 1 and deeper.n_shared < a.n_shared


@pytest.mark.skipif(not os.path.isdir(GENOMES), reason="GENOME_DIR names no folder of genomes")
@pytest.mark.parametrize("other,threshold,want", [("NC_045512.2", 3.9075, 0.15452552), ("NC_001497.2", 1.2, 0.27162704)])
def test_distances_of_genomes(spark, other, threshold, want):
    genomes = read_fasta(spark, f"{GENOMES}/*.fa")
    trees = [tree_from_sequences(genomes.filter(F.col("seq_id") == s), Build(6, 2, threshold)) for s in ("NC_028367.1", other)]
    assert M.distance(*trees).first().distance == pytest.approx(want, abs=3e-8)


def test_sizes_and_remainder(spark):
    rows = [("", 0, 1, 1, 1, 7, 10, -1.0, False), ("T", 1, 1, 1, 1, 4, 7, -1.0, True), ("AT", 2, 1, 1, 1, 0, 3, 5.0, True), ("C", 1, 1, 1, 1, 0, 2, 5.0, True)]
    tree = spark.createDataFrame(rows, f"{NODE}, divergence double, is_terminal boolean")
    assert tuple(M.size(tree).first()) == (4, 9) and tuple(M.terminals(tree).first()) == (3, 10)
    assert {r.context: r.remainder for r in M.remainder(tree).collect()} == {"": 1, "T": 4, "AT": 3, "C": 2}


def test_grid_is_what_single_builds_give(spark, sequences):
    x = sequences.filter("model = 'x'")
    grid = bic_sequences(x, 5, (2, 9), (1.2, 10.0)).collect()
    assert len(grid) == 8
    for r in grid:
        build = Build(r.max_depth, r.min_count, r.threshold)
        kmers = K.count_kmers(x, build.k)
        tree = tree_from_kmers(kmers, build)
        t, s = M.terminals(tree).first(), M.score(kmers, tree, build.max_depth).first()
        assert r.n_params == 3 * t.n_terminal and r.log_likelihood == pytest.approx(s.log_likelihood)
        assert r.bic_score == pytest.approx(r.n_params * math.log(t.sequence_size) - 2 * s.log_likelihood)
    best = M.bic_best(spark.createDataFrame(grid)).first()
    assert best.bic_score == min(r.bic_score for r in grid)


def test_symbol_functions(spark):
    f = lambda *c: tuple(spark.range(1).select(*c).first())
    lit = F.lit
    assert f(symbols.suffix(lit("TAGCT")), symbols.suffix(lit("")), symbols.last(lit("ACGT"), 2), symbols.last(lit("A"), 0)) == ("AGCT", "", "GT", "")
    assert f(*[symbols.prefix_index(lit(x), n) for x, n in (("AAA", 2), ("CAA", 2), ("CA", 2), ("GCCC", 2), ("GCAC", 3))]) == (0, 4, 4, 9, 36)
    assert f(symbols.first_difference(lit("AAAAAAATCATCAGT"), lit("AAAAAAAGTCGTCAG")), symbols.first_difference(lit("AC"), lit("AAC")), symbols.first_difference(lit("AC"), lit("AAC"), 0, 1)) == (7, 1, -1)
    assert f(symbols.replace_first(lit("ACG"), "T"), symbols.symbol_code(lit("ACGT"), 3), symbols.symbol_code(lit("A"), 1)) == ("TCG", 3, -1)
    assert symbols.contexts_up_to(2) == 21
    rows = spark.createDataFrame([(w,) for w in ("TTTTT", "", "GTTTTT", "T", "CTTTTT")], "w string").orderBy(symbols.post_order(F.col("w"))).collect()
    assert [r.w for r in rows] == ["GTTTTT", "CTTTTT", "TTTTT", "T", ""]


def test_bad_parameters_are_refused():
    for bad in ({"max_depth": 0}, {"min_count": 0}, {"pseudo_count": 0}, {"estimator": "other"}):
        with pytest.raises(ValueError):
            Build(**bad)
    with pytest.raises(ValueError):
        Sequencing(error_rate=1.0)


def test_long_sequences_are_cut(spark, monkeypatch):
    """Rows of a few symbols give the counts of the whole, for several lengths at once."""
    r = random.Random(14)
    rows = [(f"m{k % 3}", "".join(r.choice("ACGTacgtN") for _ in range(r.choice([0, 5, 39, 40, 41, 400])))) for k in range(40)] + [("m1", None)]
    df = spark.createDataFrame(rows, "model string, seq string")
    for size in (8, 40, 1 << 24):
        monkeypatch.setattr(K, "ROW", size)
        got = {}
        for x in K.count_all(df, [1, 4, 9], ["model"]).collect():
            got.setdefault(x.k, {})[x.model, x.kmer] = x["count"]
        assert got == {k: naive_counts(rows, k) for k in (1, 4, 9)}


def test_few_files_are_dealt_evenly(spark, tmp_path):
    df = spark.createDataFrame([("ACGT",)] * 50, "seq string")
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert "RoundRobin" in K.even(one)._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10b")
    try:
        assert K.even(one) is one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert K.even(df) is df
    df.repartition(8).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert K.even(many) is many


def test_places_against_sorting(spark):
    r = random.Random(15)
    rows = [(m, c) for m in ("a", "b", None) for c in {"".join(r.choice("ACGT") for _ in range(r.randrange(6))) for _ in range(300)}]
    got = {(x.model, x.context): x.place for x in C.places(spark.createDataFrame(rows, "model string, context string"), ["model"]).collect()}
    for m in ("a", "b"):
        ordered = sorted((c for n, c in rows if n == m), key=lambda c: c[::-1], reverse=True)
        assert [got[m, c] for c in ordered] == list(range(1, len(ordered) + 1))


def test_no_cartesian_product_and_no_shuffle_by_model(spark, sequences):
    """Roots and backgrounds are broadcast, by model or not, also where the optimizer would not do so by itself."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for by in ([], ["model"]):
            contexts = contexts_from_kmers(K.count_kmers(sequences, 4, by), Build(3, 1), by)
            for text in (plan(P.edges(contexts, Build(3, 1, estimator=PERES_SHIELDS), by)), plan(M.components(contexts, 0, 1.0, by))):
                assert "CartesianProduct" not in text and not re.search(r"hashpartitioning\(model#\d+, \d+\)", text)
                assert "Broadcast" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_own_estimator_and_support(spark, sequences):
    """Rules of one's own that say what the built-in ones say build the same trees; others build others."""
    base = Build(4, 3, 2.5)
    same = Build(4, 3, 2.5, estimator=lambda build, threshold=None: by_kullback_leibler(build, threshold), support=lambda count, depth, least: count >= least)
    key = lambda r: (r.model, r.context, r["count"], r.divergence, r.is_terminal)
    trees = [sorted(map(key, tree_from_sequences(sequences, b, ["model"]).collect()), key=str) for b in (base, same)]
    assert trees[0] == trees[1]
    short = tree_from_sequences(sequences, Build(4, 3, 2.5, support=lambda count, depth, least: (count >= least) & (depth <= 2)), ["model"])
    assert short.agg(F.max("depth")).first()[0] <= 2
    with pytest.raises(ValueError):
        Build(estimator="no such")


def test_distances_of_trees_without_shared_contexts(spark):
    rows = [(m, c, len(c), 4, 1, 2, 3, 10) for m, cs in (("a", ["", "A"]), ("b", ["", "C"]), ("c", ["", "A", "C"])) for c in cs]
    trees = spark.createDataFrame(rows, "model string, context string, depth int, n_a bigint, n_c bigint, n_g bigint, n_t bigint, count bigint")
    got = {(x.left_id, x.right_id): (x.n_shared, x.n_missing, x.distance) for x in M.distances(trees, "model").collect()}
    assert got[("a", "b")] == (0, 2, 1.0) and got[("a", "c")][:2] == (1, 1) and got[("b", "c")][:2] == (1, 1)
    some = spark.createDataFrame([("c", "a")], "left_id string, right_id string")
    assert [(x.left_id, x.right_id, x.n_shared) for x in M.distances(trees, "model", some).collect()] == [("c", "a", 1)]


def naive_distance(left, right, nodes, order):
    """The angle of two trees' background-adjusted probabilities over the contexts of both."""
    def vectors(tree, counts):
        p = lambda c: [(x + 1) / (sum(c) + 4) for x in c]
        back = lambda w: next(w[len(w) - n :] for n in range(min(order, len(w)), -1, -1) if w[len(w) - n :] in tree)
        return {w: [a / math.sqrt(b) for a, b in zip(p(counts[w]), p(counts[back(w)]))] for w in tree if len(w) > order}
    a, b = vectors(left, nodes[0]), vectors(right, nodes[1])
    both = sorted(set(a) & set(b))
    dot, aa, bb = (sum(x * y for w in both for x, y in zip(u[w], v[w])) for u, v in ((a, b), (a, a), (b, b)))
    return 2 / math.pi * math.acos(min(1.0, dot / math.sqrt(aa * bb)))


def test_generated_genomes(spark, tmp_path):
    """FASTA files of two made-up genomes, at the default depth and least count, against naive trees and distances."""
    build, nodes, trees, files = Build(9, 2, 3.9075), [], [], []
    for k in (0, 1):
        seq = dna(40 + k, 6000) + "NNRY" + dna(50 + k, 2000).lower() + "K" + dna(50, 1500)
        (tmp_path / f"{k}.fa").write_text(f">g{k} made up\n" + "\n".join(seq[i : i + 70] for i in range(0, len(seq), 70)) + "\n")
        raw = {}
        for (_, w), n in naive_counts([("", seq)], 10).items():
            for d in range(10):
                raw.setdefault(w[:d], [0] * 4)["ACGT".index(w[d])] += n
        nodes.append(raw)
        trees.append(naive_tree(raw, build, sum(raw[""])))
        files.append(tree_from_sequences(read_fasta(spark, f"{tmp_path}/{k}.fa"), build))
        got = {r.context: (r["count"], r.is_terminal) for r in files[k].collect()}
        assert got == {w: (x[0], x[2]) for w, x in trees[k].items()} and max(map(len, got)) >= 4
    for order in (0, 1):
        assert M.distance(*files, order).first().distance == pytest.approx(naive_distance(*trees, nodes, order), abs=1e-9)
