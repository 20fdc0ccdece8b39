"""Packed contexts against strings, and the sorted roll-up against the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from suffixloom.config import PERES_SHIELDS, Build
from suffixloom.functions import forms, symbols
from suffixloom.functions.forms import Packed
from suffixloom.operators import rollup
from suffixloom.operators.contexts import close, enough, places, roll_up, support
from suffixloom.operators.kmers import count_kmers, count_packed
from suffixloom.operators.metrics import distances, remainder, score
from suffixloom.operators.prune import edges, prune
from suffixloom.operators.rollup import roll_up_sorted
from suffixloom.plans.build import tree_from_kmers, tree_from_sequences
from suffixloom.tables import written


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def seqs(spark):
    rng = random.Random(12)
    motif = dna(rng, 90)
    rows = [("x", motif * 30), ("x", "A" * 200), ("y", dna(rng, 4000)), ("y", "NNACGTNAC"), (None, dna(rng, 500, "AC")), ("z", motif[:40])]
    return spark.createDataFrame(rows, "m string, seq string")


def got(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_functions_of_packed_contexts(spark):
    rng = random.Random(3)
    texts = ["", "A", "T", "AA", "ACGT" * 7 + "ACG", "T" * 31, *(dna(rng, rng.randint(0, 31)) for _ in range(300))]
    c, d, p = F.col("c"), F.length("c"), F.col("p")
    rows = spark.createDataFrame([(t,) for t in texts], "c string").withColumn("p", Packed.pack(c))
    same = lambda packed_, text: Packed.text(packed_) == text
    n = F.least(d, F.lit(3))
    checks = [
        Packed.text(p) == c, Packed.depth(p) == d, same(Packed.parent(p, d), symbols.suffix(c)), same(Packed.last(p, d, n), symbols.last(c, n)), same(Packed.prefix(p, d, 4), symbols.prefix(c, 4)),
        same(Packed.sibling(p, d, 3), symbols.replace_first(c, "T")), Packed.code(p, d, 2) == symbols.symbol_code(c, 2), Packed.index(p, d, 5) == symbols.prefix_index(c, 5),
        F.transform(Packed.suffixes(p, d, 1), lambda x: Packed.text(x)) == symbols.all_suffixes(c, 1), (d == 0) | (F.element_at(F.array(*map(F.lit, "ACGT")), Packed.final(p).cast("int") + 1) == F.right(c, F.lit(1))),
    ]
    assert rows.select(*[F.min(x.cast("int")).alias(f"c{i}") for i, x in enumerate(checks)]).first().asDict() == {f"c{i}": 1 for i in range(len(checks))}
    assert [r.c for r in rows.orderBy(*Packed.order(p, d)).collect()] == sorted(texts, key=lambda t: t[::-1], reverse=True)
    assert got(forms.unpacked(forms.packed(rows.select("c"), "c"), "c")) == got(rows.select("c"))
    with pytest.raises(Exception, match="at most 31"):
        forms.packed(spark.createDataFrame([("A" * 32,)], "c string"), "c").collect()


@pytest.mark.parametrize("depth", [4, 24])
def test_sorted_roll_up_is_the_roll_up(spark, seqs, monkeypatch, depth):
    kmers, by = written(count_kmers(seqs, depth + 1, ["m"]), "kmers"), ["m"]
    want = got(roll_up(kmers, depth, by))
    codes = forms.packed(kmers, "kmer")
    monkeypatch.setattr(rollup, "STRETCH", 7 if depth < 9 else 100)
    assert got(forms.unpacked(roll_up_sorted(codes, depth, by, as_packed=True))) == want
    assert got(count_packed(seqs, depth + 1, by)) == got(codes)
    if depth < 9:
        some = roll_up_sorted(kmers, depth, by, enough(5))
        assert got(some) == got(support(roll_up(kmers, depth, by), 5))
        assert roll_up_sorted(kmers.limit(0), depth, by).count() == 0
    else:
        assert got(roll_up_sorted(kmers, depth, by)) == want


def test_sorted_roll_up_shuffles_each_kmer_once(spark, seqs):
    kmers = count_kmers(seqs, 25, ["m"])
    rows = roll_up_sorted(kmers, 24, ["m"])
    n, cut = kmers.count(), spark.read.parquet(rows.inputFiles()[0].rpartition("/")[0]).filter("cut").count()
    assert n + cut < 2 * n
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of what was cut; the k-mers were dealt before


@pytest.mark.parametrize("build", [Build(5, 3, 1.2), Build(4, 3, estimator=PERES_SHIELDS)])
def test_trees_of_either_form(spark, seqs, build):
    by, known = ["m"], seqs.filter("m is not null")
    kmers = written(count_kmers(known, build.k, by), "kmers")
    contexts = written(close(support(roll_up(kmers, build.max_depth, by), build.min_count), by), "contexts")
    tree = written(prune(contexts, build, by), "tree")
    assert got(tree_from_sequences(known, build, by)) == got(tree_from_kmers(kmers, build, by)) == got(tree)
    small = forms.packed(contexts)
    assert got(forms.unpacked(edges(small, build, by).drop("parent"))) == got(edges(contexts, build, by).drop("parent"))
    small_tree = written(prune(small, build, by), "tree")
    assert got(forms.unpacked(small_tree)) == got(tree)
    if build.estimator == PERES_SHIELDS:
        return
    for order in (0, 2):
        assert got(distances(small_tree, "m", background_order=order)) == got(distances(tree, "m", background_order=order))
    want = got(score(kmers, tree, build.max_depth, 1.0, by))
    for k, t in ((kmers, small_tree), (forms.packed(kmers, "kmer"), tree), (forms.packed(kmers, "kmer"), small_tree)):
        assert got(score(k, t, build.max_depth, 1.0, by)) == want
    assert got(forms.unpacked(remainder(small_tree, by))) == got(remainder(tree, by))
    assert got(forms.unpacked(places(small_tree, by))) == got(places(tree, by))
