"""Measures of one's own over shared and unshared contexts, in one join."""

import random

import pytest
from pyspark.sql import functions as F

from suffixloom.config import Build
from suffixloom.operators.metrics import angle_measure, compare, distance, penalized_measure
from suffixloom.plans.build import tree_from_sequences
from suffixloom.plans.queries import overlap


def test_measures_against_plain_ones(spark):
    rng = random.Random(7)
    motif = "".join(rng.choice("ACGT") for _ in range(50))
    trees = [tree_from_sequences(spark.createDataFrame([(s,)], "seq string"), Build(4, 2, 1.0)).cache() for s in (motif * 20, motif[:30] * 30 + "".join(rng.choice("ACGT") for _ in range(300)))]
    a, b = ({r.context: r for r in t.collect()} for t in trees)
    shared = lambda both, left, right: {"both": F.count_if(both), "left": F.count_if(left), "right": F.count_if(right), "longest": F.max(F.when(left, F.col("depth"))), "t": F.sum(F.when(both, F.col("l_n_t") * F.col("r_n_t")))}
    for order in (0, 1):
        got = compare(*trees, [angle_measure(order), penalized_measure(order), overlap, shared], background_order=order).collect()
        want = distance(*trees, background_order=order).first()
        assert len(got) == 1 and got[0].n_shared == want.n_shared and got[0].n_missing == want.n_missing
        assert got[0].distance == pytest.approx(want.distance) and got[0].penalized == pytest.approx(want.penalized)
        r = got[0]
        assert (r.both, r.left, r.right) == (len(a.keys() & b.keys()), len(a.keys() - b.keys()), len(b.keys() - a.keys()))
        assert r.jaccard == pytest.approx(r.both / len(a.keys() | b.keys())) and r.longest == max(len(c) for c in a.keys() - b.keys())
        assert r.t == sum(a[c].n_t * b[c].n_t for c in a.keys() & b.keys())
        total = sum(max(x[c]["count"] if c in x else 0 for x in (a, b)) for c in a.keys() | b.keys())
        assert r.weighted_jaccard == pytest.approx(sum(min(a[c]["count"], b[c]["count"]) for c in a.keys() & b.keys()) / total)
    empty = compare(trees[0], trees[1].limit(0), [angle_measure(), penalized_measure(), overlap]).collect()
    assert len(empty) == 1 and (empty[0].n_shared, empty[0].n_missing, empty[0].distance, empty[0].penalized, empty[0].jaccard) == (0, len(a), 1.0, 1.0, 0.0)
