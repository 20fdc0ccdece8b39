"""Scores of single sequences against a plain walk, by either plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from suffixloom.config import Build
from suffixloom.operators import walks
from suffixloom.operators.kmers import count_kmers
from suffixloom.operators.metrics import score
from suffixloom.operators.walks import score_each
from suffixloom.plans.build import tree_from_sequences


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def plain(rows, trees, depth):
    """Sums over all windows, the longest context looked for one symbol at a time."""
    out = {}
    for key, seq in rows:
        s = (seq or "").upper()
        for i in range(depth, len(s)):
            window = s[i - depth : i + 1]
            if set(window) <= set("ACGT"):
                for model, tree in trees.items():
                    context = next(window[j:-1] for j in range(depth + 1) if window[j:-1] in tree)
                    n, ll = out.get((key, model), (0, 0.0))
                    out[key, model] = (n + 1, ll + math.log(tree[context]["ACGT".index(window[-1])]))
    return {k: (n, round(ll, 6), round(-ll / n, 6)) for k, (n, ll) in out.items()}


@pytest.mark.parametrize("depth", [3, 11])
def test_against_a_plain_walk(spark, monkeypatch, depth):
    monkeypatch.setattr(walks, "ROW", 50)  # long sequences are cut, short ones are walked together
    monkeypatch.setattr(walks, "BATCH", 120)
    monkeypatch.setattr(walks, "DIRECT", 2 if depth > 9 else 9)
    rng = random.Random(depth)
    motif = dna(rng, 40)
    made = [("x", motif * 30), ("y", dna(rng, 3000)), ("y", dna(rng, 500, "AC"))]
    tree = tree_from_sequences(spark.createDataFrame(made, "m string, seq string"), Build(depth, 2, 1.0), ["m"]).cache()
    nodes = tree.collect()
    assert depth < walks.DIRECT or max(r.depth for r in nodes) > walks.DIRECT
    trees = {m: {r.context: [(c + 1) / (r.n_a + r.n_c + r.n_g + r.n_t + 4) for c in (r.n_a, r.n_c, r.n_g, r.n_t)] for r in nodes if r.m == m} for m in "xy"}
    rows = [(i, dna(rng, rng.randint(0, 80))) for i in range(30)] + [(40, motif * 5), (41, None), (42, ""), (43, "acgtn" * 30), (44, dna(rng, 300)), (44, dna(rng, 20)), (None, motif)]
    df = spark.createDataFrame(rows, "id int, seq string").select("*", F.lit("clash").alias("n"))
    for most in (walks.MOST_CONTEXTS, 3):
        got = score_each(df, tree, depth, 1.0, ["m"], ["id"], most=most)
        assert got.columns == ["id", "m", "n_windows", "log_likelihood", "nll"]
        assert {(r.id, r.m): (r.n_windows, round(r.log_likelihood, 6), round(r.nll, 6)) for r in got.collect()} == plain(rows, trees, depth)
    tree.unpersist()


def test_one_tree_and_its_sum(spark):
    rng = random.Random(1)
    rows = [(str(i), dna(rng, 200)) for i in range(5)]
    df = spark.createDataFrame(rows, "seq_id string, seq string")
    tree = tree_from_sequences(df, Build(4, 2, 1.0))
    got = score_each(df, tree, 4).collect()
    whole = score(count_kmers(df, 5), tree, 4).first()
    assert len(got) == 5 and sum(r.n_windows for r in got) == whole.n_windows
    assert sum(r.log_likelihood for r in got) == pytest.approx(whole.log_likelihood)
    assert score_each(df.limit(0), tree, 4).count() == 0 and score_each(df, tree.limit(0), 4).count() == 0
