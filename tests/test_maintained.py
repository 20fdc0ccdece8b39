"""Trees kept up to date by a stream: equal to a full build after each batch, and only what changed is made anew."""

import random

import pytest
from pyspark.sql import functions as F

from suffixloom.config import PERES_SHIELDS, Build
from suffixloom.operators.contexts import roll_up
from suffixloom.operators.kmers import count_kmers
from suffixloom.plans.build import tree_from_sequences
from suffixloom.streaming.maintained import MaintainedTree


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def rows(tree, by):
    return sorted((tuple(r[b] for b in by), r.context, r["count"], r.n_a, r.n_c, r.n_g, r.n_t, round(r.divergence, 9), r.is_terminal) for r in tree.collect())


def batches(seed):
    """Sequences of two models: repeats, short fragments that leave orphans, a batch that changes little, an empty one."""
    rng = random.Random(seed)
    motif = dna(rng, 60)
    first = [("x", motif * 20), ("y", dna(rng, 800)), ("x", dna(rng, 300, "AC"))]
    ends = [("x", dna(rng, 5)) for _ in range(60)] + [("y", "T" * 4), ("y", "GTTT")]
    return [first, ends, [("x", "ACGTA")], [], [("y", motif * 3), ("z", dna(rng, 200)), ("x", motif[:7] * 40)]]


@pytest.mark.parametrize("build", [Build(3, 2, 2.0), Build(3, 5, 1.2, estimator=PERES_SHIELDS)])
def test_equal_to_a_full_build_after_each_batch(spark, tmp_path, build):
    by, seen = ["m"], []
    tree = MaintainedTree(spark, str(tmp_path / "t"), build, by, whole_every=3)
    totals = None
    for number, batch in enumerate(batches(3) if build.estimator != PERES_SHIELDS else [b for b in batches(3) if len(b) > 1]):
        seen += batch
        whole = spark.createDataFrame(seen, "m string, seq string")
        after = {tuple(r)[:2]: r for r in roll_up(count_kmers(whole, build.k, by), build.max_depth, by).collect()}
        changed = [r for k, r in after.items() if totals is None or k not in totals or totals[k] != r]
        schema = "m string, context string, depth int, n_a bigint, n_c bigint, n_g bigint, n_t bigint, count bigint"
        for _ in range(2 if number == 1 else 1):  # a batch that is tried again
            tree.update(spark.createDataFrame(changed, schema), number)
        assert rows(tree.tree(), by) == rows(tree_from_sequences(whole, build, by), by)
        layer = tree.layers().filter((F.col("whole") == 0) & (F.col("batch") == number)).collect()
        made = {(r.m, r.context) for r in layer if r.recomputed}
        moved = {(r.m, r.context) for r in changed}
        assert all(k in moved or (k[0], k[1][1:]) in moved or after[k]["count"] >= build.min_count for k in made)
        waited = {k for k in made if k not in moved and (k[0], k[1][1:]) not in moved}
        assert all(any((k[0], k[1][i:]) in moved for i in range(1, len(k[1]))) for k in waited)  # orphans that found their last suffix
        if len(batch) == 1:  # five more symbols change few contexts
            assert 0 < len(made) < len(after) / 2 and {k for k, _ in made} == {"x"}
        if not batch:
            assert layer == []
        totals = after


def test_a_stream_and_its_restart(spark, tmp_path):
    build, rng = Build(3, 2, 2.0), random.Random(5)
    tree = MaintainedTree(spark, str(tmp_path / "t"), build)
    seen = []
    for round_ in range(2):
        for i in range(2):
            batch = [(dna(rng, 400),), (dna(rng, 30) * 5,)]
            seen += batch
            spark.createDataFrame(batch, "seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = tree.start(stream, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None
        assert rows(tree.tree(), []) == rows(tree_from_sequences(spark.createDataFrame(seen, "seq string"), build), [])
    assert {r.batch for r in tree.layers().select("batch").distinct().collect()} == {0, 1, 2, 3}


def test_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="one of the estimators"):
        MaintainedTree(spark, str(tmp_path), Build(estimator=lambda build, threshold=None: (F.lit(1.0), F.lit(0.0))))
    with pytest.raises(ValueError, match="whole_every"):
        MaintainedTree(spark, str(tmp_path), Build(), whole_every=0)
