"""Numbers that a build counts along the way, against counts of what it makes."""

import random

import pytest
from pyspark.sql import functions as F

from suffixloom.config import PERES_SHIELDS, Build, Sequencing
from suffixloom.operators import contexts as C
from suffixloom.operators.kmers import count_kmers
from suffixloom.operators.prune import Watch, edges
from suffixloom.plans.build import tree_from_sequences

BUILDS = [Build(max_depth=5, min_count=2, threshold=2.0), Build(max_depth=4, min_count=2, estimator=PERES_SHIELDS), Build(max_depth=6, min_count=3, threshold=1.0, sequencing=Sequencing(True, 1.5, 0.2))]


@pytest.mark.parametrize("build", BUILDS)
def test_numbers_of_a_build(spark, tmp_path, build):
    r = random.Random(3)
    rows = [(m, "".join(r.choice(["ACG", "TTTA", "GC", "N"]) for _ in range(90))) for m in "xyyz"]
    sequences = spark.createDataFrame(rows, "model string, seq string")
    watch = Watch()
    tree_from_sequences(sequences, build, ["model"], watch=watch).write.parquet(f"{tmp_path}/tree")
    tree, got = spark.read.parquet(f"{tmp_path}/tree"), watch.numbers()
    plain = tree_from_sequences(sequences, build, ["model"])
    assert sorted(map(tuple, tree.collect())) == sorted(map(tuple, plain.collect()))

    kmers = count_kmers(sequences, build.k, ["model"])
    supported = C.support(C.roll_up(kmers, build.max_depth, ["model"]), build.min_count, build.sequencing).cache()
    parents = supported.select("model", F.col("context").alias("parent"))
    lone = supported.filter("depth >= 1").withColumn("parent", F.expr("substring(context, 2)")).join(parents, ["model", "parent"], "left_anti")
    assert got["windows"] == kmers.agg(F.sum("count")).first()[0]
    assert got["supported"] == supported.filter("depth >= 1").count()
    assert got["orphans"] == lone.count()
    assert got["kept"] == tree.count() and got["terminal"] == tree.filter("is_terminal").count()
    if not got["orphans"]:
        assert got["significant"] == edges(supported, build, ["model"]).filter("raw_divergence >= least").count()


def test_nothing_to_count(spark):
    watch = Watch()
    assert tree_from_sequences(spark.createDataFrame([], "model string, seq string"), BUILDS[0], ["model"], watch=watch).count() == 0
    assert set(watch.numbers().values()) == {0}
