"""Hard negatives against all pairs, and what odd rows give."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from suffixloom.llm import negatives

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, most=5, percent=80):
    good = [(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    good = list(dict.fromkeys(good))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in (r for r in good if is_anchor(r[0])):
        own = sorted(((-score(a, r), r[0]) for r in good if r is not a and r[1] == a[1]))[:positives]
        others = sorted((-score(a, r), r[0]) for r in good if r[1] != a[1])
        for p, p_id in own:
            inside = [(n, i) for n, i in others if percent * -p <= 100 * -n <= 100 * -p][:most]
            out += [(a[0], p_id, k, i, -p, -n) for k, (n, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, anchor, **options):
    out = negatives.mine(negatives.integers(df), anchor, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def some(n, width, labels, seed, ties=False):
    rng = random.Random(seed)
    pool = [[rng.uniform(-0.2, 1) for _ in range(width)] for _ in range(9)]
    vector = lambda: rng.choice(pool) if ties else [rng.uniform(-0.2, 1) for _ in range(width)]
    return [(i, vector(), rng.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("ties", [False, True])
def test_against_all_pairs(spark, monkeypatch, ties):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "ROWS", 30)
    rows = some(240, 13, [1, 1, 1, 2, 3, 40], 3 + ties, ties)
    got = mined(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 9 == 0, chunk=4)
    assert got == brute(rows, lambda i: i % 9 == 0) and got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(40, 3, [0, 1], 8)
    rows += [(100, None, 1), (101, [1.0, None, 0.0], 1), (102, [nan, 1.0, 1.0], 0), (103, [inf, 1.0, 1.0], 0), (104, [-inf, 1.0, 1.0], 0), (105, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [rows[0], rows[0], (0, [0.5, 0.5, 0.5], 1), (200, [], 1), (201, [1.0], 0), (202, [1.0, 1.0, 1.0, 1.0, 1.0], 1)]  # repeated rows and ids, vectors of other lengths
    df = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("number"), F.lit(2).alias("g"), F.lit(3).alias("v"), F.lit("x").alias("block"))
    assert mined(df, F.col("vec_id") % 3 == 0, chunk=2) == brute(rows, lambda i: i % 3 == 0)


def test_few_positives_and_scores_of_no_window(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, [0.0, 0.0], 1), (5, [1.0, 0.0], 3), (6, [1.0, 0.0], 3)]
    got = mined(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0)
    assert got == brute(rows, lambda i: i == 0) == [(0, 3, 1, 2, 0, 0)]
    assert mined(spark.createDataFrame([(0, [1.0], 1)], VECTORS), F.lit(True)) == []
    assert mined(spark.createDataFrame([], VECTORS), F.lit(True)) == []


def test_product_is_exact_where_doubles_are_not():
    rng = np.random.default_rng(1)
    for most in (1 << 20, 1 << 30):
        a, b = rng.integers(-most, most, (5, 8)), rng.integers(-most, most, (6, 8))
        assert negatives.product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


def test_cells_are_joined_by_their_place(spark):
    rows = negatives.integers(spark.createDataFrame(some(50, 4, [0, 1], 5), VECTORS)).withColumn("number", F.monotonically_increasing_id())
    blocks = negatives._Blocks(rows, 10, 2)
    plan = negatives._tiles(blocks, blocks, 2, False)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_copies_of_blocks_are_not_broadcast(spark):
    """Small in a shuffle's files, a block's copies for all blocks that it meets would be unpacked in the driver."""
    rows = negatives.integers(spark.createDataFrame(some(50, 4, [0, 1], 5), VECTORS)).select(F.monotonically_increasing_id().alias("number"), "vec_id", "label", "v")
    blocks = negatives._Blocks(rows, 10, 2)
    tiles = negatives._tiles(blocks, blocks, 2, False)
    assert tiles.collect()
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_one_panels_tiles_are_not_shuffled(spark, monkeypatch):
    rows = negatives.integers(spark.createDataFrame(some(50, 4, [0, 1], 5), VECTORS)).select(F.monotonically_increasing_id().alias("number"), "vec_id", "label", "v")
    blocks = negatives._Blocks(rows, 10, 2)
    plan = lambda: negatives._reduced(blocks, blocks, 2, True, "number bigint, positive_id bigint, positive_score bigint", negatives._positives(5))._jdf.queryExecution().toString()
    assert "tile" not in plan()
    monkeypatch.setattr(negatives, "PANEL", 1)
    assert "tile" in plan()


@pytest.mark.parametrize("panel", [1, 2, 3])
def test_tiles_of_several_panels_are_added(spark, monkeypatch, panel):
    for name, value in (("ANCHORS", 7), ("ROWS", 30), ("PANEL", panel)):
        monkeypatch.setattr(negatives, name, value)
    rows = some(150, 13, [1, 1, 2, 3], 6) + [(200 + i, v[: i % 14], label) for i, v, label in some(60, 13, [1, 2], 9)]  # 0 to 4 chunks
    got = mined(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 9 == 0, chunk=4)
    assert got == brute(rows, lambda i: i % 9 == 0) and got
