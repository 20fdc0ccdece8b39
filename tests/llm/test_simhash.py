"""SimHash: fingerprints against a plain reading of the rule, classes against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from suffixloom.llm import simhash


def plain(text):
    text = "" if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [(i, plain(t)) for i, t in rows]
    parent = {k: k for k, _ in enumerate(fps)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, f"{f:016x}", least[root(k)]) for k, (i, f) in enumerate(fps)), key=str)


def texts(seed=1, n=90):
    r = random.Random(seed)
    words = ["Été", "the", "OF", "and", "x y", "wörd", "\x1f", *[f"w{i}" for i in range(300)]]
    out = []
    for _ in range(n):
        t = [r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 5, 30, 200, 600]))]
        out.append(" ".join(t))
        for _ in range(r.randrange(3)):
            c = list(t)
            c[r.randrange(len(c))] = "changed"
            out.append("\t\n ".join(c))
    return [*out, "", None, "   ", "\n", "", "the of and"]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, row string, key int".replace(", fp string, row string, key int", ""))
    found = simhash.near_duplicates(df, **options)
    return sorted(((x.row, f"{x.fp & (1 << 64) - 1:016x}", x.first_row) for x in found.collect()), key=str)


def test_against_all_pairs(spark):
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts())]
    rows += [(5, "tie tie"), (5, "tie tie"), (None, "null key"), (None, None)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, tile=20) == want  # hot keys as pairs of tiles
    assert run(spark, rows, n_blocks=7) == want


def test_links_of_planted_fingerprints(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(30):
            for k in r.choice(64, r.integers(1, 7), replace=False):
                b ^= 1 << int(k)
            fps.add(b)
    fps = np.array(sorted(fps), np.uint64)
    want = {(int(a), int(b)) for a in fps for b in fps[np.bitwise_count(fps ^ a) <= 4]}
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    for blocks, tile in ((5, 1 << 16), (6, 64), (9, 1 << 16)):
        parent = {int(x): int(x) for x in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in simhash.links(df, blocks, tile=tile).collect():
            a, b = a & (1 << 64) - 1, b & (1 << 64) - 1
            assert (a ^ b).bit_count() <= 4
            parent[root(a)] = root(b)
        assert all(root(a) == root(b) for a, b in want)


def test_deduplicate_keeps_one_of_each_class_and_all_columns(spark):
    rows = [(3, "same text here now", "a"), (1, "same text here now", "b"), (1, "same text here now", "c"), (None, "lonely words of no other document at all", "d"), (None, None, None), (9, "", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _row string")
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=str)
    assert got == [(1, "same text here now"), (9, ""), (None, "lonely words of no other document at all")]
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(150_000))
    assert run(spark, [(1, text)]) == [(1, f"{plain(text):016x}", 1)]


def test_edges_of_a_hub_are_split_over_tasks(spark):
    from suffixloom.llm import components as c

    path = spark.range(400_000, 400_008).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    low, high = (spark.range(1, 100_001).select(F.lit(hub).cast("bigint").alias("a"), F.col("id").alias("b")).unionByName(path) for hub in (0, 200_000))
    got = c.components(high).groupBy("root").count().collect()
    assert {x.root: x["count"] for x in got} == {1: 100_001, 400_000: 9}
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        for star in (c._large_star(c.written(low, "edges")), c._small_star(c.written(high, "edges"))):
            star.collect()
            assert "skew=true" in star._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
