"""Sharding: the table against a plain filling, shares, changes, placement and files."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from suffixloom.llm import sharding as s


def plain(shards, size):
    prefs = {}
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        offset, step = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        prefs[name] = iter([(offset + j * step) % size for j in range(size)])
    table = {}
    while len(table) < size:
        for name in sorted(shards):
            for slot in prefs[name]:
                if slot not in table:
                    table[slot] = name
                    break
            if len(table) == size:
                break
    return [table[i] for i in range(size)]


def slot(*parts, size):
    text = "".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % size


@pytest.mark.parametrize("n,size", [(1, 2), (3, 7), (5, 101), (16, 1009)])
def test_table_against_plain_filling(n, size):
    shards = [f"s{k}" for k in range(n)]
    assert [shards[i] for i in s.fill(shards, size)] == plain(shards, size)
    assert [shards[::-1][i] for i in s.fill(shards[::-1], size)] == plain(shards, size)


def test_shares_are_even_and_changes_small():
    shards = list(s.SHARDS)
    table = s.fill(shards)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = shards[:20] + shards[21:]
    after = [fewer[i] for i in s.fill(fewer)]
    moved = sum(a != shards[b] for a, b in zip(after, table) if b != 20)
    assert moved < 0.1 * len(table)
    heavy = np.bincount(s.fill(shards, turns={shards[3]: 2}))
    assert abs(heavy[3] / heavy[4] - 2) < 0.01


def test_bad_tables_are_refused():
    for bad in ([[], 7], [["a", "a"], 7], [["a"], 8], [["a", "b", "c"], 2]):
        with pytest.raises(ValueError):
            s.fill(*bad)


def test_placement(spark):
    rows = [(k, f"t{k}", "x", 9) for k in range(200)] + [(None, "", None, None), (None, None, "y", 1), (5, "t5", "z", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot string, shard int")
    out, (a, b) = s.assign(df, ["doc_id", "text"], ["p", "q", "r"], 101)
    assert out.columns == [*df.columns, "slot_", "shard_"] and (a, b) == ("slot_", "shard_")
    table = plain(["p", "q", "r"], 101)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r[a] == slot(r.doc_id, r.text, size=101) and r[b] == table[r[a]]
    assert s.assign(df.limit(0), ["doc_id"])[0].count() == 0


def test_query_is_whole(spark):
    out = s.op1_sharding(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()
    assert all(r.slot == slot(r.doc_id, size=s.SIZE) for r in out.collect()) and out.count() == 200


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(k % 3 and 1, f"t{k}") for k in range(900)], "key int, text string")
    manifest = s.write_shards(df, ["key"], f"{tmp_path}/out", ["a", "b"], 11, rows_per_file=100).collect()
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 900 == sum(m.rows for m in manifest)
    assert Counter(r.shard for r in back.collect()) == {m.shard: m.rows for m in manifest}


def test_files_of_hot_identical_and_clashing_rows(spark, tmp_path):
    """Most rows are one row; names clash; a shard's rows go to several files and nothing is lost."""
    hot = spark.range(60_000).selectExpr("'k' as key", "repeat('x', 200) as text", "'mine' as _salt", "'s' as shard", "1 as `a.b`")
    rest = spark.range(500).selectExpr("if(id % 7 = 0, null, concat('n', id)) as key", "concat('t', id) as text", "null as _salt", "null as shard", "cast(id as int) as `a.b`")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        manifest = s.write_shards(hot.union(rest), ["key"], f"{tmp_path}/hot", ["a", "b"], 11).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = spark.read.parquet(f"{tmp_path}/hot")
    assert sorted(back.columns) == sorted(["key", "text", "_salt", "shard", "a.b", "shard_"])
    assert back.exceptAll(s.assign(hot.union(rest), ["key"], ["a", "b"], 11)[0].drop("slot")).isEmpty() and back.count() == 60_500
    assert sum(m.rows for m in manifest) == 60_500
    assert s.write_shards(rest.limit(0), ["key"], f"{tmp_path}/none", ["a", "b"], 11).collect() == []
