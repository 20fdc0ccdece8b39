"""The shared folder, hints by size, and the driver's contract without the subpackage."""

import sys
from types import SimpleNamespace

import pytest

import __spark_entry__
from suffixloom import tables
from suffixloom.plans.queries import QUERIES


class Conf(dict):
    def set(self, key, value):
        self[key] = value


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_local_session_gets_one_folder(master):
    session = SimpleNamespace(conf=Conf({"spark.master": master}))
    a, b = (tables.shared_dir(session, "x") for _ in range(2))
    assert a != b and a.rpartition("/")[0] == b.rpartition("/")[0]


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[3,2,1024]", ""])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(SimpleNamespace(conf=Conf({"spark.master": master})), "x")
    named = SimpleNamespace(conf=Conf({"spark.master": master, "spark.checkpoint.dir": "hdfs://h/shared/"}))
    assert tables.shared_dir(named, "x").startswith("hdfs://h/shared/suffixloom-x-")


def test_small_tables_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few, left = spark.range(10), spark.range(1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(left.join(tables.small(few, "few", 10), "id"))
        assert "BroadcastHashJoin" not in plan(left.join(tables.small(few, "many", 9), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clean_deletes_what_was_written(spark, tmp_path):
    for name in ("suffixloom-a-1", "suffixloom-b-2", "other"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}")
    assert tables.clean(spark, f"file://{tmp_path}") == 2 and [p.name for p in tmp_path.iterdir()] == ["other"]


def test_queries_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "suffixloom.llm", None)
    assert set(__spark_entry__.queries()) == set(QUERIES) == set(__spark_entry__.oracle_sql())
