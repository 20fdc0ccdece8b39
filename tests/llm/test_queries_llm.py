"""Registered queries against their SQL where they have some; all of them and the pipeline are there."""

import sys

import oracle
import pytest

import __spark_entry__
from suffixloom.plans.queries import QUERIES as ENGINE
from suffixloom.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert oracle.same(spark, oracle.connect(SF), QUERIES[name], ORACLE_SQL[name], SF) > 0


@pytest.mark.parametrize("name", ["op2_token_counts", "op5_langid", "op8_bpe", "op9_simhash"])
def test_other_queries_are_whole(spark, name):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in QUERIES[name](spark, SF).collect()} == docs


def test_queries_without_a_library(monkeypatch):
    """Where a library of these operators is missing, the engine's queries stay, and it is said what is left out."""
    for name in [m for m in sys.modules if m.startswith("suffixloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr("suffixloom.llm")
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    with pytest.warns(UserWarning, match="tiktoken"):
        assert set(__spark_entry__.queries()) == set(ENGINE)
