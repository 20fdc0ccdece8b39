"""Documents to tokens: language ID, near-dedup, substring dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame, which is written as Parquet and reread for the next one.  All but the last return the
columns of ``documents``; the last returns each document's id, token count, and the digests and the
ids of its tokens.

In every stage null and empty texts, very long ones, ties, repeated rows, null ids, empty tables and extra
columns of any name have a defined result, which its docstring states; no stage cuts a text short, and none
but those named drops a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suffixloom.llm import bpe, decontaminate, langid, simhash, substring
from suffixloom.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, or with a very unsure one, go.

    Null, empty and letterless texts have no language.  Repeated rows stay or go alike; null ids teach the model
    nothing and are judged like others; where no row has a label all texts with a letter stay.  An empty table
    stays empty; all columns pass through.
    """
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, that with the least id.

    Wordless and null texts are one group.  Repeated rows and ids that tie are told apart by a written row number, so
    exactly one row of a group stays; a null id stays only where all are null.  An empty table stays empty; all
    columns pass through.
    """
    return simhash.deduplicate(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of nothing else goes.

    Earlier is the lesser id, or where ids are null or repeated the row that comes first; of repeated rows the first
    stays.  Null, empty and short texts, and documents that lose nothing, stay as they are.  Of texts only
    words are cut, the white space around them stays.  An empty table stays empty; all columns pass through.
    """
    return substring.deduplicate(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go.

    Null and wordless texts hit nothing and stay; repeated rows stay or go alike, null ids are judged like others.  An
    empty benchmark removes nothing, an empty table stays empty; all columns pass through.
    """
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: count, digests of ids and decoded text, and the ids themselves.

    A row for each row: null and empty texts have no tokens, repeated rows and null ids stay.  Other columns are
    not returned; an empty table gives no rows.
    """
    out, names = bpe.round_trip(docs.select("doc_id", "text"), keep_ids=True)
    return out.select("doc_id", *[F.col(c) for c in names])


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("benchmark_decontamination", benchmarks),
    ("bpe_encoding", tokens),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
