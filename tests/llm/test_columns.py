"""Every operator on a table whose columns have odd names, with names that operators use inside beside them."""

import pytest

from suffixloom.llm import bpe, chat, decontaminate, langid, quality, sharding, simhash, substring, tokencount, warc
from suffixloom.llm.common import named

ROWS = [(k, f"the and of it number {k} and " + " ".join(f"w{k * 100 + i}" for i in range(60)), "en", f"x{k}") for k in range(6)] + [(7, None, None, None), (8, "", "en", "e")]
CLASH = ["row", "text", "doc", "fp", "mark", "_number", "lang", "slot", "n_tokens", "c0", "n0", "conv", "payload", "cut", "spans"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "`the.id` bigint, `the text` string, `a``b` string, extra string")
    return df.selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASH])


def whole(df, names):
    """Nothing but what was there, in every row."""
    got = df.select(*[named(n) for n in names]).collect()
    assert all(tuple(r)[4:] == tuple(CLASH) for r in got)
    return sorted((tuple(r)[:4] for r in got), key=str)


def test_operators_that_add_columns(spark, docs):
    names, want = docs.columns, sorted(ROWS, key=str)
    for out, _ in (
        sharding.assign(docs, ["the.id"]), tokencount.count_tokens(docs, "the text"), bpe.round_trip(docs, "the text"),
        langid.predict(docs, langid.train(docs, "the.id", "the text", "a`b"), "the text"),
    ):
        assert out.columns[: len(names)] == names and whole(out, names) == want
    out, _ = quality.judge(docs, "the text", "a`b")
    assert out.columns[:-1] == [n for n in names if n != "the text"] and out.count() == len(ROWS)


def test_operators_that_keep_rows(spark, docs):
    bench = spark.createDataFrame([(1, "nothing of this is anywhere in those texts at all or so")], "item_id bigint, text string")
    names = docs.columns
    assert whole(decontaminate.remove(docs, bench, row="the.id", text="the text"), names) == sorted(ROWS, key=str)
    assert whole(decontaminate.remove(docs, bench, "span", row="the.id", text="the text"), names) == sorted(ROWS, key=str)
    assert whole(substring.deduplicate(docs, "the.id", "the text"), names) == sorted(ROWS, key=str)
    assert whole(simhash.deduplicate(docs, "the.id", "the text"), names) == sorted(ROWS[:7], key=str)  # the wordless are one group
    assert whole(langid.keep(docs, "the.id", "the text", "a`b"), names) == sorted(ROWS[:6], key=str)


def test_operators_that_make_tables(spark, docs, tmp_path):
    warc.write_archive(docs, f"{tmp_path}/w", "the.id", "extra", "the text")
    assert warc.parse(warc.read_archive(spark, f"{tmp_path}/w")).count() == len(ROWS)
    assert chat.digests(chat.format_conversations(docs, "the.id", "extra", "a`b", "the text")).count() == len(ROWS)
    assert simhash.near_duplicates(docs, "the.id", "the text").count() == len(ROWS)
    assert sharding.write_shards(docs, ["the.id"], f"{tmp_path}/s", ["p", "q"], 11).groupBy().sum("rows").first()[0] == len(ROWS)
