"""The archive: contract against a plain reading, exact records, export, damage."""

import base64
import gzip
import hashlib
from collections import Counter
from pathlib import Path

import pytest

from suffixloom.llm import warc

ROWS = [
    (1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (5, "http://c\r\nX: y", "<p>oné</p>\r\n\r\nWARC/1.0\r\n\r\n"), (3, None, None), (4, "http://d", ""),
    (7, "u", "same"), (7, "u", "same"), (6, "u", "same"), (None, "n", "same"), (None, "n", "only null"), (None, "n", "only null"), (9, "long", "é" * 700_000),
]


def want(rows, least=0):
    last = {}
    for i, _, t in rows:
        t = t or ""
        last[t] = i if last.get(t) is None else last[t] if i is None else max(i, last[t])
    out = []
    for i, _, t in rows:
        b, top = (t or "").encode(), last[t or ""]
        revisit = len(b) >= least and top is not None and i != top
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return Counter(out)


def got(records):
    return Counter((r.row, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.parse(records).collect())


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "'x' as payload", "1 as row")


def test_write_and_read_back(spark, pages, tmp_path):
    warc.write_archive(pages, f"{tmp_path}/a")
    assert got(warc.read_archive(spark, f"{tmp_path}/a")) == want(ROWS)
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len({t or "" for *_, t in ROWS})
    warc.write_archive(pages, f"{tmp_path}/b", least_bytes=5)
    assert got(warc.read_archive(spark, f"{tmp_path}/b")) == want(ROWS, 5)
    warc.write_archive(pages.limit(0), f"{tmp_path}/c")
    assert got(warc.read_archive(spark, f"{tmp_path}/c")) == Counter()


def test_export_holds_every_record(spark, pages, tmp_path):
    warc.write_archive(pages, f"{tmp_path}/a")
    warc.export_warc(spark, f"{tmp_path}/a", f"{tmp_path}/out", 2)
    records = [r for f in Path(tmp_path, "out").glob("*.gz") for r in warc.split_records(gzip.decompress(f.read_bytes()))]
    stored = [(bytes(r.header), bytes(r.payload)) for r in warc.read_archive(spark, f"{tmp_path}/a").collect()]
    assert Counter(records) == Counter(stored)


def test_damage_is_found(spark, pages, tmp_path):
    warc.write_archive(pages, f"{tmp_path}/a")
    bad = warc.read_archive(spark, f"{tmp_path}/a").selectExpr("row", "header", "sha256", "digest", "cast(replace(cast(payload as string), 'one', 'two') as binary) as payload")
    with pytest.raises(Exception, match="does not match"):
        warc.parse(bad).collect()
