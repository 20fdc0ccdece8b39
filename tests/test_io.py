"""Sources, sinks, streams and the command line."""

import gzip

import pytest

from suffixloom import cli
from suffixloom.config import Build
from suffixloom.operators.kmers import count_kmers
from suffixloom.operators.metrics import distance
from suffixloom.plans.build import tree_from_sequences
from suffixloom.sources import archives as A
from suffixloom.sources import sequences as S
from suffixloom.sources import trees as T
from suffixloom.streaming import incremental as I

FASTA = ">one first record\nACGTACGT\nACGT\n>two\n\n>three > with a mark\r\nAC GT\r\nNNAC\r\n"


def key(r):
    return (r.context, r["count"], r.n_a, r.n_t, round(r.divergence, 9), r.is_terminal)


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([("ACGTTTACGGGATTACAGATTACA" * 20,), ("GGGATCCCATTTAGACCA" * 15,)], "seq string")


@pytest.fixture(scope="module")
def tree(spark, seqs):
    return tree_from_sequences(seqs, Build(4, 2, 1.2))


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">gz\nTTTT\n")
    got = sorted(tuple(r) for r in S.read_fasta(spark, str(tmp_path)).collect())
    assert got == [("gz", "", "TTTT"), ("one", "first record", "ACGTACGTACGT"), ("three", "> with a mark", "ACGTNNAC"), ("two", "", "")]


def test_fastq_in_blocks(spark, tmp_path):
    records = [(f"r{i}", "ACGT" * (1 + i % 3), "@II>" * (1 + i % 3)) for i in range(400)]
    (tmp_path / "a.fastq").write_text("".join(f"@{n} d\n{s}\n+\n{q}\n" for n, s, q in records))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = sorted((r.seq_id, r.seq, r.quality) for r in S.read_fastq(spark, str(tmp_path / "a.fastq")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(records)


def test_text_as_symbols(spark):
    df = spark.createDataFrame([("aBcD é z!",), (None,), ("",)], "text string")
    assert [r.seq for r in S.from_text(df, "text").collect()] == ["ACGTC", "", ""]
    assert [r.seq for r in S.from_text(df, "text", squeeze=False).collect()][0] == "ACGTNCN"


def test_kmer_table_is_checked(spark, tmp_path, seqs):
    count_kmers(seqs, 5).write.parquet(f"{tmp_path}/good")
    assert S.read_kmers(spark, f"{tmp_path}/good", 5).count() == count_kmers(seqs, 5).count()
    for rows in ([("ACGN", 1)], [("ACGT", 0)], [("ACG", 2)]):
        spark.createDataFrame(rows, "kmer string, count bigint").write.mode("overwrite").parquet(f"{tmp_path}/bad")
        with pytest.raises(Exception, match="not a k-mer count"):
            S.read_kmers(spark, f"{tmp_path}/bad", 4).collect()
    with pytest.raises(ValueError):
        S.read_kmers(spark, _tree_path(spark, tmp_path), 4)


def _tree_path(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/other")
    return f"{tmp_path}/other"


def test_tree_table(spark, tmp_path, tree):
    T.write_tree(tree, f"{tmp_path}/t")
    assert sorted(map(key, T.read_tree(spark, f"{tmp_path}/t").collect())) == sorted(map(key, tree.collect()))


def test_numbers_of_six_digits(spark):
    """Equal to %g, ties and all."""
    import random

    r = random.Random(2)
    values = [999999.7, 123456.5, 123457.5, 0.0, -0.0, 1e-5, 0.00012345650000000001, 99999.95, 1e300, -1.0, 2.5e-310]
    values += [r.uniform(-1, 1) * 10.0 ** r.randint(-12, 12) for _ in range(100_000)] + [(2 * r.randint(0, 10**6) + 1) / 2 for _ in range(50_000)] + [r.randint(10**5, 10**6) * 10.0 ** r.randint(-9, 5) + 5 * 10.0 ** r.randint(-12, 4) for _ in range(50_000)]
    got = spark.createDataFrame([(v,) for v in values], "d double").select("d", T._six("d").alias("s")).collect()
    assert len(got) == len(values) and all(x.s == "%g" % x.d for x in got)


def test_dump_lines(spark, tmp_path):
    rows = [("", 0, 4, 3, 2, 1, 10, -1.0, False), ("T", 1, 1, 1, 1, 1, 4, 12.3456789, True), ("AT", 2, 1, 1, 1, 1, 4, 1234567.0, True), ("CT", 2, 1, 1, 1, 1, 4, 0.0000123456, True), ("GT", 2, 1, 1, 1, 1, 4, 100.0, True), ("TT", 2, 1, 1, 1, 1, 4, 0.5, True)]
    tree = spark.createDataFrame(rows, T.TREE_SCHEMA)
    got = [r.value for r in T.dump(tree, f"{tmp_path}/d").collect()]
    assert got == ["TT 4 1 1 1 1 0.5 1 0", "GT 4 1 1 1 1 100 1 0", "CT 4 1 1 1 1 1.23456e-05 1 0", "AT 4 1 1 1 1 1.23457e+06 1 0", "T 4 1 1 1 1 12.3457 1 0", " 10 4 3 2 1 -1 0 0"]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/d").collect()) == sorted(got)


def test_stream_counts_each_batch_once(spark, tmp_path, seqs):
    folder, table = tmp_path / "in", str(tmp_path / "counts")
    folder.mkdir()
    texts = [r.seq for r in seqs.collect()]
    want = {r.kmer: r["count"] for r in count_kmers(seqs, 5).collect()}
    for i, t in enumerate(texts):
        (folder / f"{i}.fa").write_text(f">s{i}\n{t[:100]}\n{t[100:]}\n")
        I.count_stream(I.fasta_stream(spark, str(folder)), 5, table, str(tmp_path / "cp")).awaitTermination()
    assert {r.kmer: r["count"] for r in I.current_counts(spark, table).collect()} == want
    assert {r.kmer: r["count"] for r in I.compact(spark, table, str(tmp_path / "one")).collect()} == want
    a = I.current_tree(spark, table, Build(4, 2, 1.2))
    assert sorted(map(key, a.collect())) == sorted(map(key, tree_from_sequences(seqs, Build(4, 2, 1.2)).collect()))
    q = I.live_counts(I.fasta_stream(spark, str(folder)), 5).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.kmer: r["count"] for r in spark.table("live").collect()} == want


def test_command_line(spark, tmp_path, seqs, capsys):
    p = lambda n: str(tmp_path / n)
    for i, r in enumerate(seqs.collect()):
        (tmp_path / f"{i}.fa").write_text(f">s\n{r.seq}\n")
    go = lambda *a: cli.run(spark, [str(x) for x in a])
    for i in (0, 1):
        assert go("--mode", "BUILD", "--fasta-path", p(f"{i}.fa"), "--out-path", p(f"t{i}"), "--max-depth", 4, "--threshold", 1.2, "--in-or-out-of-core", "hash") == 0
    assert go("--mode", "count", "--fasta-path", p("0.fa"), "--out-path", p("k0"), "--max-depth", 4) == 0
    assert go("--mode", "union", "--in-path", p("k0"), "--to-path", p("k0"), "--out-path", p("k1")) == 0
    assert go("--mode", "build-from-kmer-table", "--in-path", p("k0"), "--out-path", p("t.bintree"), "--max-depth", 4, "--threshold", 1.2) == 0
    assert sorted(map(key, A.read_archive(spark, p("t.bintree")).collect())) == sorted(map(key, T.read_tree(spark, p("t0")).collect()))
    assert go("--mode", "reprune", "--in-path", p("t.bintree"), "--out-path", p("r"), "--threshold", 20) == 0
    capsys.readouterr()
    assert go("--mode", "dissimilarity", "--in-path", p("t0"), "--to-path", p("t1")) == 0
    d = distance(T.read_tree(spark, p("t0")), T.read_tree(spark, p("t1"))).first()
    assert capsys.readouterr().out.strip() == f"{d.distance:.6g}"
    assert go("--mode", "dissimilarity", "--dissimilarity", "penalized-angle", "--in-path", p("t0"), "--to-path", p("t1")) == 0
    assert capsys.readouterr().out.strip() == f"{d.penalized:.6g}"
    assert go("--mode", "score", "--fasta-path", p("1.fa"), "--in-path", p("t0"), "--max-depth", 4) == 0
    assert float(capsys.readouterr().out) > 0
    assert go("--mode", "size", "--in-path", p("t0")) == 0 and len(capsys.readouterr().out.split()) == 3
    assert go("--mode", "dump", "--in-path", p("t0")) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == T.read_tree(spark, p("t0")).count() and lines[-1].startswith(" ")
    assert go("--mode", "build") == 1


def test_grid_csv(spark, tmp_path):
    grid = spark.createDataFrame([(4, 2, 1.5, 30, -100.0, 250.0)], "max_depth int, min_count int, threshold double, n_params bigint, log_likelihood double, bic_score double")
    T.write_grid(grid, f"{tmp_path}/g")
    T.write_grid(grid, f"{tmp_path}/g")
    got = spark.read.option("header", True).csv(f"{tmp_path}/g").collect()
    assert [tuple(r) for r in got] == [("30", "250.0", "2", "4", "1.5", "-100.0", "0")] * 2


def test_fasta_in_pieces(spark, tmp_path):
    """Windows of records that go over many blocks are those of the whole records."""
    import random

    r = random.Random(31)
    records = []
    for k in range(12):
        seq = "".join(r.choice("ACGTacgtN") for _ in range(r.choice([0, 3, 50, 700, 4000])))
        records.append((f"r{k}", "some words" if k % 2 else "", seq))
    for part in (0, 1):
        (tmp_path / f"{part}.fa").write_text("".join(f">{i} {d}".rstrip() + "\r\n" + "".join(s[a : a + 60] + "\r\n" for a in range(0, len(s), 60)) for i, d, s in records[part * 6 : part * 6 + 6]))
    for size in ("300b", "1000b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            whole, pieces = S.read_fasta(spark, str(tmp_path)), S.read_fasta_pieces(spark, str(tmp_path), 7)
            assert sorted(tuple(x) for x in whole.collect()) == sorted(records)
            key = lambda x: (x.seq_id, x.description, x.kmer, x["count"])
            by = ["seq_id", "description"]
            assert sorted(map(key, count_kmers(pieces, 7, by).collect())) == sorted(map(key, count_kmers(whole, 7, by).collect()))
            if size == "300b":
                assert pieces.count() > 30
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
