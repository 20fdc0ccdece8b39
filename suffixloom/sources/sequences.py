"""Sequence sources: FASTA, FASTQ, and text columns; k-mer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ALPHABET
from ..tables import written

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``seq_id, description, seq`` for each record of FASTA files (a file, folder, glob or list; compressed ones too).

    Line breaks and blanks inside a sequence are dropped.  A record without a sequence has an empty one.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value"))
    parts = records.select(F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "").alias("header"), F.when(F.instr("value", "\n") > 0, F.regexp_replace("value", r"^[^\n]*\n", "")).otherwise("").alias("body"))
    seq = F.regexp_replace("body", r"\s+", "")
    parts = parts.select("header", seq.alias("seq")).filter("header <> '' or seq <> ''")
    return parts.select(F.regexp_extract("header", r"^\S*", 0).alias("seq_id"), F.trim(F.regexp_replace("header", r"^\S*", "")).alias("description"), "seq")


def _blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, file, block, id`` for each line: where its block of the file begins, and a number that grows within the block."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def read_fasta_pieces(spark: SparkSession, path: str | list[str], k: int) -> DataFrame:
    """``seq_id, description, seq``: FASTA records in pieces, one for each block of a file that a record is in.

    A piece goes on for ``k - 1`` symbols into the next one of its record, so windows of ``k`` symbols are those of
    the whole records (shorter ones are not).  So a chromosome is read, joined and counted by as many tasks as its
    file has blocks.  Blocks must have more than ``k`` symbols; a record without a sequence has no piece.
    """
    lines = written(_blocks(spark, path), "lines")
    marked = lines.withColumn("head", F.when(F.col("value").startswith(">"), F.col("value")))
    own = marked.withColumn("record", F.last(F.when(F.col("head").isNotNull(), F.struct("id", "head")), ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("id")))
    ends = marked.filter("head is not null").groupBy("file", "block").agg(F.max(F.struct("id", "head")).alias("end"))
    blocks = lines.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    placed = own.join(blocks.select("file", "block", before.alias("before")), ["file", "block"]).filter("head is null").withColumn("record", F.coalesce("record", "before"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: F.regexp_replace(x["value"], r"\s+", "")), "")
    pieces = placed.groupBy("file", "record", "block").agg(text.alias("seq")).filter("seq <> ''")
    # a record's number grows with its line, and so do blocks
    after = F.lead(F.substring("seq", 1, k - 1)).over(Window.partitionBy("file", "record").orderBy("block")) if k > 1 else F.lit("")
    header = F.coalesce(F.substring("record.head", 2, 2147483647), F.lit(""))
    pieces = pieces.select(header.alias("header"), F.concat("seq", F.coalesce(after, F.lit(""))).alias("seq"))
    return pieces.select(F.regexp_extract("header", r"^\S*", 0).alias("seq_id"), F.trim(F.regexp_replace("header", r"^\S*", "")).alias("description"), "seq")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``seq_id, description, seq, quality`` for each record of FASTQ files: four lines a record.

    Lines are numbered within their file from the number of lines in the file's earlier blocks, so a file
    is read in as many pieces as it has blocks.
    """
    lines = _blocks(spark, path)
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(blocks.select("file", "block", "first", earlier.alias("before")), ["file", "block"]).select("file", "value", (F.col("before") + F.col("id") - F.col("first")).alias("line"))
    one = lambda k, name: F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(name)
    records = placed.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(one(0, "header"), one(1, "seq"), one(3, "quality")).filter("header like '@%'")
    header = F.substring("header", 2, 2147483647)
    return records.select(F.regexp_extract(header, r"^\S*", 0).alias("seq_id"), F.trim(F.regexp_replace(header, r"^\S*", "")).alias("description"), F.coalesce("seq", F.lit("")).alias("seq"), "quality")


def write_fasta(sequences: DataFrame, path: str, seq_id: str = "seq_id", description: str = "description", seq: str = "seq", width: int = 60, mode: str = "errorifexists") -> None:
    """Sequences as FASTA files in a folder, lines of ``width`` symbols.  Null ids, descriptions and sequences are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = F.regexp_replace(text(seq), f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), F.rtrim(F.concat_ws(" ", text(seq_id), text(description))), F.lit("\n"), lines).alias("value")).write.mode(mode).text(path)


def write_fastq(sequences: DataFrame, path: str, seq_id: str = "seq_id", description: str = "description", seq: str = "seq", quality: str | None = None, mode: str = "errorifexists") -> None:
    """Sequences as FASTQ files in a folder, four lines a record; without ``quality`` each symbol gets the same (``I``)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    marks = text(quality) if quality else F.repeat(F.lit("I"), F.length(text(seq)))
    sequences.select(F.concat(F.lit("@"), F.rtrim(F.concat_ws(" ", text(seq_id), text(description))), F.lit("\n"), text(seq), F.lit("\n+\n"), marks).alias("value")).write.mode(mode).text(path)


def as_symbols(text, squeeze: bool = True):
    """Text as a sequence over ACGT: each ASCII letter, in either case, by its place in the alphabet modulo 4.

    Other characters are left out (``squeeze``) or stay and break the sequence into fragments.
    """
    mapped = F.translate(text, LETTERS + LETTERS.upper(), "".join(ALPHABET[i % 4] for i in range(26)) * 2)
    return F.regexp_replace(mapped, "[^ACGT]+", "") if squeeze else F.regexp_replace(mapped, "[^ACGT]+", "N")


def from_text(table: DataFrame, text: str, by: list[str] = (), squeeze: bool = True) -> DataFrame:
    """``by, seq``: a text column as sequences; null text is an empty one."""
    return table.select(*by, as_symbols(F.coalesce(F.col(text), F.lit("")), squeeze).alias("seq"))


def read_kmers(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """``kmer, count`` from a Parquet table of counts, checked: strings over ACGT, of ``k`` symbols if given, counts of 1 or more.

    A row that breaks this stops the query that reads it.
    """
    table = spark.read.parquet(path)
    missing = {"kmer", "count"} - set(table.columns)
    if missing:
        raise ValueError(f"{path} has no column {sorted(missing)}")
    good = F.col("kmer").rlike(f"^[ACGT]{{{k}}}$" if k else "^[ACGT]+$") & (F.col("count") >= 1)
    checked = F.when(good, F.col("kmer")).otherwise(F.raise_error(F.concat(F.lit("not a k-mer count: "), F.coalesce(F.col("kmer").cast("string"), F.lit("null")))).cast("string"))
    return table.select(*[c for c in table.columns if c not in ("kmer", "count")], checked.alias("kmer"), F.col("count").cast("bigint").alias("count"))
