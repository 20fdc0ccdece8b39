"""Command line: build, build-from-kmer-table, dump, score, bic, dissimilarity, reprune, size, count, union.

    python -m suffixloom.cli --mode build --fasta-path in.fa --out-path tree --max-depth 9
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .config import ESTIMATORS, KULLBACK_LEIBLER, Build, Sequencing
from .operators.kmers import count_kmers, union_counts
from .operators.metrics import bic_best, distance, size, terminals
from .operators.prune import reprune
from .plans.build import bic_sequences, score_sequences, tree_from_kmers, tree_from_sequences
from .sources.archives import read_archive, write_archive
from .sources.sequences import read_fasta_pieces, read_fastq, read_kmers
from .sources.trees import dump, read_tree, write_grid, write_tree
from .tables import clean, written

MODES = ("build", "build-from-kmer-table", "dump", "score", "bic", "dissimilarity", "reprune", "size", "count", "union")
DISTANCES = ("angle", "penalized-angle")
CORES = ("internal", "external", "hash")


def parser() -> argparse.ArgumentParser:
    """All options with their defaults; names of choices are taken in either case."""
    p = argparse.ArgumentParser(prog="suffixloom", description=__doc__)
    add = p.add_argument
    add("-m", "--mode", choices=MODES, type=str.lower, default="build")
    add("--dissimilarity", choices=DISTANCES, type=str.lower, default="angle")
    add("--estimator", choices=ESTIMATORS, type=str.lower, default=KULLBACK_LEIBLER)
    add("-p", "--fasta-path", help="FASTA, or FASTQ by its ending")
    add("--in-path", help="tree (folder or .bintree archive) or k-mer table")
    add("--to-path", help="second tree or k-mer table")
    add("-o", "--out-path")
    add("-t", "--temp-path", help="accepted for compatibility; Spark has its own scratch folders")
    add("-c", "--min-count", type=int, default=2)
    add("-k", "--threshold", type=float, default=3.9075)
    add("-d", "--max-depth", type=int, default=9)
    add("-a", "--pseudo-count-amount", type=float, default=1.0)
    add("-i", "--in-or-out-of-core", choices=CORES, type=str.lower, default="internal", help="accepted for compatibility; Spark spills as it needs")
    add("--adjust-for-sequencing-errors", action="store_true")
    add("--sequencing-depth", type=float, default=1.0)
    add("--sequencing-error-rate", type=float, default=0.0)
    add("--background-order", type=int, default=0)
    return p


def _sequences(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Sequences for windows of up to ``k`` symbols; a FASTA file is read by its blocks."""
    return read_fastq(spark, path) if path.removesuffix(".gz").endswith((".fastq", ".fq")) else read_fasta_pieces(spark, path, k)


def _tree(spark: SparkSession, path: str) -> DataFrame:
    return written(read_archive(spark, path).drop("file"), "archive") if path.endswith(".bintree") else read_tree(spark, path)


def _store(tree: DataFrame, path: str) -> None:
    if path.endswith(".bintree"):
        write_archive(tree, path)
    else:
        write_tree(tree, path, "overwrite")


def run(spark: SparkSession, argv: list[str]) -> int:
    """Do what the arguments say; print answers that are single values.  Returns the exit code."""
    a = parser().parse_args(argv)
    needs = {"build": ("fasta_path", "out_path"), "build-from-kmer-table": ("in_path", "out_path"), "dump": ("in_path",), "score": ("fasta_path", "in_path"), "bic": ("fasta_path",), "dissimilarity": ("in_path", "to_path"), "reprune": ("in_path", "out_path"), "size": ("in_path",), "count": ("fasta_path", "out_path"), "union": ("in_path", "to_path", "out_path")}
    missing = [f"--{n.replace('_', '-')}" for n in needs[a.mode] if not getattr(a, n)]
    if missing:
        print(f"{a.mode} needs {', '.join(missing)}", file=sys.stderr)
        return 1
    build = Build(a.max_depth, a.min_count, a.threshold, a.pseudo_count_amount, a.estimator, Sequencing(a.adjust_for_sequencing_errors, a.sequencing_depth, a.sequencing_error_rate))
    if a.mode == "build":
        _store(tree_from_sequences(_sequences(spark, a.fasta_path, build.k), build), a.out_path)
    elif a.mode == "build-from-kmer-table":
        _store(tree_from_kmers(read_kmers(spark, a.in_path, build.k), build), a.out_path)
    elif a.mode == "dump":
        lines = dump(_tree(spark, a.in_path), a.out_path, "overwrite")
        if not a.out_path:
            for row in lines.toLocalIterator():
                print(row.value)
    elif a.mode == "score":
        row = score_sequences(_sequences(spark, a.fasta_path, build.k), _tree(spark, a.in_path), a.max_depth, a.pseudo_count_amount).first()
        print(row.nll if row.nll is not None else 0.0)
    elif a.mode == "bic":
        grid = written(bic_sequences(_sequences(spark, a.fasta_path, build.k), a.max_depth, pseudo_count=a.pseudo_count_amount), "grid")
        if a.out_path:
            write_grid(grid, a.out_path)
        best = bic_best(grid).first()
        print(f"max depth {best.max_depth}, min count {best.min_count}, threshold {best.threshold:g}, BIC {best.bic_score:.6g}, parameters {best.n_params}")
    elif a.mode == "dissimilarity":
        row = distance(_tree(spark, a.in_path), _tree(spark, a.to_path), a.background_order, a.pseudo_count_amount).first()
        print(f"{row.distance if a.dissimilarity == 'angle' else row.penalized:.6g}")
    elif a.mode == "reprune":
        _store(reprune(_tree(spark, a.in_path), a.threshold, a.pseudo_count_amount), a.out_path)
    elif a.mode == "size":
        tree = _tree(spark, a.in_path)
        s, t = size(tree).first(), terminals(tree).first()
        print(f"{s.terminal_length} {s.sequence_size} {t.n_terminal}")
    elif a.mode == "count":
        count_kmers(_sequences(spark, a.fasta_path, build.k), build.k).write.mode("overwrite").parquet(a.out_path)
    else:
        union_counts(read_kmers(spark, a.in_path), read_kmers(spark, a.to_path)).write.mode("overwrite").parquet(a.out_path)
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("suffixloom").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    finally:
        if "suffixloom.scratch.dir" in spark.conf.getAll:
            clean(spark)  # a folder of this session's own
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
