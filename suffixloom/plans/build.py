"""Whole plans: sequences or k-mer counts in, a tree or an answer about trees out.

The roll-up is read several times (closure, edges, pruning), so it is written once, by k-mers in order; sequences are read
once for a tree and once for a whole parameter grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Build
from ..functions.forms import MOST, unpacked
from ..operators.contexts import close, enough
from ..operators.kmers import LONGEST_CODE, count_all, count_kmers, count_packed
from ..operators.metrics import LEAST_DEPTH, MIN_COUNTS, THRESHOLDS, bic_grid, score
from ..operators.prune import Watch, linked, prune
from ..operators.rollup import roll_up_sorted
from ..tables import written


def contexts_from_kmers(kmers: DataFrame, build: Build, by: list[str] = ()) -> DataFrame:
    """Supported contexts, each with its parent, as a written table."""
    test = enough(build.min_count, build.sequencing, build.support)
    return written(close(roll_up_sorted(kmers, build.max_depth, by, test), by), "contexts")


def tree_from_kmers(kmers: DataFrame, build: Build, by: list[str] = (), watch: Watch | None = None) -> DataFrame:
    """The pruned tree of a table of k-mer counts; ``by`` are model columns, each value one tree.

    In between contexts are packed numbers, if they are short enough and no rules of one's own are to see them.
    ``watch`` gets the numbers of the build's stages.
    """
    own = callable(build.estimator) or build.support is not None
    test = enough(build.min_count, build.sequencing, build.support)
    contexts = roll_up_sorted(kmers, build.max_depth, by, test, build.max_depth <= MOST and not own)
    tree = unpacked(prune(contexts, build, by, linked(contexts, build, by, watch)))
    if watch:
        tree = watch.on("tree", tree, windows=F.sum(F.when(F.col("depth") == 0, F.col("count"))), kept=F.count("*"), terminal=F.count_if("is_terminal"))
    return tree


def tree_from_sequences(sequences: DataFrame, build: Build, by: list[str] = (), seq: str = "seq", spread: int | None = None, watch: Watch | None = None) -> DataFrame:
    """The pruned tree of sequences; ``watch`` gets the numbers of the build's stages."""
    counted = count_packed if build.k <= LONGEST_CODE else count_kmers
    return tree_from_kmers(counted(sequences, build.k, by, seq, spread), build, by, watch)


def score_sequences(sequences: DataFrame, tree: DataFrame, max_depth: int, pseudo_count: float = 1.0, by: list[str] = (), seq: str = "seq") -> DataFrame:
    """Mean negative log-likelihood of sequences under a tree."""
    return score(count_kmers(sequences, max_depth + 1, by, seq), tree, max_depth, pseudo_count, by)


def bic_sequences(sequences: DataFrame, max_depth: int, min_counts=MIN_COUNTS, thresholds=THRESHOLDS, pseudo_count: float = 1.0, by: list[str] = (), seq: str = "seq") -> DataFrame:
    """The parameter grid of sequences for depths from 3 to ``max_depth - 1``."""
    depths = range(LEAST_DEPTH, max_depth)
    if not depths:
        raise ValueError(f"max_depth must be over {LEAST_DEPTH}")
    counts = written(count_all(sequences, [d + 1 for d in depths], by, seq), "kmers")
    return bic_grid({d: counts.filter(counts.k == d + 1).drop("k") for d in depths}, min_counts, thresholds, pseudo_count, by)
