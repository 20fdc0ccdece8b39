"""Next-symbol probabilities and the divergence estimators, as Columns over a child and its parent.

Nodes carry their next-symbol counts as ``n_a, n_c, n_g, n_t``; ``prefix`` is put before these names
(``parent_`` for the parent's columns on an edge row).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import KULLBACK_LEIBLER, PERES_SHIELDS, Build, Sequencing

SYMBOLS = ("a", "c", "g", "t")


def probabilities(pseudo_count: float, prefix: str = "") -> list[Column]:
    """Smoothed probability of each next symbol: (count + pseudo) / (sum of counts + 4 pseudo)."""
    counts = [F.col(f"{prefix}n_{s}") for s in SYMBOLS]
    total = reduce(Column.__add__, counts) + F.lit(4.0 * pseudo_count)
    return [(c + F.lit(float(pseudo_count))) / total for c in counts]


def adjustment(sequencing: Sequencing, depth: Column) -> Column:
    """The factor by which counts of contexts of ``depth`` symbols are expected to shrink."""
    if not sequencing.adjust:
        return F.lit(1.0)
    return F.lit(float(sequencing.depth)) * F.pow(F.lit(1.0 - sequencing.error_rate), depth)


def kullback_leibler(pseudo_count: float, parent: str = "parent_") -> Column:
    """The child's count times the divergence of its next-symbol distribution from its parent's, in nats."""
    pairs = zip(probabilities(pseudo_count), probabilities(pseudo_count, parent), strict=True)
    return F.col("count") * reduce(Column.__add__, [p * F.log(p / q) for p, q in pairs])


def peres_shields(pseudo_count: float, parent: str = "parent_") -> Column:
    """The greatest excess of a child's probability over its parent's, times the child's count; 0 at least."""
    pairs = zip(probabilities(pseudo_count), probabilities(pseudo_count, parent), strict=True)
    return F.greatest(F.lit(0.0), *[(p - q) * F.col("count") for p, q in pairs])


#: An estimator gives an edge's divergence and the least divergence at which the child is significant.
Estimator = Callable[[Build, Column | None], tuple[Column, Column]]


def by_kullback_leibler(build: Build, threshold: Column | None = None) -> tuple[Column, Column]:
    """Divergence, and threshold times the sequencing adjustment."""
    limit = F.lit(float(build.threshold)) if threshold is None else threshold
    return kullback_leibler(build.pseudo_count), limit * adjustment(build.sequencing, F.col("depth"))


def by_peres_shields(build: Build, threshold: Column | None = None) -> tuple[Column, Column]:
    """Excess, and the root's count to the power 3/4 times the sequencing adjustment; needs column ``root_count``."""
    return peres_shields(build.pseudo_count), F.pow(F.col("root_count").cast("double"), F.lit(0.75)) * adjustment(build.sequencing, F.col("depth"))


BY_NAME: dict[str, Estimator] = {KULLBACK_LEIBLER: by_kullback_leibler, PERES_SHIELDS: by_peres_shields}


def estimator(build: Build, threshold: Column | None = None) -> tuple[Column, Column]:
    """The estimator that ``build`` names or has."""
    chosen = build.estimator if callable(build.estimator) else BY_NAME[build.estimator]
    return chosen(build, threshold)
