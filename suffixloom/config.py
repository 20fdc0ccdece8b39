"""Parameters of a model build, checked when they are made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

KULLBACK_LEIBLER, PERES_SHIELDS = "kullback-leibler", "peres-shields"
ESTIMATORS = (KULLBACK_LEIBLER, PERES_SHIELDS)
ALPHABET = "ACGT"
#: A support test of one's own: from the columns count, depth and least count to a boolean column.
Support = Callable[[Any, Any, Any], Any]


@dataclass(frozen=True)
class Sequencing:
    """How counts shrink with depth when reads have errors: ``depth * (1 - error_rate) ** length``, or 1 if not adjusted."""

    adjust: bool = False
    depth: float = 1.0
    error_rate: float = 0.0

    def __post_init__(self):
        if not 0 <= self.error_rate < 1:
            raise ValueError("error_rate must be at least 0 and under 1")
        if self.depth <= 0:
            raise ValueError("sequencing depth must be over 0")


@dataclass(frozen=True)
class Build:
    """What a context tree is built with.

    ``estimator`` names one of ``ESTIMATORS`` or is a function of the build and an optional threshold column that
    returns two columns over an edge (the child's columns, the parent's with ``parent_`` before their names, and
    ``root_count``): its divergence, and the least divergence at which the child is significant.  ``support``
    replaces the test of a context's count.
    """

    max_depth: int = 9
    min_count: int = 2
    threshold: float = 3.9075
    pseudo_count: float = 1.0
    estimator: str | Callable = KULLBACK_LEIBLER
    sequencing: Sequencing = field(default_factory=Sequencing)
    support: Support | None = None

    def __post_init__(self):
        if self.max_depth < 1:
            raise ValueError("max_depth must be 1 or more")
        if self.min_count < 1:
            raise ValueError("min_count must be 1 or more")
        if self.pseudo_count <= 0:
            raise ValueError("pseudo_count must be over 0")
        if self.estimator not in ESTIMATORS and not callable(self.estimator):
            raise ValueError(f"estimator must be one of {ESTIMATORS} or a function")

    @property
    def k(self) -> int:
        """Length of the k-mers that a tree of this depth is counted from."""
        return self.max_depth + 1
