"""Similarity pruning: edges, significant contexts, the kept tree and its flags.

A context is kept if it is significant or a suffix of one that is: any extension of it that is kept
keeps it.  So the kept set is the distinct suffixes of the significant contexts, with the root; no
walk up the tree is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import KULLBACK_LEIBLER, Build
from ..functions.estimators import estimator
from ..functions.forms import form
from ..tables import small, written
from .contexts import NEXT, without_ends

TREE = ["context", "depth", *NEXT, "count", "divergence", "is_terminal"]


def edges(contexts: DataFrame, build: Build, by: list[str] = (), threshold: Column | None = None, counts: bool = False) -> DataFrame:
    """``by, context, parent, depth, raw_divergence, least``: each context with its divergence from its parent.

    ``least`` is the divergence at which it is significant.  ``threshold`` may be a column of ``contexts``.  With
    ``counts`` the context's counts come along.
    """
    of = form(contexts)
    parents = contexts.select(*by, F.col("context").alias("parent"), *[F.col(c).alias(f"parent_{c}") for c in NEXT])
    children = contexts.filter("depth >= 1").withColumn("parent", of.parent(F.col("context"), F.col("depth")))
    rows = children.join(parents, [*by, "parent"])
    if build.estimator != KULLBACK_LEIBLER:
        rows = with_roots(rows, contexts, by)
    divergence, least = estimator(build, threshold)
    return rows.select(*by, "context", "parent", "depth", *([*NEXT, "count"] if counts else []), divergence.alias("raw_divergence"), least.alias("least"))


class Watch:
    """Numbers that a build's own jobs count along the way, over all models; no pass over the data is added.

    ``numbers()`` gives ``supported`` (contexts of one symbol or more with enough support), ``orphans`` (those without
    their parent, which are dropped), ``significant``, and, once the tree was read or written for the first time, ``windows`` (the roots' counts), ``kept`` and
    ``terminal`` (nodes of the trees).  It waits for that first time.  Tasks that are run again after an executor is lost
    may be counted twice: these are figures to watch a job by, not results.  A watch serves one build.
    """

    def __init__(self):
        self.stages = {"edges": Observation(), "tree": Observation()}

    def on(self, stage: str, df: DataFrame, **numbers: Column) -> DataFrame:
        """``df``, whose rows are counted when they first go by."""
        return df.observe(self.stages[stage], *[F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for name, c in numbers.items()])

    def numbers(self) -> dict[str, int]:
        return {name: int(n or 0) for seen in self.stages.values() for name, n in seen.get.items()}


def linked(contexts: DataFrame, build: Build, by: list[str] = (), watch: Watch | None = None) -> DataFrame:
    """The edges of supported contexts with their counts, of those that ``close`` would leave: parents are looked up once for both."""
    of = form(contexts)
    parents = contexts.select(*by, F.col("context").alias("parent"), *[F.col(c).alias(f"parent_{c}") for c in NEXT])
    rows = contexts.filter("depth >= 1").withColumn("parent", of.parent(F.col("context"), F.col("depth"))).join(parents, [*by, "parent"], "left")
    if build.estimator != KULLBACK_LEIBLER:
        rows = with_roots(rows, contexts, by)
    divergence, least = estimator(build)
    lone = F.col(f"parent_{NEXT[0]}").isNull()
    found = rows.select(*by, "context", "depth", *NEXT, "count", divergence.alias("raw_divergence"), least.alias("least"), lone.alias("lone"))
    if watch:
        found = watch.on("edges", found, supported=F.count("*"), orphans=F.count_if("lone"), significant=F.count_if(~F.col("lone") & (F.col("raw_divergence") >= F.col("least"))))
    found = written(found, "edges")
    return without_ends(found.filter("not lone").drop("lone"), found.filter("lone").select(*by, "context"), by)


def with_roots(rows: DataFrame, contexts: DataFrame, by: list[str] = ()) -> DataFrame:
    """``rows`` with ``root_count``, the count of their model's root.

    One tree has one root, which an aggregate without keys says to the optimizer; many trees' roots are counted
    and broadcast if they are few.
    """
    roots = contexts.filter("depth = 0")
    if not by:
        return rows.crossJoin(F.broadcast(roots.agg(F.max("count").alias("root_count"))))
    return rows.join(small(roots.select(*by, F.col("count").alias("root_count")), "roots"), list(by))


def significant(found: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by, context``: the suffixes (of one symbol or more) of each significant context among edges."""
    rows = found.filter("raw_divergence >= least")
    return rows.select(*by, F.explode(form(found).suffixes(F.col("context"), F.col("depth"), 1)).alias("context"))


def kept(found: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by, context``: what of these is distinct."""
    return significant(found, by).distinct()


def prune(contexts: DataFrame, build: Build, by: list[str] = (), found: DataFrame | None = None) -> DataFrame:
    """``by`` and the tree: kept contexts with their divergence and whether they are terminal.

    ``divergence`` is -1 for the root and where there are kept children.  A context is terminal if fewer
    than four of its children are kept; the root never is.  ``found`` are the edges, with their contexts' counts.
    """
    found, of = edges(contexts, build, by, counts=True) if found is None else found, form(contexts)
    stay = kept(found, by)
    children = stay.groupBy(*by, of.parent(F.col("context"), of.depth(F.col("context"))).alias("context")).agg(F.count("*").alias("children"))
    values = ["depth", *NEXT, "count"]
    nodes = found.select(*by, "context", *values, "raw_divergence").join(stay, [*by, "context"])
    nodes = nodes.unionByName(contexts.filter("depth = 0").select(*by, "context", *values, F.lit(None).cast("double").alias("raw_divergence"))).join(children, [*by, "context"], "left")
    n = F.coalesce("children", F.lit(0))
    divergence = F.when((F.col("depth") == 0) | (n > 0), F.lit(-1.0)).otherwise(F.col("raw_divergence"))
    return nodes.withColumn("divergence", divergence).withColumn("is_terminal", (F.col("depth") > 0) & (n < 4)).select(*by, *TREE)


def reprune(tree: DataFrame, threshold: float, pseudo_count: float = 1.0, by: list[str] = ()) -> DataFrame:
    """Prune an existing tree by Kullback-Leibler divergence once more.

    For a threshold no less than the tree's own this gives the tree that the threshold would have built.
    """
    build = Build(max_depth=255, min_count=1, threshold=threshold, pseudo_count=pseudo_count, estimator=KULLBACK_LEIBLER)
    return prune(tree.select(*by, "context", "depth", *NEXT, "count"), build, by)
