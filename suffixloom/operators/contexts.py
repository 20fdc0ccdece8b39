"""Contexts: the roll-up of k-mer counts over prefixes, the support test, and suffix closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Sequencing, Support
from ..functions.estimators import SYMBOLS, adjustment
from ..functions.forms import form
from ..tables import small, written

NEXT = [f"n_{s}" for s in SYMBOLS]


def roll_up(kmers: DataFrame, max_depth: int, by: list[str] = ()) -> DataFrame:
    """``by, context, depth, n_a, n_c, n_g, n_t, count`` for each prefix of 0 to ``max_depth`` symbols of k-mers of ``max_depth + 1``.

    ``n_x`` counts the windows that start with the context followed by x; ``count`` is their sum.
    """
    cut = kmers.select(*by, "kmer", "count", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    rows = cut.select(*by, "depth", F.substring("kmer", F.lit(1), F.col("depth")).alias("context"), F.substring("kmer", F.col("depth") + 1, F.lit(1)).alias("next"), "count")
    sums = [F.coalesce(F.sum(F.when(F.col("next") == s.upper(), F.col("count"))), F.lit(0).cast("bigint")).alias(f"n_{s}") for s in SYMBOLS]
    return rows.groupBy(*by, "context", "depth").agg(*sums, F.sum("count").alias("count")).select(*by, "context", "depth", *NEXT, "count")


def support(contexts: DataFrame, min_count="min_count", sequencing: Sequencing = Sequencing(), predicate: Support | None = None) -> DataFrame:
    """Contexts whose count is at least ``min_count`` (a number or a column's name) times the sequencing adjustment; the root always.

    ``predicate`` takes the place of this test: a function of the columns count and depth (and of ``min_count``)
    that says which contexts have enough.
    """
    return contexts.filter((F.col("depth") == 0) | enough(min_count, sequencing, predicate))


def enough(min_count="min_count", sequencing: Sequencing = Sequencing(), predicate: Support | None = None) -> Column:
    """The test of ``support``, without its exception for roots."""
    least = F.col(min_count) if isinstance(min_count, str) else F.lit(min_count)
    if predicate:
        return predicate(F.col("count"), F.col("depth"), least)
    if sequencing.adjust:
        return F.col("count").cast("double") >= least.cast("double") * adjustment(sequencing, F.col("depth"))
    return F.col("count") >= least


def closure(contexts: DataFrame, by: list[str] = (), extra: Column | None = None) -> DataFrame:
    """``by, context, value`` for each context of two symbols or more whose suffixes are all there: the least ``extra`` among them.

    Each context looks its own suffixes up; the least depth that can be missing is one.
    """
    value, of = F.lit(0) if extra is None else extra, form(contexts)
    deep = contexts.filter("depth >= 2")
    wanted = deep.select(*by, F.col("context").alias("whole"), "depth", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("n")).select(*by, "whole", "depth", of.last(F.col("whole"), F.col("depth"), F.col("n")).alias("context"))
    there = wanted.join(contexts.filter("depth >= 1").select(*by, "context", value.alias("value")), [*by, "context"])
    found = there.groupBy(*by, F.col("whole").alias("context"), "depth").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    return found.filter(F.col("n") == F.col("depth") - 1).select(*by, "context", "value")


def close(contexts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Contexts all of whose suffixes are there too.

    Windows at the end of a fragment, and thresholds that fall with depth, can leave a context without
    its parent; such orphans are dropped, and all that end in one, so every context but the root has its parent.
    Each context looks up its parent only; orphans are few, and those that end in one are found by broadcast.
    """
    of, deep = form(contexts), contexts.filter("depth >= 2")
    parents = contexts.filter("depth >= 1").select(*by, F.col("context").alias("parent"))
    lone = deep.withColumn("parent", of.parent(F.col("context"), F.col("depth"))).join(parents, [*by, "parent"], "left_anti").select(*by, "context")
    return without_ends(contexts, lone, by)


def without_ends(contexts: DataFrame, lone: DataFrame, by: list[str] = ()) -> DataFrame:
    """``contexts`` without those in ``lone``, and without all that end in one: only the lengths that ``lone`` has are looked up."""
    of, lone = form(contexts), small(lone, "orphans")
    lengths = [r.n for r in lone.select(of.depth(F.col("context")).alias("n")).distinct().collect()]  # no more than depths
    if not lengths:
        return contexts
    own = F.filter(F.lit(sorted(lengths)), lambda n: n <= F.col("depth"))
    ends = contexts.select(*by, F.col("context").alias("whole"), "depth", F.explode(own).alias("n")).select(*by, "whole", of.last(F.col("whole"), F.col("depth"), F.col("n")).alias("context"))
    gone = ends.join(lone, [*by, "context"], "left_semi").select(*by, F.col("whole").alias("context")).distinct()
    return contexts.join(gone, [*by, "context"], "left_anti").select(contexts.columns)


def orphans(contexts: DataFrame, by: list[str] = ()) -> DataFrame:
    """The contexts that ``close`` drops."""
    return contexts.join(close(contexts, by).select(*by, "context"), [*by, "context"], "left_anti").select(contexts.columns)


def places(contexts: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by, context, place``: each context's place, from 1, in the post-order of its tree.

    Contexts are dealt by ranges of the order and numbered in their range; what earlier ranges hold is added.  So a
    tree's size does not matter, and no task sorts a whole tree.
    """
    of = form(contexts)
    own = of.order(F.col("context"), of.depth(F.col("context")))
    order = [*[F.col(b) for b in by], *own]
    part = contexts.select(*by, "context").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    part = written(part, "ranges")
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy(*by, "part").agg(F.count("*").alias("n")).select(*by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    number = F.row_number().over(Window.partitionBy(*by, "part").orderBy(*own))
    return part.withColumn("number", number).join(F.broadcast(counts), [*by, "part"]).select(*by, "context", (F.col("earlier") + F.col("number")).cast("int").alias("place"))
