"""Trees that are kept up to date: new sequences change some counts, and only what hangs on these is made anew.

Counts live in the state store of a streaming aggregation in update mode, which passes on the contexts whose
counts a micro-batch changed, with their totals.  Each batch then

1. finds contexts that have enough support now, and those whose suffixes are all there now,
2. computes the divergence of contexts whose own counts or whose parent's changed, and of no others,
3. where a context became significant or no longer is, adds or takes one from all its suffixes (a context is
   kept while it is a suffix of some significant one), and where kept contexts change, from their parents' children,
4. writes new versions of the rows that any of this touched, as a layer.

The newest version of a row counts.  A layer has its batch's number and is overwritten if the batch is tried again, and a
batch reads earlier layers only, so results are exact however often it is tried.  Every ``whole_every`` batches a
layer holds all rows, so few layers are read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import ESTIMATORS, PERES_SHIELDS, Build
from ..functions.estimators import estimator
from ..functions.symbols import all_suffixes, last, suffix
from ..operators.contexts import NEXT, roll_up, support
from ..operators.kmers import tallies
from ..operators.prune import TREE, with_roots
from ..tables import written

_NODE = "depth int, n_a bigint, n_c bigint, n_g bigint, n_t bigint, count bigint, closed boolean, raw_divergence double, significant boolean, n_significant bigint, n_children bigint, recomputed boolean"
_COUNTS = [*NEXT, "count"]


class MaintainedTree:
    """Trees (one for each value of the ``by`` columns, which must not be null) in the folder ``path``.

    The estimator must be one of those with a name, and support must not be lost as counts grow (any least
    count is such a test).  Contexts without support stay in the state store only; for more contexts than executors' memory
    holds choose the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """

    def __init__(self, spark: SparkSession, path: str, build: Build, by: list[str] = (), whole_every: int = 16):
        if build.estimator not in ESTIMATORS:
            raise ValueError(f"a maintained tree needs one of the estimators {ESTIMATORS}")
        if whole_every < 1:
            raise ValueError("whole_every must be 1 or more")
        self.spark, self.path, self.build, self.by, self.whole_every = spark, path, build, list(by), whole_every
        self.keys = [*self.by, "context"]

    def start(self, sequences: DataFrame, checkpoint: str, seq: str = "seq", trigger: dict | None = None) -> StreamingQuery:
        """Start to take in a stream of sequences; returns the running query.

        ``trigger`` is passed to the stream's trigger and defaults to working off what is there.
        """
        counts = tallies(sequences, [self.build.k], self.by, seq).withColumnRenamed("n", "count")
        changed = roll_up(counts, self.build.max_depth, self.by)
        return changed.writeStream.outputMode("update").foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def layers(self) -> DataFrame:
        """All versions of all rows, with the ``batch`` that wrote them and whether its layer is ``whole``."""
        return self.spark.read.parquet(f"{self.path}/nodes")

    def nodes(self, before: int | None = None) -> DataFrame:
        """The newest version of each supported context, of batches under ``before`` if given."""
        rows = self.layers()
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        base = rows.filter("whole = 1").agg(F.max("batch")).first()[0]  # of partition columns only
        base = -1 if base is None else base
        rows = rows.filter(((F.col("whole") == 1) & (F.col("batch") == base)) | ((F.col("whole") == 0) & (F.col("batch") > base)))
        values = [f.name for f in StructType.fromDDL(_NODE)]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*self.keys, "x.*")

    def tree(self) -> DataFrame:
        """The trees of all sequences so far, as ``prune`` would give them."""
        n = F.col("n_children")
        rows = self.nodes().filter("depth = 0 or n_significant > 0")
        divergence = F.when((F.col("depth") == 0) | (n > 0), F.lit(-1.0)).otherwise(F.col("raw_divergence"))
        return rows.withColumn("divergence", divergence).withColumn("is_terminal", (F.col("depth") > 0) & (n < 4)).select(*self.by, *TREE)

    def _before(self, number: int, like: DataFrame) -> DataFrame:
        """Rows as earlier batches left them; none at first."""
        try:
            return self.nodes(number)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        schema = StructType([*[like.schema[k] for k in self.keys], *StructType.fromDDL(_NODE).fields])
        return self.spark.createDataFrame([], schema)

    def update(self, changed: DataFrame, number: int) -> None:
        """Take in a batch: ``changed`` has contexts whose counts changed, with their totals (as ``roll_up`` gives them)."""
        build, by, keys = self.build, self.by, self.keys
        delta = written(support(changed, build.min_count, build.sequencing, build.support), "changed")
        old = self._before(number, delta)
        touched = written(self._closed(delta, old), "touched")
        edges = written(self._edges(touched, old), "recomputed")
        flips = written(self._flips(edges, touched, old), "flips")
        ups = flips.select(*by, F.explode(all_suffixes(F.col("context"), 1)).alias("context"), F.when(F.col("now"), 1).otherwise(-1).alias("d"))
        ups = written(ups.groupBy(*keys).agg(F.sum("d").alias("d_significant")).filter("d_significant <> 0"), "significant")
        had = F.coalesce("n_significant", F.lit(0))
        moved = ups.join(old.select(*keys, "n_significant"), keys, "left").withColumn("after", had + F.col("d_significant")).filter((had > 0) != (F.col("after") > 0))
        kids = moved.select(*by, suffix(F.col("context")).alias("context"), F.when(F.col("after") > 0, 1).otherwise(-1).alias("d")).groupBy(*keys).agg(F.sum("d").alias("d_children"))
        parts = (touched.select(*keys, F.lit(True).alias("is_new"), F.col("depth").alias("new_depth"), *[F.col(c).alias(f"new_{c}") for c in _COUNTS], F.col("closed").alias("new_closed")),
                 edges.select(*keys, F.col("raw_divergence").alias("new_divergence")), flips.select(*keys, "now"), ups, written(kids, "children"))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.join(p, keys, "full_outer")
        rows = rows.join(old, keys, "left")
        new = lambda c: F.coalesce(f"new_{c}", c)
        zero, no = F.lit(0).cast("bigint"), F.lit(False)
        plus = lambda c, d: (F.coalesce(c, zero) + F.coalesce(d, zero)).alias(c)
        layer = rows.select(
            *keys, new("depth").alias("depth"), *[new(c).alias(c) for c in _COUNTS], F.coalesce("new_closed", "closed").alias("closed"), F.coalesce("new_divergence", "raw_divergence").alias("raw_divergence"),
            F.coalesce("now", "significant", no).alias("significant"), plus("n_significant", "d_significant"), plus("n_children", "d_children"), F.col("new_divergence").isNotNull().alias("recomputed"),
        )
        layer.write.mode("overwrite").parquet(f"{self.path}/nodes/whole=0/batch={number}")
        if (number + 1) % self.whole_every == 0:
            self.nodes(number + 1).write.mode("overwrite").parquet(f"{self.path}/nodes/whole=1/batch={number}")

    def _closed(self, delta: DataFrame, old: DataFrame) -> DataFrame:
        """``delta``, and earlier contexts that were waiting for a suffix, with whether all their suffixes are there now.

        Contexts that were closed before stay so; only the others look their suffixes up.
        """
        by, keys = self.by, self.keys
        known = delta.join(old.select(*keys, F.col("closed").alias("was")), keys, "left").withColumn("was", F.coalesce("was", F.lit(False)))
        waiting = old.filter("not closed").join(delta.select(*keys), keys, "left_anti")
        known = known.select(*keys, "depth", *_COUNTS, "was", F.lit(True).alias("changed")).unionByName(waiting.select(*keys, "depth", *_COUNTS, F.lit(False).alias("was"), F.lit(False).alias("changed")))
        deep = known.filter("not was and depth >= 2")
        wanted = deep.select(*by, F.col("context").alias("whole"), "depth", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("n")).select(*by, "whole", "depth", last(F.col("whole"), F.col("n")).alias("context"))
        there = delta.select(*keys).unionByName(old.select(*keys)).distinct()
        full = wanted.join(there, keys).groupBy(*by, F.col("whole").alias("context"), "depth").agg(F.count("*").alias("n")).filter("n = depth - 1")
        rows = known.join(full.select(*keys, F.lit(True).alias("full")), keys, "left")
        closed = F.col("was") | (F.col("depth") < 2) | F.coalesce("full", F.lit(False))
        # a context that waited and waits on is left as it was
        return rows.withColumn("closed", closed).filter("changed or closed").select(*keys, "depth", *_COUNTS, "closed")

    def _edges(self, touched: DataFrame, old: DataFrame) -> DataFrame:
        """``raw_divergence`` of closed contexts that are touched themselves or whose parents are."""
        by, keys = self.by, self.keys
        parent = [*by, "parent"]
        prior = lambda df, p: df.select(*by, F.col("context").alias("parent"), *[F.col(c).alias(f"{p}{c}") for c in NEXT])
        mine = touched.filter("closed and depth >= 1").withColumn("parent", suffix(F.col("context")))
        own = mine.join(prior(touched, "new_"), parent, "left").join(prior(old, "old_"), parent, "left")
        own = own.select(*keys, "depth", *_COUNTS, *[F.coalesce(f"new_{c}", f"old_{c}").alias(f"parent_{c}") for c in NEXT])
        theirs = old.filter("closed and depth >= 1").withColumn("parent", suffix(F.col("context"))).join(prior(touched, "parent_"), parent)
        theirs = theirs.join(touched.select(*keys), keys, "left_anti").select(own.columns)
        divergence, _ = estimator(self.build)
        return own.unionByName(theirs).select(*keys, "depth", divergence.alias("raw_divergence"))

    def _flips(self, edges: DataFrame, touched: DataFrame, old: DataFrame) -> DataFrame:
        """Contexts that became significant (``now``) or no longer are."""
        by, keys = self.by, self.keys
        rows = edges.join(old.select(*keys, "significant"), keys, "left").select(*keys, "depth", "raw_divergence", "significant")
        if self.build.estimator == PERES_SHIELDS:  # what is significant follows the root's count, for all contexts
            rest = old.filter("closed and depth >= 1").join(edges.select(*keys), keys, "left_anti")
            rows = rows.unionByName(rest.select(rows.columns))
            roots = touched.filter("depth = 0").select(*by, "context", "depth", "count")
            roots = roots.unionByName(old.filter("depth = 0").join(roots.select(*keys), keys, "left_anti").select(roots.columns))
            rows = with_roots(rows, written(roots, "roots"), by)
        _, least = estimator(self.build)
        now = F.col("raw_divergence") >= least
        return rows.select(*keys, now.alias("now"), F.coalesce("significant", F.lit(False)).alias("was")).filter("now <> was")
