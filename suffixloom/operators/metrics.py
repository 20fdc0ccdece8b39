"""What is asked of trees: sizes, distances, scores, and the choice of parameters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.estimators import SYMBOLS, kullback_leibler, probabilities
from ..functions.forms import Packed, form, packed, unpacked
from ..functions.symbols import all_suffixes, last, suffix
from ..tables import small, written
from .contexts import NEXT, closure, roll_up

# The grid that the choice of parameters goes through.
THRESHOLDS = (1.2, 3.9075, 10.0)
MIN_COUNTS = (
    1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 125, 150, 175, 200, 250, 300, 400, 500, 600, 700, 800, 900, 1000,
    2000, 3000, 4000, 5000, 10000,
)
#: Least depth of the grid; the greatest is one less than the depth asked for.
LEAST_DEPTH = 3


def terminals(tree: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by, n_terminal, sequence_size``: terminal contexts, and the root's count."""
    return tree.groupBy(*by).agg(F.count_if("is_terminal").alias("n_terminal"), F.max(F.when(F.col("depth") == 0, F.col("count"))).alias("sequence_size"))


def size(tree: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by, terminal_length, sequence_size``: symbols of all terminal contexts, and the counts of depth 1 added up."""
    zero = F.lit(0).cast("bigint")
    length = F.coalesce(F.sum(F.when(F.col("is_terminal"), F.col("depth").cast("bigint"))), zero)
    return tree.groupBy(*by).agg(length.alias("terminal_length"), F.coalesce(F.sum(F.when(F.col("depth") == 1, F.col("count"))), zero).alias("sequence_size"))


def remainder(tree: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by, context, count, remainder``: what of a context's count its children in the tree do not account for."""
    children = tree.filter("depth >= 1").groupBy(*by, form(tree).parent(F.col("context"), F.col("depth")).alias("context")).agg(F.sum("count").alias("below"))
    return tree.join(children, [*by, "context"], "left").select(*by, "context", "count", F.greatest(F.col("count") - F.coalesce("below", F.lit(0)), F.lit(0).cast("bigint")).alias("remainder"))


def shared(left: DataFrame, right: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by, context, in_left, in_right`` for each context of either tree."""
    a = left.select(*by, "context", F.lit(True).alias("in_left"))
    b = right.select(*by, "context", F.lit(True).alias("in_right"))
    none = F.lit(False)
    return a.join(b, [*by, "context"], "full_outer").select(*by, "context", F.coalesce("in_left", none).alias("in_left"), F.coalesce("in_right", none).alias("in_right"))


def components(tree: DataFrame, background_order: int = 0, pseudo_count: float = 1.0, by: list[str] = ()) -> DataFrame:
    """``by, context, depth, v_a, v_c, v_g, v_t``: next-symbol probabilities over the root of the background's.

    The background of a context is its suffix of ``background_order`` symbols, or the longest shorter one
    in the tree (in the end the root).
    """
    of = form(tree)
    own = tree.select(*by, "context", "depth", *[p.alias(f"p_{s}") for s, p in zip(SYMBOLS, probabilities(pseudo_count), strict=True)])
    back = tree.filter(F.col("depth") <= background_order).select(*by, F.col("context").alias("background"), *[F.col(c).alias(f"b_{c}") for c in NEXT])
    if background_order == 0:  # one root for each model
        joined = own.join(small(back, "roots"), list(by)) if by else own.crossJoin(F.broadcast(back.limit(1)))
    else:
        tries = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(background_order), F.col("depth"))), lambda n: of.last(F.col("context"), F.col("depth"), n)))
        joined = own.select("*", tries.alias("background")).join(back, [*by, "background"])
        best = joined.groupBy(*by, "context").agg(F.max_by(F.struct(*[c for c in joined.columns if c not in (*by, "context")]), of.depth(F.col("background"))).alias("x"))
        joined = best.select(*by, "context", "x.*")
    backs = probabilities(pseudo_count, "b_")
    return joined.select(*by, "context", "depth", *[(F.col(f"p_{s}") / F.sqrt(q)).alias(f"v_{s}") for s, q in zip(SYMBOLS, backs, strict=True)])


def angle(dot: Column, left: Column, right: Column) -> Column:
    """2 / pi times the angle of two vectors, from their dot product and squared lengths; 1 if either is zero."""
    cosine = dot / F.sqrt(left * right)
    return F.when((left > 0) & (right > 0), F.lit(2.0) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) / F.lit(math.pi)).otherwise(F.lit(1.0))


def distances(trees: DataFrame, model: str, pairs: DataFrame | None = None, background_order: int = 0, pseudo_count: float = 1.0) -> DataFrame:
    """``left_id, right_id, n_shared, n_missing, distance, penalized`` for pairs of models.

    ``trees`` has a column ``model``; ``pairs`` has ``left_id, right_id`` and defaults to all pairs with the
    lesser id on the left.  Only contexts in both trees of more than ``background_order`` symbols make the
    distance; ``penalized`` is 3/4 of it and 1/4 of the share of contexts that are in one tree only.

    Contexts up to the background's order are in nearly all trees; they make no rows in the join, their few
    names are compared by model.
    """
    vectors = components(trees, background_order, pseudo_count, [model]).filter(F.col("depth") > background_order)
    names = [f"v_{s}" for s in SYMBOLS]
    left = vectors.select(F.col(model).alias("left_id"), "context", *[F.col(v).alias(f"l{v}") for v in names])
    right = vectors.select(F.col(model).alias("right_id"), "context", *[F.col(v).alias(f"r{v}") for v in names])
    short = F.collect_set(F.when(F.col("depth") <= background_order, F.col("context")))  # at most all contexts of so few symbols
    sizes = small(trees.groupBy(F.col(model).alias("id")).agg(F.count("*").alias("n"), short.alias("short")), "models")
    as_side = lambda side: sizes.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"n_{side}"), F.col("short").alias(f"{side}_short"))
    if pairs is None:
        both = left.join(right, (left.context == right.context) & (F.col("left_id") < F.col("right_id")))
        models = as_side("left").join(as_side("right"), F.col("left_id") < F.col("right_id"))
    else:  # only rows of wanted pairs are made
        wanted = pairs.select("left_id", "right_id").distinct()
        both = left.join(wanted, "left_id").join(right, ["right_id", "context"])
        models = wanted.join(as_side("left"), "left_id").join(as_side("right"), "right_id")
    total = lambda x, y: sum((F.col(f"{x}{v}") * F.col(f"{y}{v}") for v in names[1:]), F.col(f"{x}{names[0]}") * F.col(f"{y}{names[0]}"))
    sums = both.groupBy("left_id", "right_id").agg(F.count("*").alias("n_deep"), F.sum(total("l", "r")).alias("dot"), F.sum(total("l", "l")).alias("ll"), F.sum(total("r", "r")).alias("rr"))
    rows = models.join(sums, ["left_id", "right_id"], "left").fillna(0, ["n_deep", "dot", "ll", "rr"])
    n_both = F.col("n_deep") + F.size(F.array_intersect("left_short", "right_short"))
    missing = F.col("n_left") + F.col("n_right") - 2 * n_both
    distance = angle(F.col("dot"), F.col("ll"), F.col("rr"))
    share = F.coalesce(F.try_divide(missing.cast("double"), (missing + F.col("n_deep")).cast("double")), F.lit(0.0))
    return rows.select("left_id", "right_id", F.col("n_deep").alias("n_shared"), missing.alias("n_missing"), distance.alias("distance"), (F.lit(0.75) * distance + F.lit(0.25) * share).alias("penalized"))


#: A measure of one's own: from three conditions (a context is in both trees, in the left one only, in the right one only) to named aggregates.
Measure = Callable[[Column, Column, Column], dict[str, Column]]


def compare(left: DataFrame, right: DataFrame, measures: list[Measure], by: list[str] = (), background_order: int = 0, pseudo_count: float = 1.0) -> DataFrame:
    """``by`` and what ``measures`` aggregate over the contexts of either tree, in one outer join.

    A row of it is a context, with its ``depth``, and for each side (``l_`` and ``r_`` before the names) its ``count``, counts of
    next symbols (``n_a`` ...), and components (``v_a`` ...); those of a side that has not got it are null.  Trees without rows make
    one row of aggregates over nothing where there are no ``by`` columns.
    """

    def side(tree: DataFrame, p: str) -> DataFrame:
        parts = components(tree, background_order, pseudo_count, by).drop("depth").join(tree.select(*by, "context", "depth", *NEXT, "count"), [*by, "context"])
        return parts.select(*by, "context", F.lit(True).alias(f"{p}in"), F.col("depth").alias(f"{p}depth"), *[F.col(c).alias(p + c) for c in ("count", *NEXT, *(f"v_{s}" for s in SYMBOLS))])

    rows = side(left, "l_").join(side(right, "r_"), [*by, "context"], "full_outer").withColumn("depth", F.coalesce("l_depth", "r_depth"))
    one, other = F.col("l_in").isNotNull(), F.col("r_in").isNotNull()
    made = {name: column for m in measures for name, column in m(one & other, one & ~other, other & ~one).items()}
    return rows.groupBy(*by).agg(*[column.alias(name) for name, column in made.items()])


def angle_measure(background_order: int = 0) -> Measure:
    """``n_shared, distance`` as ``distances`` has them."""

    def measure(both: Column, left_only: Column, right_only: Column) -> dict[str, Column]:
        used = both & (F.col("depth") > background_order)
        total = lambda x, y: F.coalesce(F.sum(F.when(used, sum((F.col(f"{x}_v_{s}") * F.col(f"{y}_v_{s}") for s in SYMBOLS[1:]), F.col(f"{x}_v_a") * F.col(f"{y}_v_a")))), F.lit(0.0))
        return {"n_shared": F.count_if(used), "distance": angle(total("l", "r"), total("l", "l"), total("r", "r"))}

    return measure


def penalized_measure(background_order: int = 0) -> Measure:
    """``n_missing, penalized``: 3/4 of the angle and 1/4 of the share of contexts that are in one tree only."""

    def measure(both: Column, left_only: Column, right_only: Column) -> dict[str, Column]:
        plain = angle_measure(background_order)(both, left_only, right_only)
        missing = F.count_if(left_only | right_only)
        share = F.coalesce(F.try_divide(missing.cast("double"), (missing + plain["n_shared"]).cast("double")), F.lit(0.0))
        return {"n_missing": missing, "penalized": F.lit(0.75) * plain["distance"] + F.lit(0.25) * share}

    return measure


def distance(left: DataFrame, right: DataFrame, background_order: int = 0, pseudo_count: float = 1.0) -> DataFrame:
    """The row of ``distances`` for two trees, without ids.

    A tree without rows is at distance 1 from any other; all contexts of the other are missing.
    """
    trees = left.select(F.lit(0).alias("model"), *left.columns).unionByName(right.select(F.lit(1).alias("model"), *right.columns))
    found = distances(trees, "model", None, background_order, pseudo_count)
    n = trees.agg(F.count("*").alias("n"))
    one = found.agg(F.count("*").alias("rows"), *[F.max(c).alias(c) for c in ("n_shared", "n_missing", "distance", "penalized")]).crossJoin(n)
    some = F.col("rows") > 0
    apart = F.when(F.col("n") > 0, 1.0).otherwise(0.75)
    return one.select(
        F.coalesce("n_shared", F.lit(0).cast("bigint")).alias("n_shared"), F.when(some, F.col("n_missing")).otherwise(F.col("n")).alias("n_missing"),
        F.coalesce("distance", F.lit(1.0)).alias("distance"), F.coalesce("penalized", apart).alias("penalized"),
    )


def log_likelihoods(kmers: DataFrame, tree: DataFrame, max_depth: int, pseudo_count: float = 1.0, by: list[str] = (), key: list[str] = ()) -> DataFrame:
    """``by, key, kmer, count, context, log_p``: each k-mer's last symbol under its longest context in the tree; ``key`` are columns of the k-mers only."""
    sizes = F.sequence(F.lit(0), F.lit(max_depth))
    own = [*by, *key, "kmer", "count"]
    tries = kmers.select(*own, F.substring("kmer", 1, max_depth).alias("before"), F.explode(sizes).alias("n")).select(*own, last(F.col("before"), F.col("n")).alias("context"))
    chances = F.map_from_arrays(F.array(*[F.lit(s.upper()) for s in SYMBOLS]), F.array(*probabilities(pseudo_count)))
    models = tree.select(*by, "context", "depth", chances.alias("p"))
    found = tries.join(models, [*by, "context"]).select(*own, "context", "depth", F.log(F.element_at("p", F.right("kmer", F.lit(1)))).alias("log_p"))
    return found.groupBy(*own).agg(F.max_by(F.struct("context", "log_p"), "depth").alias("x")).select(*own, "x.context", "x.log_p")


def windows_by_suffix(kmers: DataFrame, max_depth: int, by: list[str] = ()) -> DataFrame:
    """``by, context, seen_n_a, seen_n_c, seen_n_g, seen_n_t``: last symbols of windows, by each suffix of what stands before them."""
    of, k = form(kmers, "kmer"), F.lit(max_depth + 1)
    following = of.final(F.col("kmer"))
    sums = [F.sum(F.when(following == s, F.col("count")).otherwise(F.lit(0).cast("bigint"))).alias(f"seen_{c}") for s, c in zip(of.SYMBOLS, NEXT, strict=True)]
    whole = kmers.groupBy(*by, of.prefix(F.col("kmer"), k, max_depth).alias("before")).agg(*sums)
    rows = whole.select(*by, F.explode(of.suffixes(F.col("before"), F.lit(max_depth))).alias("context"), *[f"seen_{c}" for c in NEXT])
    return rows.groupBy(*by, "context").agg(*[F.sum(f"seen_{c}").alias(f"seen_{c}") for c in NEXT])


def score(kmers: DataFrame, tree: DataFrame, max_depth: int, pseudo_count: float = 1.0, by: list[str] = ()) -> DataFrame:
    """``by, n_windows, log_likelihood, nll``: ``nll`` is the mean negative log-likelihood of a window's last symbol, in nats.

    ``kmers`` has k-mers of ``max_depth + 1`` symbols.  Each window is scored by the longest context of the
    tree that precedes its last symbol.  A window's contexts in the tree are suffixes of each other, so its
    log-likelihood is what each adds to the next shorter one; windows are summed by context first and no
    window looks for its longest.
    """
    if form(kmers, "kmer") is not form(tree):
        tree = packed(tree) if form(kmers, "kmer") is Packed else unpacked(tree)
    logs = F.array(*[F.log(p) for p in probabilities(pseudo_count)])
    nodes = tree.select(*by, "context", "depth", logs.alias("logs"))
    shorter = nodes.filter("depth > 0").select(*by, "context", "depth", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("n"))
    shorter = shorter.select(*by, F.col("context").alias("whole"), form(tree).last(F.col("context"), F.col("depth"), F.col("n")).alias("context")).join(nodes, [*by, "context"])
    above = shorter.groupBy(*by, F.col("whole").alias("context")).agg(F.max_by("logs", "depth").alias("above"))
    seen = windows_by_suffix(kmers, max_depth, by).join(nodes.drop("depth"), [*by, "context"]).join(above, [*by, "context"], "left")
    counts = [F.col(f"seen_{c}") for c in NEXT]
    gain = sum((n * (F.col("logs")[i] - F.coalesce(F.col("above")[i], F.lit(0.0))) for i, n in enumerate(counts)), F.lit(0.0))
    scored = F.when(F.col("above").isNull(), sum(counts[1:], counts[0]))  # each window once, at its shortest context
    sums = seen.groupBy(*by).agg(F.sum(scored).alias("n_windows"), F.sum(gain).alias("log_likelihood"))
    return sums.select(*by, "n_windows", "log_likelihood", (-F.col("log_likelihood") / F.col("n_windows")).alias("nll"))


def bic_grid(counts: dict[int, DataFrame], min_counts=MIN_COUNTS, thresholds=THRESHOLDS, pseudo_count: float = 1.0, by: list[str] = ()) -> DataFrame:
    """``by, max_depth, min_count, threshold, n_params, log_likelihood, bic_score`` for every point of the grid.

    ``counts`` has k-mer counts (``by, kmer, count``, k = depth + 1) for each depth.  No tree is built: a
    threshold's trees are nested, so each context has for each threshold a greatest least count up to which it is
    kept (``keeps``), and one up to which four children of it are (``full``).  What it adds to the log-likelihood
    while it is kept is a number of its own, as a window is scored by its longest kept suffix and all shorter ones
    are kept too.  So every point of the grid is a conditional sum over one table of contexts.
    """
    out = None
    for depth, kmers in sorted(counts.items()):
        rows = _grid_of_depth(kmers, depth, sorted(map(int, min_counts)), [float(t) for t in thresholds], pseudo_count, list(by))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no depth to try")
    return out


def _grid_of_depth(kmers: DataFrame, depth: int, min_counts: list[int], thresholds: list[float], pseudo_count: float, by: list[str]) -> DataFrame:
    key = [*by, "context"]
    zero = F.lit(0).cast("bigint")
    all_contexts = written(roll_up(kmers, depth, by), "contexts")
    # the least count at which a context and all its suffixes are there
    deep = all_contexts.filter("depth >= 2").join(closure(all_contexts, by, F.col("count")), key).withColumn("until", F.least("count", "value")).drop("value")
    contexts = written(all_contexts.filter("depth < 2").withColumn("until", F.col("count")).unionByName(deep), "closed")
    parents = contexts.select(*by, F.col("context").alias("parent"), *[F.col(c).alias(f"parent_{c}") for c in NEXT])
    seen = windows_by_suffix(kmers, depth, by)
    own, above = probabilities(pseudo_count), probabilities(pseudo_count, "parent_")
    edge = contexts.filter("depth >= 1").withColumn("parent", suffix(F.col("context"))).join(parents, [*by, "parent"]).join(seen, key, "left")
    gain = sum((F.coalesce(f"seen_{c}", zero) * F.log(p / q) for c, p, q in zip(NEXT, own, above, strict=True)), F.lit(0.0))
    edge = written(edge.select(*key, "parent", "depth", "until", kullback_leibler(pseudo_count).alias("divergence"), gain.alias("gain")), "edges")
    # a context is kept at a threshold while one that ends in it is significant and there
    reach = F.array(*[F.when(F.col("divergence") >= t, F.col("until")).otherwise(zero) for t in thresholds])
    ends = edge.filter(F.col("divergence") >= min(thresholds)).select(*by, F.explode(all_suffixes(F.col("context"), 1)).alias("context"), reach.alias("reach"))
    names = [f"k{i}" for i in range(len(thresholds))]
    keeps = written(ends.groupBy(*key).agg(*[F.max(F.col("reach")[i]).alias(n) for i, n in enumerate(names)]), "keeps")
    four = [F.when(F.count("*") == 4, F.min(n)).otherwise(zero).alias(f"f{n}") for n in names]
    full = keeps.groupBy(*by, suffix(F.col("context")).alias("context")).agg(*four)
    nodes = keeps.join(full, key, "left").join(edge.select(*key, "gain"), key)
    points = [(i, m) for i in range(len(thresholds)) for m in min_counts]
    kept = lambda i, m: F.col(names[i]) >= m
    sums = [F.array(*[F.coalesce(F.sum(F.when(kept(i, m), F.col("gain"))), F.lit(0.0)) for i, m in points]).alias("gains"),
            F.array(*[F.count_if(kept(i, m) & (F.coalesce(f"f{names[i]}", zero) < m)) for i, m in points]).alias("terminals")]
    trees = nodes.groupBy(*by).agg(*sums)
    roots = contexts.filter("depth = 0").select(*by, F.col("count").alias("sequence_size"), *NEXT)
    roots = roots.join(seen.filter("context = ''").drop("context"), by, "left") if by else roots.crossJoin(seen.filter("context = ''").drop("context"))
    base = sum((F.coalesce(f"seen_{c}", zero) * F.log(p) for c, p in zip(NEXT, own, strict=True)), F.lit(0.0))
    roots = roots.select(*by, "sequence_size", base.alias("base"))
    rows = roots.join(trees, by, "left") if by else roots.crossJoin(trees)  # an empty tree has its root
    none = F.array_repeat(F.lit(0.0), len(points))
    grid = F.arrays_zip(
        F.array(*[F.lit(m) for _, m in points]).alias("min_count"), F.array(*[F.lit(thresholds[i]) for i, _ in points]).alias("threshold"),
        F.coalesce("gains", none).alias("gain"), F.coalesce("terminals", none.cast("array<bigint>")).alias("n"),
    )
    rows = rows.select(*by, "sequence_size", "base", F.explode(grid).alias("g")).select(
        *by, F.lit(depth).alias("max_depth"), "g.min_count", "g.threshold", (3 * F.col("g.n")).alias("n_params"), (F.col("base") + F.col("g.gain")).alias("log_likelihood"), "sequence_size"
    )
    score = F.col("n_params") * F.log(F.col("sequence_size").cast("double")) - 2 * F.col("log_likelihood")
    return rows.select(*by, "max_depth", "min_count", "threshold", "n_params", "log_likelihood", score.alias("bic_score"))


def bic_best(grid: DataFrame, by: list[str] = ()) -> DataFrame:
    """The grid's row of least score; ties go to the lesser depth, least count, and threshold."""
    rest = [c for c in grid.columns if c not in by]
    order = F.struct("bic_score", "max_depth", "min_count", "threshold")
    return grid.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*by, "x.*")
