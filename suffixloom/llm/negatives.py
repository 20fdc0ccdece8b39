"""Hard negatives by a two-dimensional block matrix product.

Anchors and rows are dealt to blocks, and their vectors cut into chunks of dimensions.  A shuffle brings each block to its row or
column of a grid, where a cell multiplies an anchor block with a row block chunk by chunk: tiles of
partial scores, 64-bit integers.  The tiles of a panel of chunks are added where they are made, those of several panels meet in a
shuffle and are added there; so what is shuffled is blocks, and tiles only of vectors so wide that a block is as large as its tile.  The sum is reduced to
what each anchor needs, so no score matrix is kept.  Positives come from the cells of an anchor's own label group; then anchors meet
all rows with the score windows of their positives at hand, and each cell passes on the first few rows of each window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, PandasCogroupedOps, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import named, tidy, written

#: Anchors and rows of a block (a tile has 8 bytes for each pair, and each block goes to all blocks of the other side), and dimensions of a chunk.
ANCHORS, ROWS, CHUNK = 2048, 2048, 32
#: Chunks of a panel.
PANEL = 32
#: Rows of one label are kept together, in so many groups by hash of the label.
GROUPS = 16
POSITIVES, NEGATIVES = 5, 5
#: A negative has at least so many hundredths of the positive's score, and at most that score.
LEAST_PERCENT = 80
SCALE = 256
#: In the query, one in so many rows is an anchor, and one in so many is given another label (of so many).
ANCHOR_STEP, MOVED_STEP, LABELS = 100, 7, 10
#: Sums of products of doubles under this are exact.
_EXACT = float(1 << 53)


def integers(vectors: DataFrame, row: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v``: rows that take part, components as ``floor(scale * x)``.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; identical rows
    (after rounding) count once.  Components beyond 64 bits become the greatest or least number of these.
    """
    found = vectors.select(named(row).cast("bigint").alias("vec_id"), named(label).cast("bigint").alias("label"), named(vector).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = found.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(~bad)
    return kept.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("bigint")).alias("v")).distinct()


class _Blocks:
    """Rows dealt to blocks of about ``size``, of one label group each, with a row for each chunk of dimensions.

    A row's block follows its number's hash, so no label and no id makes a large one.  Blocks are numbered through: group g
    has ``count[g]`` of them from ``first[g]`` on.  No row has more than ``chunks`` chunks.
    """

    def __init__(self, rows: DataFrame, size: int, chunk: int, groups: int = GROUPS):
        group = F.pmod(F.xxhash64("label"), F.lit(groups)).cast("int")
        parts = F.greatest(F.lit(1), F.ceil(F.size("v") / chunk)).cast("int")
        rows = rows.withColumn("g", group)
        found = rows.groupBy("g").agg(F.count("*").alias("n"), F.max(parts).alias("parts")).collect()  # as many rows as groups at most
        counts = {r.g: -(-r.n // size) for r in found}
        self.chunks = max((r.parts for r in found), default=1)
        self.count = [counts.get(g, 0) for g in range(groups)]
        self.first = np.concatenate([[0], np.cumsum(self.count)]).tolist()
        block = F.get(F.lit(self.first[:-1]), F.col("g")) + F.pmod(F.xxhash64("number"), F.get(F.lit(self.count), F.col("g"))).cast("int")
        cut = rows.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("c"))
        keep = F.struct(*[c for c in rows.columns if c not in ("g", "v")], F.slice("v", F.col("c") * chunk + 1, F.lit(chunk)).alias("v"))
        self.rows = cut.select("g", "block", "c", keep.alias("row")).groupBy("g", "block", "c").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def along(self, other: _Blocks, same: bool) -> DataFrame:
        """Each block once for every block of ``other`` that it meets, column ``met``: all, or with ``same`` those of its group."""
        if same:
            first, count = F.get(F.lit(other.first[:-1]), F.col("g")), F.get(F.lit(other.count), F.col("g"))
        else:
            first, count = F.lit(0), F.lit(other.first[-1])
        return self.rows.filter(count > 0).withColumn("met", F.explode(F.sequence(first, first + count - 1)))


def _matrix(v: pa.Array, chunk: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, shorter ones padded with zeros."""
    lengths, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(lengths) * chunk:
        return flat.reshape(-1, chunk)
    m = np.zeros((len(lengths), chunk), np.int64)
    m[np.arange(chunk) < lengths[:, None]] = flat
    return m


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in 64-bit integers, by way of doubles where these are exact."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not a.size or not b.size or np.abs(x).max() * np.abs(y).max() * a.shape[1] < _EXACT:
        return (x @ y.T).astype(np.int64)
    return a @ b.T


def _cells(anchors: _Blocks, rows: _Blocks, same: bool) -> PandasCogroupedOps:
    """Anchor blocks and row blocks by cell of the grid and panel, ``a, b, p``: a row for each chunk ``c`` of a side.

    Both sides are shuffled.  A join would be free to broadcast one: the copies of a block, one for each block that it meets, take little room in
    a shuffle's files, but all of them would be unpacked in the driver.
    """
    panel = F.floor(F.col("c") / PANEL).alias("p")
    a = anchors.along(rows, same).select(F.col("block").alias("a"), F.col("met").alias("b"), panel, "c", "rows")
    b = rows.along(anchors, same).select(F.col("met").alias("a"), F.col("block").alias("b"), panel, "c", "rows")
    return a.groupBy("a", "b", "p").cogroup(b.groupBy("a", "b", "p"))


def _add(scores: np.ndarray, rows: np.ndarray, columns: np.ndarray, tile: np.ndarray, some: np.ndarray, others: np.ndarray) -> None:
    """Add to ``scores`` (of the numbers ``rows`` and ``columns``, rising) the ``tile`` of some of them."""
    if tile.shape == scores.shape:
        scores += tile
    else:  # some vectors are shorter and have no such chunk
        scores[np.ix_(np.searchsorted(rows, some), np.searchsorted(columns, others))] += tile


def _panel(left: pa.Table, right: pa.Table, chunk: int) -> tuple[int, int, np.ndarray] | None:
    """Where the panel's first chunk is on each side, and the sum of the tiles of the chunks that both have; None if a side has none.

    Rows are those of the first chunk, in order of their numbers: who has a later one has this too.
    """
    if not left.num_rows or not right.num_rows:
        return None
    x, y = ({c.as_py(): r.values for c, r in zip(side.column("c"), side.column("rows"), strict=True)} for side in (left, right))
    first = min(x)
    rows, columns = _numbers(x[first], "number"), _numbers(y[first], "number")
    scores = np.zeros((len(rows), len(columns)), np.int64)
    for c in x.keys() & y.keys():
        tile = product(_matrix(x[c].field("v"), chunk), _matrix(y[c].field("v"), chunk))
        _add(scores, rows, columns, tile, _numbers(x[c], "number"), _numbers(y[c], "number"))
    return list(x).index(first), list(y).index(first), scores


def _tiles(anchors: _Blocks, rows: _Blocks, chunk: int, same: bool) -> DataFrame:
    """``a, b, p, left, right, tile``: partial scores of anchor block ``a`` and row block ``b``, one row for each panel ``p`` that both have.

    ``left`` and ``right`` are the rows that have this panel, in order of their numbers.
    """
    kind = lambda blocks: blocks.rows.schema["rows"].dataType
    schema = StructType().add("a", "long").add("b", "long").add("p", "long").add("left", kind(anchors)).add("right", kind(rows)).add("tile", "binary")

    def each(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cell = _panel(left, right, chunk)
        i, j, scores = cell or (0, 0, None)
        n = int(cell is not None)
        place = [pa.array([k.as_py()] * n, pa.int64()) for k in key]
        tidy()
        return pa.table([*place, left.column("rows").slice(i, n), right.column("rows").slice(j, n), pa.array([scores.tobytes()] * n if n else [], pa.binary())], names=schema.names)

    return _cells(anchors, rows, same).applyInArrow(each, schema)


def _reduced(anchors: _Blocks, rows: _Blocks, chunk: int, same: bool, schema: str, pick: Callable) -> DataFrame:
    """What ``pick(left, right, scores)`` takes of each cell, all its tiles added: a tuple of arrays in the order of ``schema``.

    Where no vectors have more than a panel's dimensions in common, a cell is done when its panel is; else panels' tiles are shuffled.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    taken = lambda found: pa.table(dict(zip(names, found, strict=True)))

    def done(left: pa.Table, right: pa.Table) -> pa.Table:
        cell = _panel(left, right, chunk)
        if cell is None:
            return taken([np.zeros(0, np.int64)] * len(names))
        i, j, scores = cell
        found = pick(left.column("rows")[i].values, right.column("rows")[j].values, scores)
        tidy()
        return taken(found)

    def added(cell: pa.Table) -> pa.Table:
        head = cell.filter(pc.equal(cell.column("p"), 0))
        left, right = (head.column(side)[0].values for side in ("left", "right"))
        rows, columns = _numbers(left, "number"), _numbers(right, "number")
        scores = np.zeros((len(rows), len(columns)), np.int64)
        for some, others, tile in zip(*(cell.column(c) for c in ("left", "right", "tile")), strict=True):
            some, others = _numbers(some.values, "number"), _numbers(others.values, "number")
            _add(scores, rows, columns, np.frombuffer(tile.as_buffer(), np.int64).reshape(len(some), len(others)), some, others)
        return taken(pick(left, right, scores))

    if min(anchors.chunks, rows.chunks) <= PANEL:
        return _cells(anchors, rows, same).applyInArrow(done, schema)
    return _tiles(anchors, rows, chunk, same).groupBy("a", "b").applyInArrow(added, schema)


def _numbers(side: pa.Array, field: str) -> np.ndarray:
    return side.field(field).to_numpy(zero_copy_only=False)


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` by falling score, ties by rising id."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        close = np.flatnonzero(scores >= least)
        return close[np.lexsort((ids[close], -scores[close]))[:most]]
    return np.lexsort((ids, -scores))


def _positives(most: int) -> Callable:
    def pick(left, right, scores):
        ids, labels, numbers = (_numbers(right, f) for f in ("vec_id", "label", "number"))
        found = []
        for i, (label, number) in enumerate(zip(_numbers(left, "label"), _numbers(left, "number"), strict=True)):
            own = np.flatnonzero((labels == label) & (numbers != number))
            own = own[_best(scores[i, own], ids[own], most)]
            found.append((np.full(len(own), number), ids[own], scores[i, own]))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True))

    return pick


def _negatives(most: int, percent: int) -> Callable:
    def pick(left, right, scores):
        ids, labels = _numbers(right, "vec_id"), _numbers(right, "label")
        found = [(np.zeros(0, np.int64),) * 4]
        for i, (label, number, wanted) in enumerate(zip(_numbers(left, "label"), _numbers(left, "number"), left.field("wanted").to_pylist(), strict=True)):
            if not wanted:
                continue
            other = np.flatnonzero((labels != label) & (100 * scores[i] >= min(percent * p for p in wanted)) & (scores[i] <= max(wanted)))
            if not len(other):
                continue
            s, n = scores[i, other], ids[other]
            for place, p in enumerate(wanted):
                inside = np.flatnonzero((100 * s >= percent * p) & (s <= p))
                inside = inside[_best(s[inside], n[inside], most)]
                found.append((np.full(len(inside), number), np.full(len(inside), place), n[inside], s[inside]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return pick


def _first(found: DataFrame, keys: list[str], score: str, other: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key by falling score, ties by rising ``other``, with their ``rank`` from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), other))
    return found.withColumn("rank", place).filter(F.col("rank") <= most)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LEAST_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows`` of ``vec_id, label, v`` (as ``integers`` gives them).

    ``anchor`` says which rows are anchors.  An anchor's positives are its first other rows of the same label by
    falling score (the inner product), ties by rising ``vec_id``; its negatives for each are the first rows of other labels
    whose score is between ``percent`` hundredths of the positive's and that, so a positive of negative score has none.  Anchors without positives, and
    positives without negatives, give no rows.  A vector that is shorter than another counts as padded with
    zeros.  Rows that share an id but not their content are rows of their own; an empty table gives no rows.
    """
    rows = written(rows.select("vec_id", "label", "v").withColumn("number", F.monotonically_increasing_id()), "vectors")
    anchors = rows.filter(anchor)
    columns = ["number", "vec_id", "label", "v"]
    blocks = _Blocks(rows.select(*columns), ROWS, chunk)
    found = _reduced(_Blocks(anchors.select(*columns), ANCHORS, chunk), blocks, chunk, True, "number bigint, positive_id bigint, positive_score bigint", _positives(positives))
    found = written(_first(found, ["number"], "positive_score", "positive_id", positives), "positives")
    wanted = found.groupBy("number").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))), lambda p: p.positive_score).alias("wanted"))
    asked = written(anchors.join(wanted, "number").select("number", "vec_id", "label", "wanted", "v"), "anchors")
    near = _reduced(_Blocks(asked, ANCHORS, chunk, groups=1), blocks, chunk, False, "number bigint, place bigint, negative_id bigint, negative_score bigint", _negatives(negatives, percent))
    near = _first(near, ["number", "place"], "negative_score", "negative_id", negatives)
    known = found.select("number", (F.col("rank") - 1).cast("bigint").alias("place"), "positive_id", "positive_score").join(asked.select("number", F.col("vec_id").alias("anchor_id")), "number")
    return near.join(known, ["number", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors, where every seventh has the next label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % MOVED_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(integers(vectors.withColumn("label", moved)), F.col("vec_id") % ANCHOR_STEP == 0)


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
