"""Hard negatives for anchors, found through a table of distances to pivots.

Components become whole numbers (floor of `scale` times each), scores are inner products of these. One more coordinate gives all rows the
same length R, so that a larger inner product is a smaller Euclidean distance: d^2 = |a|^2 + R^2 - 2 score for an anchor a (whose own
further coordinate is 0). Every row's distances to a few pivots are stored beside it: the pivot table. By the triangle
inequality a pivot p brackets each distance between |d(a,p) - d(y,p)| and d(a,p) + d(y,p), and so each score; what the
brackets do not exclude is checked exactly.

The table is read once or twice for a block of anchors, which is bounded in bytes and broadcast: first for the best rows of an anchor's own
label (its positives), then for the best rows of other labels within each positive's window of scores. A task streams its rows in batches that
lie close to one pivot, so that whole batches can be excluded by the range of their distances, then rows by their own brackets; it
keeps the best of each anchor and window so far, whose last score is what later rows have to reach. So nothing is
grouped by label or vector, and a label or vector that a third of all rows share costs no more than others do. A task returns
at most `positives` rows an anchor in the first pass and `negatives` a window in the second, and there are as many tasks as rows by the million, or the cluster's own parallelism.

Edge cases: rows with a null id, label or vector, or with null, NaN or infinite components, take no part; a zero or empty vector
does, with score 0 to any row; a vector shorter than another counts as continued with zeros; of rows that share an id the least
by label, then vector, counts, so repeated rows count once; ties go to the smaller id; fewer positives or negatives than
asked for give all there are, and an anchor without positives, or a positive without negatives, no rows; an empty table gives no rows; other columns are ignored, whatever their names.
Scores are exact up to 2^53; beyond, they have the precision of a double.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viatica.llm.base import cut, fresh_dir, slices_of, table, task

PIVOTED = "vec_id long, label long, q array<double>, near int, d array<double>"


def padded(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, continued with zeros."""
    sizes = np.asarray(pa.compute.list_value_length(lists))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def narrow(x: np.ndarray, width: int) -> np.ndarray:
    return x[:, :width]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b."""
    w = min(a.shape[1], b.shape[1])
    return narrow(a, w) @ narrow(b, w).T


def whole_vectors(rows: DataFrame, scale: float = 256.0, label: Column | None = None) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, one of each id."""
    v = F.col("embedding").cast("array<double>")
    own = F.col("label").cast("long") if label is None else label
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), own.alias("label"), v.alias("v")).filter("vec_id is not null and label is not null and v is not null")
    good = good.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))))
    one = good.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            q = pa.ListArray.from_arrays(v.offsets, pa.array(np.floor(v.values.to_numpy() * scale)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), q], names=["vec_id", "label", "q"])

    return one.mapInArrow(task(floored), "vec_id long, label long, q array<double>")


class Pivots:
    """Points of the augmented space, among the rows themselves, far from one another."""

    def __init__(self, sample: list[list[float]], length2: float, most: int = 8):
        x = padded(pa.array(sample, pa.list_(pa.float64())))
        self.length2 = length2
        self.x = np.concatenate([x, np.sqrt(np.maximum(length2 - (x * x).sum(1), 0))[:, None]], 1)
        chosen = [0]
        near = self._apart(self.x[0])
        while len(chosen) < min(most, len(x)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, self._apart(self.x[chosen[-1]]))
        self.x = self.x[chosen]

    def _apart(self, p: np.ndarray) -> np.ndarray:
        return ((self.x - p) ** 2).sum(1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        more = np.sqrt(np.maximum(self.length2 - (x * x).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.length2 - 2 * (product(x, self.x[:, :-1]) + more[:, None] * self.x[:, -1]), 0))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + self.length2 - 2 * product(x, self.x[:, :-1]), 0))


def pivot_table(vectors: DataFrame, pivots: int = 8, sample: int = 1024, rows_a_task: int = 1_000_000) -> tuple[DataFrame, Pivots] | None:
    """The rows with their distances to the pivots, those near the same pivot beside one another; None without rows. Pivots are chosen in a bounded sample."""
    spark = vectors.sparkSession
    vectors = cut(vectors)
    n, length2, width = vectors.agg(F.count("*"), F.max(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.size("q"))).first()
    if not n:
        return None
    seen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(sample, (1 << 22) // max(1, width)))).select("q").collect()
    made = Pivots([r[0] for r in seen], length2, pivots)
    shared = spark.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices_of(batches, "q"):
            d = shared.value.of_rows(padded(b.column("q")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1).astype(np.int32)), lists], names=["vec_id", "label", "q", "near", "d"])

    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n / rows_a_task))
    return cut(vectors.mapInArrow(task(run), PIVOTED).repartition(tasks).sortWithinPartitions("near", F.element_at("d", F.col("near") + 1), "vec_id")), made


class Best:
    """The k best rows of each group so far: higher scores first, then smaller ids."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, -np.inf)
        self.rows = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if not len(group):
            return
        g, s, v = (np.concatenate(x) for x in zip(self.rows, (group, score, vec_id), strict=True))
        order = np.lexsort((v, -s, g))
        g, s, v = g[order], s[order], v[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        keep = rank < self.k
        self.rows = g[keep], s[keep], v[keep]
        last = rank == self.k - 1
        self.floor[g[last]] = s[last]


def leading(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what can be among the k highest of each row (-inf: none), ties at the end included."""
    if k < scores.shape[1]:
        least = -np.partition(-scores, k - 1, 1)[:, k - 1 : k]
        return np.nonzero((scores >= least) & (scores > -np.inf))
    return np.nonzero(scores > -np.inf)


class Block:
    """A block of anchors against the pivot table."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, pivots: Pivots):
        self.ids, self.labels, self.x = ids, labels, x
        self.d, self.square, self.length2 = pivots.of_anchors(x), (x * x).sum(1), pivots.length2
        self.slack = 1e-9 * (1 + self.square.max(initial=0) + self.length2)

    def bracket(self, low: np.ndarray, high: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score of anchors `a` with anything whose distances to the pivots lie between low and high (pivots last), by the triangle inequality."""
        own = self.d[a].reshape(len(a), *[1] * (low.ndim - 1), -1)
        near, far = np.zeros(()), np.full((), np.inf)
        for p in range(self.d.shape[1]):
            near = np.maximum(near, np.maximum(own[..., p] - high[..., p], low[..., p] - own[..., p]))
            far = np.minimum(far, own[..., p] + high[..., p])
        reach = (self.square[a] + self.length2).reshape(len(a), *[1] * (low.ndim - 1))
        return (reach - far * far) / 2 - self.slack, (reach - near * near) / 2 + self.slack

    def survivors(self, b: pa.RecordBatch, low: np.ndarray, high: np.ndarray, same: bool, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(anchors, their exact scores with the rows of a batch) wherever brackets reach between low and high; -inf elsewhere, where labels do not (or do) agree, and for an anchor itself."""
        d, y, ids, labels = padded(b.column("d")), padded(b.column("q")), b.column("vec_id").to_numpy(), b.column("label").to_numpy()
        least, most = self.bracket(d.min(0), d.max(0), np.arange(len(self.ids)))
        live = np.flatnonzero((most >= low) & (least <= high))
        for at in range(0, len(live), at_once):
            a = live[at : at + at_once]
            least, most = self.bracket(d, d, a)
            open_ = (most >= low[a, None]) & (least <= high[a, None]) & ((labels == self.labels[a, None]) == same) & (ids != self.ids[a, None])
            scores = np.full(open_.shape, -np.inf)
            rows, columns = np.nonzero(open_)
            if len(rows) > open_.size // 16:
                scores[rows, columns] = product(self.x[a], y)[rows, columns]
            else:
                w = min(self.x.shape[1], y.shape[1])
                scores[rows, columns] = np.einsum("nd,nd->n", narrow(self.x[a[rows]], w), narrow(y[columns], w))
            yield a, scores


def positives_of(pivoted: DataFrame, block: Block, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the k best rows of each anchor's label."""
    shared = pivoted.sparkSession.sparkContext.broadcast(block)  # bounded: see mine()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = Best(len(block.ids), k)
        for b in slices_of(batches, "q"):
            ids = b.column("vec_id").to_numpy()
            for a, scores in block.survivors(b, best.floor, np.full(len(block.ids), np.inf), same=True):
                r, c = leading(scores, k)
                best.add(a[r], scores[r, c], ids[c])
        g, s, v = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[g]), pa.array(v), pa.array(s.astype(np.int64))], names=["anchor_id", "positive_id", "positive_score"])

    found = pivoted.select("vec_id", "label", "q", "d").mapInArrow(task(run), "anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("place", rank).filter(F.col("place") <= k)


def negatives_of(pivoted: DataFrame, block: Block, scores: np.ndarray, windows: tuple[int, int], k: int) -> DataFrame:
    """(anchor_id, positive_score, negative_id, negative_score, rank): for every score of a positive (a row of `scores` an anchor, nan: none) the k best rows of other labels in its window."""
    low, high = np.ceil(windows[0] * scores / 100), np.floor(windows[1] * scores / 100)
    shared = pivoted.sparkSession.sparkContext.broadcast((block, scores, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, scores, low, high = shared.value
        n = scores.shape[1]
        best = Best(len(block.ids) * n, k)
        top = np.where(np.isnan(high), -np.inf, high).max(1, initial=-np.inf)
        for b in slices_of(batches, "q"):
            ids = b.column("vec_id").to_numpy()
            need = np.where(np.isnan(low), np.inf, np.maximum(low, best.floor.reshape(-1, n)))
            for a, found in block.survivors(b, need.min(1, initial=np.inf), top, same=False):
                for j in range(n):
                    inside = np.where((found >= need[a, j, None]) & (found <= high[a, j, None]), found, -np.inf)
                    r, c = leading(inside, k)
                    best.add(a[r] * n + j, inside[r, c], ids[c])
        g, s, v = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[g // n]), pa.array(scores.ravel()[g].astype(np.int64)), pa.array(v), pa.array(s.astype(np.int64))], names=["anchor_id", "positive_score", "negative_id", "negative_score"])

    found = pivoted.select("vec_id", "label", "q", "d").mapInArrow(task(run), "anchor_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, windows: tuple[int, int] = (30, 90), block_numbers: int = 1 << 21) -> DataFrame:
    """Hard negatives for the anchors among whole_vectors(): a negative's score lies between windows[0] and windows[1] percent of its positive's. A block of anchors has about `block_numbers` components."""
    spark = vectors.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    made = pivot_table(vectors)
    if made is None:
        return spark.createDataFrame([], kind)
    pivoted, pivots = made
    asked = cut(pivoted.filter(anchors).select("vec_id", "label", "q"))
    there, numbers = asked.agg(F.count("*"), F.sum(F.size("q"))).first()
    blocks = max(1, math.ceil((numbers or 0) / block_numbers), math.ceil(there / 65_536))
    path = fresh_dir(spark, "negatives")
    for n in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(blocks)) == n).orderBy("vec_id").toArrow()
        if not own.num_rows:
            continue
        block = Block(own.column("vec_id").to_numpy(), own.column("label").to_numpy(), padded(own.column("q").combine_chunks()), pivots)
        found = cut(positives_of(pivoted, block, positives))
        scores = np.full((len(block.ids), positives), np.nan)
        held = found.toArrow()  # at most `positives` rows an anchor of the block
        row = np.searchsorted(block.ids, held.column("anchor_id").to_numpy())
        scores[row, held.column("place").to_numpy() - 1] = held.column("positive_score").to_numpy()
        scores[:, 1:][scores[:, 1:] == scores[:, :-1]] = np.nan  # the same window
        hard = negatives_of(pivoted, block, scores, windows, negatives)
        found.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{path}/block={n}")
    return spark.read.schema(kind).parquet(f"{path}/block=*") if there else spark.createDataFrame([], kind)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    vectors = whole_vectors(rows, label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(vectors, F.col("vec_id") % 100 == 0)


SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), one AS (
  SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, q) = 1
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM one a JOIN one b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
