"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels within a
window below that row's score.

Rows are (vec_id, label, v), v whole numbers; a score is the inner product of two v, vectors of different lengths being filled
up with zeros; higher scores come first, ties by smaller vec_id. Anchors and all rows are dealt into blocks by a hash of
vec_id, each pair of blocks is a cell of bounded size, and in a cell tiles of anchors and candidates are multiplied by
Strassen's recursion in 64-bit integers, odd sides being filled up with zeros. Integer additions are exact, and even where
they wrap around within the recursion, a score that fits in 64 bits comes out right; vectors for which one might not fit are an error.

Each tile adds to the anchors' heaps: first those of the positives (only rows of one label are multiplied for these), then,
when the positives of all cells are known, those of the windows. Heaps of tiles merge into those of a cell, and Spark merges
those of the cells: it limits every group to the heap's size before the shuffle and after it.

Rows with a null vec_id, label or vector, or a vector with a null or non-finite component, take no part. Of several rows with one
vec_id the one with the least label, then the least vector, counts. No rows give no rows, and neither do anchors without
another row of their label. Empty vectors score 0. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch

#: Rows of a cell's sides and of a tile; below LEAF rows or columns, products are made without recursion.
ANCHORS, CANDIDATES, TILE, LEAF = 2048, 4096, 512, 32
POSITIVES, NEGATIVES = 5, 3
#: Scores of negatives, in percent of the positive's.
LOW, HIGH = 50, 95
#: Components are multiplied by this and rounded down.
SCALE = 256
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of 64-bit integers, modulo 2^64."""
    (m, k), n = a.shape, len(b)
    if min(m, k, n) <= LEAF:
        return a @ b.T
    if (m | k | n) & 1:
        return strassen(np.pad(a, ((0, m & 1), (0, k & 1))), np.pad(b, ((0, n & 1), (0, k & 1))))[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b21, b12, b22 = b[:n, :k], b[:n, k:], b[n:, :k], b[n:, k:]  # b is transposed
    p1, p2, p3, p4 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    p5, p6, p7 = strassen(a11 + a12, b22), strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out


class Heaps:
    """For each of n keys the `size` first of (score, id): higher scores first, ties by smaller id."""

    def __init__(self, n: int, size: int):
        self.scores, self.ids = np.full((n, size), _NONE), np.zeros((n, size), np.int64)

    def add(self, keys: slice | np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Those of a tile: a row of scores for each key, ids in increasing order; scores of _NONE don't count. Changes scores."""
        rows, size = np.arange(len(scores)), min(self.scores.shape[1], scores.shape[1])
        best, own = np.empty((len(scores), size), np.int64), np.empty((len(scores), size), np.int64)
        for i in range(size):
            at = scores.argmax(1)  # the first of equal ones, hence the smallest id
            best[:, i], own[:, i] = scores[rows, at], ids[at]
            scores[rows, at] = _NONE
        self.merge(keys, best, own)

    def merge(self, keys: slice | np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[keys], scores], 1), np.concatenate([self.ids[keys], ids], 1)
        order = np.lexsort((ids, ~scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[keys], self.ids[keys] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, id and score of all that there are."""
        key, at = np.nonzero(self.scores != _NONE)
        return key, self.ids[key, at], self.scores[key, at]


def _matrix(t: pa.Table, width: int) -> np.ndarray:
    """Vectors filled up with zeros."""
    v = t.column("v").combine_chunks()
    size, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(v), width), np.int64)
    out[np.repeat(np.arange(len(v)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _sides(a: pa.Table, b: pa.Table, *order: str) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """Both sides sorted, with their matrices."""
    a, b = (t.sort_by([(c, "ascending") for c in order]) for t in (a, b))
    width = max((int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (a, b)), default=0)
    x, y = _matrix(a, width), _matrix(b, width)
    most = [max(abs(int(m.min(initial=0))), int(m.max(initial=0))) for m in (x, y)]
    if 4 * width * most[0] * most[1] >= 1 << 63:
        raise OverflowError("scores of these vectors may not fit in 64 bits")
    return a, b, x, y


def _tiles(n: int):
    return (slice(at, min(n, at + TILE)) for at in range(0, n, TILE))


def _positives(size: int):
    def cell(key, a: pa.Table, b: pa.Table) -> pa.Table:
        a, b, x, y = _sides(a, b, "label", "vec_id")
        (ids, own), (other, theirs) = ((t.column("vec_id").to_numpy(), t.column("label").to_numpy()) for t in (a, b))
        heaps = Heaps(len(ids), size)
        for label in np.intersect1d(own, theirs):
            (lo, hi), (first, last) = (np.searchsorted(s, [label, label + 1]) if label < np.iinfo(np.int64).max else (np.searchsorted(s, label), len(s)) for s in (own, theirs))
            for i in _tiles(hi - lo):
                for j in _tiles(last - first):
                    rows, columns = slice(lo + i.start, lo + i.stop), slice(first + j.start, first + j.stop)
                    scores = strassen(x[rows], y[columns])
                    scores[ids[rows, None] == other[None, columns]] = _NONE
                    heaps.add(rows, scores, other[columns])
        k, i, s = heaps.rows()
        return pa.table({"anchor_id": ids[k], "positive_id": i, "positive_score": s})

    return cell


def share(score: np.ndarray, percent: int, up: bool = False) -> np.ndarray:
    """That share of a score, rounded down or up, without overflow."""
    q, r = score // 100, score % 100
    return q * percent - (-r * percent // 100) if up else q * percent + r * percent // 100


def _negatives(size: int, low: int, high: int):
    def cell(key, a: pa.Table, b: pa.Table) -> pa.Table:
        a, b, x, y = _sides(a, b, "vec_id")
        (ids, own), (other, theirs) = ((t.column("vec_id").to_numpy(), t.column("label").to_numpy()) for t in (a, b))
        goals = a.column("goals").to_pylist()
        slots = max(map(len, goals), default=0)
        goal = np.array([g + [_NONE] * (slots - len(g)) for g in goals], np.int64).reshape(len(goals), slots)
        least, most = np.where(goal == _NONE, 0, share(goal, low, up=True)), np.where(goal == _NONE, -1, share(goal, high))
        heaps = Heaps(len(ids) * slots, size)
        for i in _tiles(len(ids)):
            for j in _tiles(len(other)):
                scores = strassen(x[i], y[j])
                scores[own[i, None] == theirs[None, j]] = _NONE
                for slot in range(slots):
                    within = (scores >= least[i, slot, None]) & (scores <= most[i, slot, None]) & (scores != _NONE)
                    if within.any():
                        heaps.add(np.arange(i.start, i.stop) * slots + slot, np.where(within, scores, _NONE), other[j])
        k, n, s = heaps.rows()
        return pa.table({"anchor_id": ids[k // max(1, slots)], "positive_score": goal.ravel()[k], "negative_id": n, "negative_score": s})

    return cell


def prepared(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, v of the rows that take part: components times SCALE, rounded down."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return own.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE)))).alias("v"))


def _first(df: DataFrame, size: int, by: list[str], score: str, ident: str) -> DataFrame:
    """The heaps of all cells merged, with the rank of each row."""
    own = Window.partitionBy(*by).orderBy(F.col(score).desc(), ident)
    return df.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= size)


def mined(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows as from `prepared`, anchors those for which `anchor` holds."""
    scratch = Scratch(rows.sparkSession)
    rows = scratch.put(rows.select("vec_id", "label", "v"), "rows")
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = scratch.put(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"), "single")
    anchors = rows.where(anchor).toDF("vec_id", "label", "v")  # columns of its own, as both sides come from one table
    across, down = max(1, math.ceil(rows.count() / CANDIDATES)), max(1, math.ceil(anchors.count() / ANCHORS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("j", F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int")).withColumn("i", each(down)).groupBy("i", "j")
    dealt = lambda a: a.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int")).withColumn("j", each(across)).groupBy("i", "j")
    near = dealt(anchors).cogroup(candidates).applyInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    near = scratch.put(_first(near, positives, ["anchor_id"], "positive_score", "positive_id").drop("rank"), "positives")
    goals = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("goals"))
    windows = dealt(anchors.join(goals, "vec_id")).cogroup(candidates).applyInArrow(_negatives(negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long")
    hard = _first(windows, negatives, ["anchor_id", "positive_score"], "negative_score", "negative_id")
    return near.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(embeddings: DataFrame) -> DataFrame:
    """The columns of op13: anchors are rows whose vec_id is divisible by 50; labels of those divisible by 7 move on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(prepared(embeddings).withColumn("label", label), F.col("vec_id") % 50 == 0)


#: For tables without repeated vec_ids.
SQL = """
WITH own AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
    FROM own a JOIN own b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 3
"""
