"""Hard-negative mining by inner products over STR-packed R-trees.

Vectors of whole numbers are range-partitioned by (label, widest coordinate, id) into shards of a bounded number
of rows, a table that is written once.  A task takes one shard and one block of anchors and packs the
shard into an R-tree by sort-tile-recursive slicing: by label first, then by the coordinates in falling
order of their spread.  A box holds the least and greatest value of every coordinate, of the label and the
smallest id below it.  For an anchor a, coordinate i of a box adds between a_i * low_i and a_i * high_i
to the inner product, whichever is less first, so the sums bound the score of every row below.

Search is best first, by the upper bound.  A box is left out if its label interval holds none that is asked
for, if its bounds lie outside the window of scores, or if k rows are known and its upper bound is
strictly below the kth of them, or equal to it with no smaller id.  Boxes and rows are scored for a whole
node at once, and all windows of an anchor share one queue.

Two rounds: the k nearest rows of the anchor's label, from which the windows follow, then for each window the
k best rows of other labels.  Every shard gives its own k best; a window function keeps the k best of all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Rows of a leaf, children of a node above.
LEAF, FANOUT = 64, 16
#: Rows of a shard and anchors of a block at most; rows of a shard below which more tasks don't pay.
SHARD, BLOCK, LEAST = 16_384, 16_384, 1_024
#: Positives of an anchor, negatives of a positive, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOWER, UPPER = 5, 5, 80, 100
#: Entries are held to this size, so that inner products of 64-bit whole numbers are exact.
SCALE, BOUND = 256, float(1 << 16)
_NEVER = np.iinfo(np.int64).max


class Tree:
    """R-tree over rows of whole numbers with labels and ids; levels from the root down, leaves last."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        order = self._packed(vectors, labels, ids, leaf)
        self.vectors, self.labels, self.ids, self.order = vectors[order], labels[order], ids[order], order
        self.leaf, self.fanout = leaf, fanout
        cuts = np.arange(0, len(order), leaf)
        boxes = (
            np.minimum.reduceat(self.vectors, cuts), np.maximum.reduceat(self.vectors, cuts), np.minimum.reduceat(self.labels, cuts),
            np.maximum.reduceat(self.labels, cuts), np.minimum.reduceat(self.ids, cuts),
        )
        self.levels = [boxes]
        while len(boxes[0]) > 1:
            cuts = np.arange(0, len(boxes[0]), fanout)
            ends = (np.minimum, np.maximum, np.minimum, np.maximum, np.minimum)
            boxes = tuple(f.reduceat(x, cuts) for f, x in zip(ends, boxes, strict=True))
            self.levels.insert(0, boxes)

    @staticmethod
    def _packed(vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int) -> np.ndarray:
        """Order of the rows: slabs along one axis after another, each of whole leaves; ids break ties."""
        spread = np.argsort(-vectors.astype(np.float64).std(0), kind="stable")
        axes = [labels, *(vectors[:, i] for i in spread)]
        out: list[np.ndarray] = []
        waiting = [(np.lexsort((ids, labels)), 0)]
        while waiting:
            rows, depth = waiting.pop()
            leaves = -(-len(rows) // leaf)
            if leaves <= 1 or depth == len(axes):
                out.append(rows[np.lexsort((ids[rows], labels[rows]))] if leaves <= 1 else rows)
                continue
            rows = rows[np.lexsort((ids[rows], axes[depth][rows]))]
            slabs = int(np.ceil(leaves ** (1 / (len(axes) - depth))))
            size = -(-leaves // slabs) * leaf
            waiting += [(rows[k : k + size], depth + 1) for k in range(0, len(rows), size)][::-1]
        return np.concatenate(out)

    def search(self, anchor: np.ndarray, label: int, same: bool, own: int, lows: np.ndarray, highs: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
        """For each window lows[w]..highs[w] the k best rows (score, id, row) whose label is ``label``, or is not.

        The row numbered ``own`` is passed over.  Best: greater score, then smaller id, then smaller row.
        """
        found: list[list[tuple[int, int, int]]] = [[] for _ in lows]  # heaps, the worst first
        up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
        # what a box has to reach: the kth score, and for the same score an id below
        kth, kth_id = lows.copy(), np.full(len(lows), _NEVER)

        def wanted(best: np.ndarray, worst: np.ndarray, least: np.ndarray) -> np.ndarray:
            """Which of the boxes some window still wants."""
            top = np.minimum(best[:, None], highs)
            return ((worst[:, None] <= highs) & ((top > kth) | ((top == kth) & (least[:, None] < kth_id)))).any(1)

        def bounds(level: int, rows: slice) -> tuple[np.ndarray, ...]:
            low, high, first, last, least = (x[rows] for x in self.levels[level])
            has = (first <= label) & (label <= last) if same else (first != label) | (last != label)
            return high @ up + low @ down, low @ up + high @ down, least, has

        best, worst, least, has = bounds(0, slice(0, 1))
        queue = [(-int(best[0]), int(least[0]), 0, 0, int(worst[0]))] if has[0] else []
        while queue:
            best, least, level, at, worst = heapq.heappop(queue)
            if not wanted(np.array([-best]), np.array([worst]), np.array([least]))[0]:
                continue
            if level + 1 < len(self.levels):
                first = at * self.fanout
                best, worst, least, has = bounds(level + 1, slice(first, first + self.fanout))
                for i in np.flatnonzero(has & wanted(best, worst, least)).tolist():
                    heapq.heappush(queue, (-int(best[i]), int(least[i]), level + 1, first + i, int(worst[i])))
                continue
            first = at * self.leaf
            rows = slice(first, first + self.leaf)
            scores, ids = self.vectors[rows] @ anchor, self.ids[rows]
            fits = ((self.labels[rows] == label) == same) & (self.order[rows] != own)
            inside = fits[:, None] & (scores[:, None] <= highs) & ((scores[:, None] > kth) | ((scores[:, None] == kth) & (ids[:, None] < kth_id)))
            for i, w in zip(*(x.tolist() for x in np.nonzero(inside)), strict=True):
                entry = (int(scores[i]), -int(ids[i]), -int(self.order[first + i]))
                heap = found[w]
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == k:
                    kth[w], kth_id[w] = heap[0][0], -heap[0][1]
        return [[(s, -i, -r) for s, i, r in sorted(heap, reverse=True)] for heap in found]


def usable(embeddings: DataFrame, chosen: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label (long), v (array<long>), anchor of rows with an id, a label and a vector whose entries are all finite.

    Entries beyond BOUND count as that.
    """
    e = F.col("embedding")
    bad = lambda c: c.isNull() | F.isnan(c) | F.abs(c).isin(float("inf"))
    held = lambda c: F.greatest(F.least(c.cast("double"), F.lit(BOUND)), F.lit(-BOUND))
    fit = e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(F.exists(e, bad), F.lit(True))
    return embeddings.where(fit).select("vec_id", F.col("label").cast("long").alias("label"), F.transform(e, lambda c: F.floor(held(c) * scale)).alias("v"), F.coalesce(chosen, F.lit(False)).alias("anchor"))


def shards(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with shard and number (of the row, unique), stored; and the number of shards."""
    spark = rows.sparkSession
    rows = stored(rows, "vectors")
    n, length = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = max(1, -(-n // SHARD), min(tasks, n // LEAST))
    variance = rows.where(F.size("v") > 0).select(*(F.variance(F.get("v", i)) for i in range(length or 0))).first() if n and length else []
    widest = max(range(len(variance)), key=lambda i: variance[i] or 0.0) if len(variance) else 0
    dealt = rows.repartitionByRange(parts, "label", F.get("v", widest), "vec_id", F.xxhash64("v"))
    numbered = dealt.select("*", F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("number"))
    found = stored(numbered, "vector-shards")
    return found, 1 + (found.agg(F.max("shard")).first()[0] or 0)


_FOUND = "anchor long, part int, score long, vec_id long, number long"
_SCHEMA = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("number", pa.int64())])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.int64, copy=False)


def _searched(same: bool, k: int):
    """The k best rows of one shard for each window of each anchor of one block."""

    def search(points: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if points.num_rows and anchors.num_rows:
            # vectors of another length than the anchor have no inner product with it
            lengths = np.array([len(x) for x in points["v"].to_pylist()]) if not _even(points["v"]) else None
            groups = [(None, points)] if lengths is None else [(int(d), points.filter(pa.array(lengths == d))) for d in np.unique(lengths)]
            for _, own in groups:
                out += _best(own, anchors, same, k)
        columns = list(zip(*out, strict=True)) or [[]] * len(_SCHEMA)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return search


def _even(column: pa.ChunkedArray) -> bool:
    lengths = pc.list_value_length(column)
    return pc.min(lengths).as_py() == pc.max(lengths).as_py()


def _best(points: pa.Table, anchors: pa.Table, same: bool, k: int) -> Iterator[tuple]:
    vectors, numbers = _matrix(points["v"]), points["number"].to_numpy()
    by = np.argsort(numbers)  # rows in order of their numbers, so that ties are settled alike in every run
    vectors, numbers = vectors[by], numbers[by]
    labels, ids = points["label"].to_numpy()[by], points["vec_id"].to_numpy()[by]
    tree = Tree(vectors, labels, ids)
    place = {int(x): i for i, x in enumerate(numbers)}
    for number, label, v, lows, highs in zip(*(anchors[x].to_pylist() for x in ("number", "label", "v", "lows", "highs")), strict=True):
        if len(v) == vectors.shape[1]:
            found = tree.search(np.array(v, np.int64), label, same, place.get(number, -1), np.array(lows, np.int64), np.array(highs, np.int64), k)
            for w, rows in enumerate(found):
                for score, vec_id, row in rows:
                    yield number, w, score, vec_id, int(numbers[row])


def nearest(points: DataFrame, parts: int, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best rows of all shards for each window of ``anchors`` (number, label, v, lows, highs).

    anchor (its number), part (place of the window), rank, score, vec_id, number.  Anchors are dealt to blocks of a
    bounded size; every shard meets every block once, by an equi join on the two.
    """
    blocks = max(1, -(-anchors.count() // BLOCK))
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))
    if same:  # only shards that have the label
        dealt = dealt.join(points.select("shard", "label").distinct(), "label")
    else:
        dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.select(*(F.col(c).alias(c) for c in dealt.columns))  # both sides may come from one table
    sent = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = sent.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(_searched(same, k), _FOUND)
    order = Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "vec_id", "number")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, chosen: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """Hard negatives for the rows of ``embeddings`` (vec_id, label, embedding) that ``chosen`` names as anchors.

    One row per anchor, positive and negative: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score.  Positives are the ``positives`` best other rows of the anchor's label, negatives of a positive the
    ``negatives`` best rows of other labels with lower/100 of its score <= score <= upper/100 of its score;
    fewer where there are fewer.  Greater scores come first, then smaller ids.

    Rows with a null id, label or vector, or with a null or non-finite entry, take no part.  Vectors of
    different lengths have no score.  Rows that repeat an id are rows of their own: each is an anchor, and a positive
    or negative, for itself.  Empty table, or no anchor: no rows.  Other columns are not read.
    """
    points, parts = shards(usable(embeddings, chosen))
    no_bound = lambda x: F.array(F.lit(x).cast("long"))
    anchors = points.where("anchor").select("number", "vec_id", "label", "v")
    points = points.drop("anchor")
    first = anchors.select("number", "label", "v", no_bound(-_NEVER).alias("lows"), no_bound(_NEVER).alias("highs"))
    near = nearest(points, parts, first, True, positives)
    near = stored(near.select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 * score is compared, so the least whole score is lower * p / 100 rounded up, the greatest rounded down
    low = F.ceil(F.col("positive_score") * F.lit(lower).cast("decimal(10,0)") / 100).cast("long")
    high = F.floor(F.col("positive_score") * F.lit(upper).cast("decimal(10,0)") / 100).cast("long")
    windows = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))  # positives at most
    second = anchors.join(windows, F.col("number") == F.col("anchor")).select("number", "label", "v", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = nearest(points, parts, second, False, negatives).select("anchor", (F.col("part") + 1).alias("at"), F.col("rank").alias("nth"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("number", F.col("vec_id").alias("anchor_id"))
    joined = found.join(near, (found["anchor"] == near["anchor"]) & (found["at"] == near["rank"])).join(named, found["anchor"] == F.col("number"))
    return joined.select("anchor_id", "positive_id", F.col("nth").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 move by one; ids divisible by 100 are the anchors."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {
    "op13_hard_negatives": """
WITH p AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains([coalesce(isfinite(x), false) FOR x IN embedding], false)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM p a, p b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), q AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT q.anchor_id, q.positive_id, CAST(row_number() OVER (PARTITION BY q.anchor_id, q.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, q.positive_score, s.score AS negative_score
FROM q JOIN s ON s.anchor_id = q.anchor_id AND NOT s.same AND 80 * q.positive_score <= 100 * s.score AND 100 * s.score <= 100 * q.positive_score
QUALIFY row_number() OVER (PARTITION BY q.anchor_id, q.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
}
