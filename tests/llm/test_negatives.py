"""Hard negatives against plain loops, the tree against its own rows, ties and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import negatives


def _plain(rows, chosen, scale=256, positives=5, count=5):
    """(vec_id, label, vector) rows -> the result as sorted tuples."""
    p = [(i, y, [math.floor(scale * float(np.float32(c))) for c in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, y, v) in enumerate(p):
        if not chosen(i):
            continue
        scores = [(sum(x * z for x, z in zip(v, w, strict=True)), j, lab) for b, (j, lab, w) in enumerate(p) if a != b and len(w) == len(v)]
        near = sorted((-s, j) for s, j, lab in scores if lab == y)[:positives]
        for ps, pid in near:
            kept = sorted((-s, j) for s, j, lab in scores if lab != y and 80 * -ps <= 100 * s <= 100 * -ps)[:count]
            out += [(i, pid, r + 1, j, -ps, -s) for r, (s, j) in enumerate(kept)]
    return sorted(out)


def _found(frame):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert frame.columns == names
    return sorted(tuple(r) for r in frame.collect())


def test_boxes_hold_their_rows_and_bound_every_score():
    r = np.random.default_rng(1)
    vectors, labels, ids = r.integers(-90, 90, (700, 6)), r.integers(0, 4, 700), r.permutation(700)
    tree = negatives.Tree(vectors, labels, ids, leaf=16, fanout=4)
    assert sorted(tree.order.tolist()) == list(range(700)) and len(tree.levels[0][0]) == 1
    anchor = r.integers(-90, 90, 6)
    up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
    size = 16
    for low, high, first, last, least in reversed(tree.levels):
        for k in range(len(low)):
            own = slice(k * size, (k + 1) * size)
            scores = tree.vectors[own] @ anchor
            assert low[k] @ up + high[k] @ down <= scores.min() and scores.max() <= high[k] @ up + low[k] @ down
            assert first[k] == tree.labels[own].min() and last[k] == tree.labels[own].max() and least[k] == tree.ids[own].min()
        size *= 4


@pytest.mark.parametrize("kind", ["spread", "ties", "copies", "one"])
def test_search_equals_sorting(kind):
    r = np.random.default_rng(2)
    n = 1 if kind == "one" else 900
    vectors = r.integers(-2, 3, (n, 4)) if kind == "ties" else r.integers(-200, 200, (n, 8))
    if kind == "copies":
        vectors[: n // 2] = vectors[0]
    labels, ids = r.integers(0, 3, n), r.permutation(n)
    tree = negatives.Tree(vectors, labels, ids, leaf=8, fanout=4)
    for own in range(0, n, 37):
        scores = vectors @ vectors[own]
        lows, highs = np.array([-(10**9), int(0.8 * scores[own]), 0, 5]), np.array([10**9, int(scores[own]), 0, 4])
        for same in (True, False):
            found = tree.search(vectors[own], int(labels[own]), same, own, lows, highs, 5)
            for w, rows in enumerate(found):
                fits = [k for k in range(n) if k != own and (labels[k] == labels[own]) == same and lows[w] <= scores[k] <= highs[w]]
                assert rows == [(int(scores[k]), int(ids[k]), k) for k in sorted(fits, key=lambda k: (-scores[k], ids[k]))[:5]]


def test_few_boxes_are_opened_where_vectors_lie_in_groups(monkeypatch):
    r = np.random.default_rng(3)
    groups = r.integers(-200, 200, (40, 8)).repeat(100, 0)
    tree = negatives.Tree(groups + r.integers(-3, 4, groups.shape), np.zeros(4000, np.int64), np.arange(4000), leaf=32, fanout=8)
    opened = []
    heappop = negatives.heapq.heappop
    monkeypatch.setattr(negatives.heapq, "heappop", lambda q: opened.append(1) or heappop(q))
    tree.search(groups[0], 0, True, -1, np.array([-(10**9)]), np.array([10**9]), 5)
    assert len(opened) < len(tree.levels[-1][0]) / 2


_SCHEMA = "vec_id long, label int, embedding array<float>, shard string, number int, v string"


def _rows(n=400, d=6, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, d))
    return [(i, int(i % 5), [float(c) for c in centres[i % 5] * 0.3 + r.normal(size=d)]) for i in range(n)]


@pytest.mark.parametrize("shard,block", [(16_384, 16_384), (50, 3)])
def test_mining_equals_plain_loops(spark, monkeypatch, shard, block):
    monkeypatch.setattr(negatives, "SHARD", shard)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = _rows()
    frame = spark.createDataFrame([(*x, "s", 1, "v") for x in rows], _SCHEMA)
    assert _found(negatives.mine(frame, F.col("vec_id") % 20 == 0)) == _plain(rows, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    rows = _rows(60, 3)
    rows += [(i, 1, [0.5, 0.5, 0.5]) for i in range(200, 230)] + [(20, 0, [0.1, 0.2, 0.9]), (40, 2, [0.5, 0.5, 0.5])]  # copies, repeated ids
    rows += [(None, 1, [1.0, 0.0, 0.0]), (300, None, [1.0, 0.0, 0.0]), (400, 1, None), (500, 1, [1.0, None, 0.0]), (600, 1, [math.nan, 0.0, 0.0]), (700, 1, [math.inf, 0.0, 0.0]), (800, 1, [1.0]), (900, 2, [1.0]), (1000, 1, []), (60, 4, [2.0])]
    frame = spark.createDataFrame([(*x, None, None, None) for x in rows], _SCHEMA)
    assert _found(negatives.mine(frame, F.col("vec_id") % 20 == 0)) == _plain(rows, lambda i: i % 20 == 0)
    assert negatives.mine(frame, F.lit(None).cast("boolean")).count() == 0
    assert negatives.mine(frame.where("false"), F.lit(True)).count() == 0
    far = spark.createDataFrame([(i, i % 2, [3e38, -3e38, 1.0], None, None, None) for i in range(4)], _SCHEMA)
    # two rows of each label, all with one score: a positive each, and both rows of the other label
    assert negatives.mine(far, F.lit(True)).count() == 4 * 1 * 2
