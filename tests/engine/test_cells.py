"""Vector search by cells against plain loops: ties, odd vectors, owners, more cells than one."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from noticelake.operators import vectors as V


def score(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total if math.isnan(total) else round(total, 6)


def best(queries, points, k, threshold):
    out = set()
    for qid, own, q in queries:
        hits = [(score(v, q), i) for i, owner, v in points if own is None or owner != own]
        if threshold is not None:
            hits = [(s, i) for s, i in hits if s is not None and (math.isnan(s) or s >= threshold)]
        hits.sort(key=lambda h: (h[0] is None, h[0] is None or not math.isnan(h[0]), 0 if h[0] is None or math.isnan(h[0]) else -h[0], h[1]))
        out |= {(qid, i, rank, repr(s)) for rank, (s, i) in enumerate(hits[:k], 1)}
    return out


def table(spark, rows, key, vector):
    return spark.createDataFrame(rows, f"{key} long, owner long, {vector} array<double>")


def test_cells_find_what_loops_find(spark, monkeypatch):
    rng = random.Random(3)
    grid = lambda: [rng.randint(-3, 3) / 4 for _ in range(4)]
    points = [(i, i % 5, grid()) for i in range(300)] + [(300, 1, None), (301, 1, [1.0, None, 0.0, 0.0]), (302, 1, [1.0]), (303, 1, [math.nan, 0.0, 0.0, 0.0]), (304, 2, [9.0, 9.0, 9.0, 9.0]), (305, None, [9.0, 9.0, 9.0, 9.0])]
    queries = [(i, i % 5, grid()) for i in range(40)] + [(40, 0, None), (41, 0, [1.0])]
    for name, value in (("CELL_POINTS", 64), ("CELL_QUERIES", 16), ("LEAST_POINTS", 50), ("AT_ONCE", 5)):
        monkeypatch.setattr(V, name, value)
    p, q = table(spark, points, "vec_id", "embedding"), table(spark, queries, "qid", "qvec")
    for k, threshold in ((7, None), (7, 0.4), (400, None), (1, -9.0)):
        got = {(r.qid, r.vec_id, r["rank"], repr(r.score)) for r in V.top_k(q.drop("owner"), p.drop("owner"), k, threshold).collect()}
        want = best([(i, None, v) for i, _, v in queries], points, k, threshold)
        assert {(a, b, c, d.replace("-0.0", "0.0")) for a, b, c, d in got} == {(a, b, c, d.replace("-0.0", "0.0")) for a, b, c, d in want}

    asked = table(spark, queries, "vec_id", "embedding")
    counted = {r.vec_id: r.duplicates for r in V.duplicates(asked, p, 0.4, 9).collect()}
    owner = {i: o for i, o, _ in points}
    hits = best([(i, o, v) for i, o, v in queries], [x for x in points if x[1] is not None], 9, 0.4)
    assert counted == {i: len({owner[v] for qid, v, _, _ in hits if qid == i}) for i, _, _ in queries}


def test_pairs_are_made_in_cells_only(spark):
    e = spark.range(50).select(F.col("id").alias("vec_id"), (F.col("id") % 5).alias("owner"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    for df in (V.duplicates(e, e, 0.3, 40), V.top_k(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), e, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapCoGroups" in plan


def test_empty_sides(spark):
    e = table(spark, [], "vec_id", "embedding")
    q = table(spark, [(1, 1, [1.0])], "qid", "qvec")
    assert V.top_k(q, e, 3, 0.1).collect() == [] and V.top_k(q.limit(0), e, 3).collect() == []


def test_both_ways_to_cut_a_cell_agree(monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(400, 5)).round(1)  # many equal scores
    vectors[::50] = np.nan
    frame = pd.DataFrame({"v": list(vectors), "owner": np.arange(400) % 7})
    for threshold, apart in ((0.5, True), (0.5, False), (40.0, True)):
        found = []
        for share in (0.0, 1.0):
            monkeypatch.setattr(V, "SPARSE", share)
            found.append([tuple(map(np.ndarray.tolist, x)) for x in V.best_of_cell(frame[:150], frame, 9, threshold, apart)])
        assert repr(found[0]) == repr(found[1]) and found[0]


def test_scores_are_rounded_half_up_by_their_decimal_form():
    plain = lambda x: float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=2000), rng.integers(-3_000_000, 3_000_000, 2000) / 2e6, rng.integers(-9, 9, 50) / 1e7, rng.normal(size=50) * 1e9, [0.0, -0.0, 5e-7, 1e18]])
    assert V.rounded(x).tolist() == [plain(v) for v in x]
    assert np.isnan(V.rounded(np.array([np.nan]))[0]) and V.rounded(np.array([np.inf, -np.inf])).tolist() == [np.inf, -np.inf] and len(V.rounded(np.zeros(0))) == 0
