import re

import xxhash
from pyspark.sql import functions as F

from noticelake.llm import simhash
from noticelake.llm.components import components


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [(i, fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(fps):
        for j, b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, f"{f:016x}", root(i)) for i, f in fps)


def found(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_whole_table(spark, sf, documents):
    assert found(simhash.op3_simhash(spark, sf)) == brute(documents)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(simhash.near_duplicates(odd)) == brute(rows)
    assert found(simhash.near_duplicates(none)) == []


def test_all_pairs_within_two_bits(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))) for b in base for _ in range(5)}
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in [*base, *near, 0, (1 << 64) - 1, 1 << 63]})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r.fp, r.other) for r in simhash.links(df).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(df.limit(0)).collect() == []


def test_no_table_that_grows_is_broadcast(spark):
    # as many rows as may stand in files that Spark takes for small
    fps = spark.range(150_000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(300)], "doc_id long, text string")
    assert "Broadcast" not in simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
