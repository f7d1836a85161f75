import hashlib
import re
from collections import defaultdict

from noticelake.llm import exact


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    return sorted(
        (i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm
    )


def found(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_whole_table(spark, sf, documents):
    assert found(exact.op6_exact_dedup(spark, sf)) == brute(documents)


def test_odd_rows_and_overfull_buckets(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for capacity, depth in ((64, 16), (1, 2), (1, 0)):
        assert found(exact.dedup(odd, capacity, depth)) == brute(rows)
    assert found(exact.dedup(none)) == []


def test_directory_covers_every_slot_once():
    loads = {0: 500, 1: 3, 200: 40, 201: 1, 255: 9}
    slots = exact.directory(loads, 8, 10)
    depth = (len(slots) - 1).bit_length()
    assert [s for s, _, _ in slots] == list(range(1 << depth))
    assert depth == 8
    by_bucket = defaultdict(set)
    for s, b, local in slots:
        by_bucket[b].add((s >> (depth - local), local))
    assert all(len(v) == 1 for v in by_bucket.values())
    assert exact.directory({}, 8, 10) == [(0, 0, 0)]


def test_colliding_keys_are_told_apart():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays(
        [
            pa.array([0, 0, 0], pa.int32()),
            pa.array([7, 7, 7], pa.int64()),
            pa.array([b"a", b"b", b"a"], pa.binary()),
            pa.array([5, 2, 3], pa.int64()),
            pa.array([1, 1, 2], pa.int64()),
        ],
        names=["bucket", "h", "norm", "keep_id", "copies"],
    )
    out = [r for b in exact._own(iter([rows])) for r in b.to_pylist()]
    assert {(r["text_sha256"][:4], r["keep_id"], r["group_size"]) for r in out} == {
        (hashlib.sha256(b"a").hexdigest()[:4], 3, 3),
        (hashlib.sha256(b"b").hexdigest()[:4], 2, 1),
    }
