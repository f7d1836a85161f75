"""Keyed tables, audited runs, kept neighbours, ledgers with a clock, budgets: each against what it has to be."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from noticelake.plans import neighbours as N
from noticelake.streaming import buckets as B
from noticelake.streaming import flushes, ledgers, runs
from noticelake.streaming import incremental as I

KIND = "k long, v string, h string, at int"


def files(path):
    return {f for f in glob.glob(f"{path}/bucket=*/part-*")}


def test_a_row_rewrites_one_bucket(spark, tmp_path):
    t = B.Keyed(spark, f"file://{tmp_path}/t", "k", KIND, 8)
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(i, "a", f"h{i}", 1) for i in range(100)], KIND), "h", "at")
    before = files(f"{tmp_path}/t")
    assert len(t.upsert(spark.createDataFrame([(7, "b", "new", 2)], KIND), "h", "at")) == 1
    after = files(f"{tmp_path}/t")
    assert len({os.path.dirname(f) for f in before - after}) == 1 and len({os.path.dirname(f) for f in after - before}) == 1
    rows = {r["k"]: r["v"] for r in t.read().collect()}
    assert len(rows) == 100 and rows[7] == "b" and set(rows.values()) == {"a", "b"}
    assert t.upsert(spark.createDataFrame([(None, "x", "y", 3)], KIND), "h", "at") == []
    late = t.upsert(spark.createDataFrame([(7, "old", "h0", 1)], KIND), "h", "at")
    assert len(late) == 1 and {r["v"] for r in t.read().where("k = 7").collect()} == {"b"}
    touched = t.remove(F.col("k") < 3)
    assert 1 <= len(touched) <= 3 and t.read().count() == 97
    t.remove(F.lit(True))
    assert t.read().count() == 0 and not files(f"{tmp_path}/t")


def test_late_rows_of_a_stream_change_nothing(spark, tmp_path):
    t = B.Keyed(spark, f"file://{tmp_path}/t", "k", KIND, 4)
    batches = [[(1, "new", "h1", 9), (2, "b", "h2", 3)], [(1, "old", "h3", 1), (2, "c", "h4", 4), (3, "d", "h5", 1)], [(3, "d", "h5", 1)]]
    for rows in batches:
        spark.createDataFrame(rows, KIND).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
        B.stream_upsert(stream, t, "h", "at", f"file://{tmp_path}/c")
    assert sorted(map(tuple, t.read().collect())) == [(1, "new", "h1", 9), (2, "c", "h4", 4), (3, "d", "h5", 1)]


def test_actions_are_one_a_key_and_equal_the_upsert(spark):
    old = spark.createDataFrame([(1, "a", "h1", 5), (4, "d", "h9", 1), (6, "f", "h6", 1)], KIND)
    new = spark.createDataFrame([(2, "x", "h2", 1), (2, "y", "h3", 2), (1, "late", "h4", 4), (4, "e", "h8", 1), (None, "n", "h5", 9), (None, "n", "h5", 9), (4, "same", "h9", 0), (6, "f", "h6", 2), (8, "out", "h7", 1)], KIND)
    found = sorted(map(tuple, I.changes(old, new, "k", "h", F.col("k") != 8, "at").collect()), key=str)
    assert found == sorted([(2, "create"), (1, "unchanged"), (4, "update"), (6, "unchanged"), (8, "out_of_scope"), (None, "skipped"), (None, "skipped")], key=str)


def test_a_run_is_counted_while_it_writes(spark, tmp_path):
    t = B.Keyed(spark, f"file://{tmp_path}/t", "k", KIND, 4)
    t.upsert(spark.createDataFrame([(1, "a", "h1", 5), (2, "b", "h2", 5), (3, "c", "h3", 5)], KIND), "h", "at")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(v):
        calls.add(1)
        return v

    rows = [(0, None, 1, "a", "h1", 6), (0, None, 2, "b2", "x", 6), (0, None, None, "n", "y", 6), (1, None, 9, "new", "z", 6), (1, None, 9, "newer", "zz", 7), (1, None, 3, "late", "w", 1), (2, "limit", None, None, None, None), (3, None, 50, "far", "q", 1)]
    pages = spark.createDataFrame(rows, "page int, error string, k long, v string, h string, at int").withColumn("v", seen("v"))
    audit = f"file://{tmp_path}/audit"
    r = runs.sync(t, pages, "h", "at", audit, F.col("k") != 50, "test")
    assert {k: r[k] for k in ("status", "pages_fetched", "pages_failed", "seen", "created", "updated", "unchanged", "skipped", "out_of_scope", "superseded", "problems")} == {
        "status": "partial", "pages_fetched": 3, "pages_failed": 1, "seen": 7, "created": 1, "updated": 1, "unchanged": 2, "skipped": 1, "out_of_scope": 1, "superseded": 1, "problems": ["limit"],
    }
    assert calls.value == len(rows)  # the pages were read once
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", "h1", 5), (2, "b2", "x", 6), (3, "c", "h3", 5), (9, "newer", "zz", 7)]
    empty = runs.sync(t, pages.where("page = 2"), "h", "at", audit)
    assert (empty["status"], empty["created"], empty["pages_fetched"]) == ("failed", 0, 0)
    assert sorted(x["status"] for x in runs.runs(spark, audit).collect()) == ["failed", "partial"]


def test_neighbours_are_kept_replaced_and_read_through(spark, tmp_path):
    points = [(i, i // 3, i % 2 == 0, [float((i * 7) % 5), float((i * 3) % 4), 1.0]) for i in range(30)]
    passages = spark.createDataFrame(points, "vec_id long, notice long, award boolean, embedding array<float>")
    reps = spark.createDataFrame([(n, n * 3) for n in range(10)], "source long, vec_id long")
    t = N.store(spark, f"file://{tmp_path}/n", 4)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "notice long")

    def plain(n, keep=3):
        v, best = points[n * 3][3], {}
        for i, m, award, w in points:
            if award and m != n:
                s = round(sum(a * b for a, b in zip(v, w)), 6)
                best[m] = max(best.get(m, (-1e9, 0)), (s, -i))
        return [(m, s) for m, (s, _) in sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:keep]]

    def kept(df, n):
        return [(r["neighbour"], r["score"]) for r in df.where(F.col("notice") == n).orderBy("rank").collect()]

    one = N.read_through(t, ids(1, 2), reps, passages, 1, keep=3)
    assert kept(one, 1) == plain(1) and kept(one, 2) == plain(2)
    before = files(f"{tmp_path}/n")
    N.read_through(t, ids(2), reps, passages, 1, keep=3)
    assert files(f"{tmp_path}/n") == before  # nothing is computed again
    two = N.read_through(t, ids(2), reps, passages, 2, keep=3)
    assert kept(two, 2) == plain(2) and {r["version"] for r in t.read().where("notice = 2").collect()} == {2}
    N.refresh(t, ids(1, 77), reps, passages.where("false"), 2)
    assert t.read().where("notice = 1").count() == 0
    N.refresh(t, ids(4), reps, passages, 1, keep=3)
    N.forget(t, 2)
    assert {r["notice"] for r in t.read().collect()} == {2}


@pytest.fixture()
def rocks(spark):
    name, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_a_ledger_counts_waits_and_forgets(spark, tmp_path, rocks):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    kind = "key string, at timestamp, ok boolean, n long"
    batches = [[("a", t(0), False, 1), ("a", t(10), False, 2), ("b", t(5), True, 3)], [("c", t(500), False, 4)], [("a", t(520), False, 5), ("a", t(530), False, 6), ("c", t(540), True, 7)], [("d", t(5000), True, 8)], [("e", t(5001), True, 9)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        q = ledgers.retry_ledger(stream, 60, 300, 4, 1000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    a = sorted((r["at"], r["event"], r["status"], r["attempts"], r["next_retry_at"]) for r in rows if r["key"] == "a")
    assert a == [
        (t(0), "attempt", "retry", 1, t(60)), (t(10), "attempt", "retry", 2, t(130)), (t(130), "due", "retry", 2, t(130)), (t(520), "attempt", "retry", 3, t(760)),
        (t(530), "attempt", "failed", 4, None), (t(1530), "expired", "failed", 4, None),
    ]
    assert {(r["event"], r["status"]) for r in rows if r["key"] == "c"} == {("attempt", "retry"), ("attempt", "done"), ("expired", "done")}
    assert sorted(r["event"] for r in rows if r["key"] == "b") == ["attempt", "expired"]


def test_once_in_a_window_of_a_stream(spark, tmp_path):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    kind = "k long, at timestamp, n long"
    batches = [[(1, t(1), 1), (1, t(3), 2), (2, t(2), 3)], [(1, t(25), 4), (1, t(23), 5), (2, t(1), 6)], [(1, t(24), 7), (2, t(30), 8)]]
    for rows in batches:
        spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        q = ledgers.once_in_window(stream, "k", "at", "1 day").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    found = {(r["k"], r["at"].date()) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {(1, t(0).date()), (2, t(0).date()), (1, t(24).date()), (2, t(24).date())} and spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_budgets_cut_batches_and_a_stopped_run_goes_on(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = [(i, r.randrange(0, 9)) for i in range(200)]
    numbered = flushes.numbered(spark.createDataFrame(rows, "source long, units int"), F.floor(F.col("source") / 80), "units", 20, 6)
    expected, state = {}, {}
    for i, u in rows:
        if u:
            n, total, batch = state.get(i // 80, (0, 0, 0))
            expected[i] = (i // 80, batch)
            state[i // 80] = (0, 0, batch + 1) if total + u >= 20 or n + 1 >= 6 else (n + 1, total + u, batch)
    assert {x["source"]: (x["range"], x["batch"]) for x in numbered.collect()} == expected
    log, broken = str(tmp_path / "log"), str(tmp_path / "broken")

    def write(own):
        if os.path.exists(broken) and own["range"].iloc[0] == 1 and own["batch"].iloc[0] == 2:
            raise ConnectionError("gone")
        if own["range"].iloc[0] == 2 and own["batch"].iloc[0] == 0 and os.path.exists(broken):
            raise ValueError("one bad source")
        with open(log, "a") as f:
            f.write("".join(f"{i}\n" for i in own["source"]))

    open(broken, "w").close()
    ledger = spark.createDataFrame([], flushes.LEDGER)
    first = spark.createDataFrame(flushes.flush(numbered, ledger, write, (ConnectionError,)).collect(), flushes.LEDGER)
    assert [(x["batch"], x["status"]) for x in first.where("range = 1").orderBy("batch").collect()] == [(0, "done"), (1, "done"), (2, "failed")]
    assert first.where("range = 2 AND status = 'done'").count() > 0  # a bad batch does not end its range
    os.remove(broken)
    second = spark.createDataFrame(flushes.flush(numbered, first, write, (ConnectionError,)).collect(), flushes.LEDGER)
    assert second.where("status <> 'done'").count() == 0 and second.where("range = 0").count() == 0
    assert sorted(map(int, open(log).read().split())) == sorted(expected)  # each source once
