"""Incremental jobs, sources and sinks, streams (S-*, ST-*, M-*)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..registry import query, table
from ..session import scratch, short_batches, spread
from ..sources import blocks as K
from ..sources import files as L
from ..sources import paged, service
from ..sources import records as R
from ..streaming import buckets as B
from ..streaming import flushes, ledgers
from ..streaming import incremental as I
from ..streaming import runs as U
from ..streaming import windows as W

_SNAPSHOTS = """old AS (SELECT doc_id, source, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT CASE WHEN doc_id % 41 = 0 THEN NULL ELSE doc_id END AS doc_id, source, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h, 1 AS version, doc_id // 100 AS page FROM documents WHERE doc_id % 11 <> 0
 UNION ALL SELECT doc_id, source, sha256(text || '?'), 2, doc_id // 100 FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, source, sha256('old'), 0, doc_id // 100 FROM documents WHERE doc_id % 17 = 0)"""
_LATEST = "lat AS (SELECT * FROM new WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1)"
_ACTION = "CASE WHEN lat.source = 'src3' THEN 'out_of_scope' WHEN old.doc_id IS NULL THEN 'create' WHEN old.h = lat.h OR lat.version < 1 THEN 'unchanged' ELSE 'update' END"


def _snapshots(spark, sf):
    """A table and what a service sends of it: changed rows, rows without a key, a key twice, rows that are too old."""
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 7 <> 0").select("doc_id", "source", F.sha2("text", 256).alias("h"), F.lit(1).alias("version"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    page = F.floor(F.col("doc_id") / 100).alias("page")
    new = d.where("doc_id % 11 <> 0").select(F.when(F.col("doc_id") % 41 != 0, F.col("doc_id")).alias("doc_id"), "source", F.sha2(text, 256).alias("h"), F.lit(1).alias("version"), page)
    twice = d.where("doc_id % 13 = 0").select("doc_id", "source", F.sha2(F.concat("text", F.lit("?")), 256).alias("h"), F.lit(2).alias("version"), page)
    late = d.where("doc_id % 17 = 0").select("doc_id", "source", F.sha2(F.lit("old"), 256).alias("h"), F.lit(0).alias("version"), page)
    return old, new.union(twice).union(late)


@query(
    "content_hash_upsert",
    f"WITH {_SNAPSHOTS}, {_LATEST}, c AS (SELECT doc_id, h FROM old WHERE doc_id NOT IN (SELECT doc_id FROM lat WHERE version >= 1) UNION ALL SELECT doc_id, h FROM lat WHERE version >= 1 OR doc_id NOT IN (SELECT doc_id FROM old)) SELECT doc_id, h FROM c",
)
def content_hash_upsert(spark, sf):
    """F-04, ST-01: the table after the upsert, the newest row of a key at most."""
    old, new = _snapshots(spark, sf)
    return I.upsert(old, new, "doc_id", "h", "version").select("doc_id", "h")


@query(
    "upsert_counters",
    f"""WITH {_SNAPSHOTS}, {_LATEST} SELECT {_ACTION} AS action, count(*) AS n FROM lat LEFT JOIN old USING (doc_id) GROUP BY 1 UNION ALL SELECT 'skipped', count(*) FROM new WHERE doc_id IS NULL HAVING count(*) > 0""",
)
def upsert_counters(spark, sf):
    """ST-01, P-23: one action a key."""
    old, new = _snapshots(spark, sf)
    return I.changes(old, new, "doc_id", "h", F.col("source") != "src3", "version").groupBy("action").agg(F.count("*").alias("n"))


@query(
    "sync_audit",
    f"""WITH {_SNAPSHOTS}, a AS (SELECT * FROM new WHERE page <> 3), {_LATEST.replace('FROM new', 'FROM a')}, c AS (SELECT {_ACTION} AS x FROM lat LEFT JOIN old USING (doc_id))
    SELECT CASE WHEN (SELECT max(page) FROM new) >= 3 THEN 'partial' ELSE 'success' END AS status, (SELECT count(DISTINCT page) FROM a) AS pages_fetched, (SELECT count(DISTINCT page) FROM new WHERE page = 3) AS pages_failed,
    (SELECT count(*) FROM a) AS seen, (SELECT count(*) FROM a WHERE doc_id IS NULL) AS skipped, count(*) FILTER (WHERE x = 'create') AS created, count(*) FILTER (WHERE x = 'update') AS updated, count(*) FILTER (WHERE x = 'unchanged') AS unchanged,
    count(*) FILTER (WHERE x = 'out_of_scope') AS out_of_scope, (SELECT count(doc_id) FROM a) - count(*) AS superseded FROM c""",
)
def sync_audit(spark, sf):
    """ST-02, P-23: the audit row of a run of which a page failed, counted in the pass that writes the table."""
    old, new = _snapshots(spark, sf)
    folder = scratch(spark, "sync")
    kept = B.Keyed(spark, f"{folder}/table", "doc_id", "doc_id long, source string, h string, version int")
    kept.upsert(old, "h", "version")
    good = new.where("page <> 3").withColumn("error", F.lit(None).cast("string"))
    bad = new.where("page = 3").limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in new.dtypes if c != "page"), "page", F.lit("limit").alias("error"))
    row = U.sync(kept, good.unionByName(bad), "h", "version", f"{folder}/runs", F.col("source") != "src3", "query")
    names = ["status", "pages_fetched", "pages_failed", "seen", "skipped", "created", "updated", "unchanged", "out_of_scope", "superseded"]
    return U.runs(spark, f"{folder}/runs").where(F.col("run") == row["run"]).select(*names)


@query("partition_counters", f"WITH {_SNAPSHOTS} SELECT source, count(*) AS fetched, count(*) FILTER (WHERE doc_id IS NULL) AS skipped FROM new WHERE version = 1 GROUP BY source")
def partition_counters(spark, sf):
    """ST-03: one pass with counters of every partition."""
    return _snapshots(spark, sf)[1].where("version = 1").groupBy("source").agg(F.count("*").alias("fetched"), F.count_if(F.col("doc_id").isNull()).alias("skipped"))


@query("incremental_index", "SELECT doc_id, source FROM documents WHERE NOT (doc_id % 3 <> 0 AND doc_id % 4 <> 1 AND lang <> 'de')")
def incremental_index(spark, sf):
    """ST-06, M-29, M-33: sources whose fingerprint, model or version the ledger lacks."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("fingerprint"), F.lit("m2").alias("model"), F.lit(3).alias("version"))
    ledger = d.where("doc_id % 3 <> 0").withColumns({"model": F.when(F.col("lang") == "de", "m1").otherwise("m2"), "version": F.when(F.col("doc_id") % 4 == 1, 2).otherwise(3)})
    return I.pending(d, ledger, "doc_id", ["fingerprint", "model", "version"]).select("doc_id", "source")


@query(
    "reextraction",
    """SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last_ok, max(ts) FILTER (WHERE event_type = 'view') AS last_document, count(*) FILTER (WHERE event_type = 'error') AS failures
    FROM events GROUP BY user_id HAVING (last_ok IS NULL OR last_document > last_ok) AND failures < 30""",
)
def reextraction(spark, sf):
    """ST-07: work is due when a document came after the last good run, up to a number of attempts."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    e = table(spark, sf, "events").groupBy("user_id").agg(at("purchase").alias("last_ok"), at("view").alias("last_document"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return e.where("(last_ok IS NULL OR last_document > last_ok) AND failures < 30")


@query("award_reparse", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS version FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey WHERE coalesce(version, 0) < 4")
def award_reparse(spark, sf):
    """ST-08"""
    v = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("version"))
    o = table(spark, sf, "orders").join(v, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.where(F.coalesce("version", F.lit(0)) < 4).select("o_orderkey")


@query("reclassify", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'new' END AS category FROM documents")
def reclassify(spark, sf):
    """ST-09: a decision made by hand stays."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"), F.when(F.col("doc_id") % 3 == 0, "manual").otherwise("rules").alias("decided_by"))
    return I.overwrite(d, {"category": F.lit("new")}, "decided_by", ("manual",)).select("doc_id", "category")


@query(
    "retry_states",
    """WITH s AS (SELECT event_id, (event_id % 5)::INTEGER AS before, event_type <> 'error' AS ok, ts FROM events), t AS (SELECT *, CASE WHEN ok THEN 0 ELSE before + 1 END AS attempts FROM s)
    SELECT event_id, attempts, CASE WHEN ok THEN 'done' WHEN attempts >= 4 THEN 'failed' ELSE 'retry' END AS status,
    CASE WHEN NOT ok AND attempts < 4 THEN ts + to_seconds(least(60 * power(2, attempts - 1), 300)::INT) END AS next_retry_at FROM t""",
)
def retry_states(spark, sf):
    """ST-10, M-04, F-14"""
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("attempts"), "event_type", "ts")
    return I.next_state(e, F.col("event_type") != "error", 60, 300, 4, F.col("ts")).select("event_id", "attempts", "status", "next_retry_at")


@query("derived_terms", r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '(\p{L}{3,})', 1)))::INTEGER AS terms FROM documents")
def derived_terms(spark, sf):
    """ST-11: the derived search column, computed in the write path."""
    from ..operators.vectors import words

    return table(spark, sf, "documents").select("doc_id", F.size(words(F.col("text"))).alias("terms"))


@query("expired_state", "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-25' GROUP BY 1")
def expired_state(spark, sf):
    """ST-12"""
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return I.not_expired(table(spark, sf, "events"), "ts", now, 5 * 86400).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Extension: event-time windows over a file stream, run until no input is left."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet")
    stream = stream.select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    folder = scratch(spark, "windows")
    found = W.run_to_table(W.tumbling(stream, "6 hours"), f"{folder}/out", f"{folder}/checkpoint")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_upserts", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_upserts(spark, sf):
    """ST-01, ST-04, ST-13: a stream of changes in three batches, the newest rows first, applied to a table."""
    e = table(spark, sf, "events")
    bounds = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), (F.max("event_id") + 1).alias("n")).first()
    folder = scratch(spark, "upserts")
    part = F.floor(F.col("event_id") * 3 / F.lit(bounds["n"] or 1))
    rows = e.select("user_id", "event_id", F.struct("ts", "event_id").alias("order_key"), F.sha2(F.col("event_id").cast("string"), 256).alias("h"))
    kept = B.Keyed(spark, f"{folder}/table", "user_id", rows.schema)
    for k in (2, 1, 0):  # each append is a batch; later ones hold older rows
        rows.where(part == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        B.stream_upsert(stream, kept, "h", "order_key", f"{folder}/checkpoint")
    return kept.read().select("user_id", "event_id")


@query(
    "paged_records",
    """WITH p AS (SELECT *, (o_orderkey // 500) * 500 AS page FROM orders)
    SELECT page, count(CASE WHEN page <> 1500 THEN 1 END) AS records, coalesce(sum(CASE WHEN page <> 1500 THEN o_orderkey END), 0)::BIGINT AS total, page = 1500 AS failed FROM p GROUP BY page""",
)
def paged_records(spark, sf):
    """S-01 to S-03: landed pages read by offset as a service serves them; a page that fails is an error row and no stop."""
    folder = scratch(spark, "pages")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.floor(F.col("o_orderkey") / 500) * 500).alias("page"))
    most = o.agg(F.max("page")).first()[0]
    total = F.lit(0 if most is None else most + 500).cast("string").alias("total")
    bodies = o.groupBy("page").agg(F.to_json(F.struct(total, F.collect_list(F.struct("id")).alias("notices"))).alias("body"))
    body = F.when(F.col("page") == 1500, F.lit('{"error": "limit"}')).otherwise(F.col("body"))
    bodies.select(F.lit("all").alias("scope"), "page", body.alias("value")).write.partitionBy("scope", "page").text(folder)
    service.register(spark, "landed_pages", service.Service(landed(folder), ("id",), "notices", rows=500, attempts=1))
    found = spark.read.format("landed_pages").load()
    record = F.col("id").cast("long")
    return found.groupBy("page").agg(F.count(record).alias("records"), F.coalesce(F.sum(record), F.lit(0)).alias("total"), F.max(F.col("error").isNotNull()).alias("failed"))


def landed(folder: str, total: dict[int, int] | None = None):
    """A fetch function over pages that Spark wrote as text under ``scope=<name>/page=<offset>``; a page that is not there is empty.

    The name of a scope is that of its filters' values in order of their names, hashed; ``all`` without a filter.
    """

    def fetch(filters: dict, offset: int, rows: int) -> str:
        where, parts = _parts(folder, filters, offset)
        if not parts:
            return json.dumps({"notices": [], "total": (total or {}).get(len(filters))})
        return "".join(where.open_input_stream(x).read().decode() for x in parts)

    return fetch


def _parts(folder: str, filters: dict, offset: int) -> tuple:
    """The file system of a landed page and the paths of its files."""
    from pyarrow import fs

    name = hashlib.md5("|".join(filters[k] for k in sorted(filters)).encode()).hexdigest() if filters else "all"
    where, place = fs.FileSystem.from_uri(f"{folder}/scope={name}/page={offset}")
    return where, sorted(x.path for x in where.get_file_info(fs.FileSelector(place, allow_not_found=True)) if x.base_name.startswith("part-"))


def landed_lines(folder: str, total: dict[int, int]):
    """As ``landed``, over pages that hold a record a line; where one record is asked for, to learn of the page, no more than its line is read."""

    def fetch(filters: dict, offset: int, rows: int) -> str:
        where, parts = _parts(folder, filters, offset)
        found: list[str] = []
        for path in parts:
            if rows == 1 and found:
                break
            with where.open_input_stream(path) as stream:
                held = []
                while more := stream.read(1 << 16 if rows == 1 else 1 << 24):
                    held.append(more)
                    if rows == 1 and b"\n" in more:
                        break
            lines = [x for x in b"".join(held).decode(errors="ignore" if rows == 1 else "strict").split("\n") if x]
            found += lines[:1] if rows == 1 else lines
        return f'{{"total": {json.dumps(total.get(len(filters)))}, "notices": [{",".join(found)}]}}'

    return fetch


@query("resumed_walk", "SELECT o_orderkey, o_orderpriority FROM orders")
def resumed_walk(spark, sf):
    """ST-04, S-01, S-02: an archive walked by scope, stopped after a slice and gone on; scopes over the cap are divided by priority."""
    folder = scratch(spark, "walk")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = (o.agg(F.max("o_orderkey")).first()[0] or 0) + 1
    rows, parts = max(100, n // 20), 5
    page = lambda keys: (F.floor(F.col("o_orderkey") / keys) * rows).alias("page")
    record = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("priority"))).alias("value")
    one = o.select(F.md5("c_mktsegment").alias("scope"), page(rows), record)
    two = o.select(F.md5(F.concat_ws("|", "o_orderpriority", "c_mktsegment")).alias("scope"), page(parts * rows), record)
    spread(one.union(two), "scope", "page").write.partitionBy("scope", "page").text(folder)  # a record a line: no page is a value of its own
    segments = sorted(r[0] for r in table(spark, sf, "customer").select("c_mktsegment").distinct().collect())  # the few scopes of the archive
    kinds = sorted(r[0] for r in table(spark, sf, "orders").select("o_orderpriority").distinct().collect())
    divide = lambda scope: [scope | {"priority": p} for p in kinds] if len(scope) == 1 else []
    cap = -(-n // 2 // rows) * rows
    asked = service.Service(landed_lines(folder, {1: n, 2: -(-n // parts)}), ("id", "priority"), "notices", rows=rows, cap=cap, scopes=tuple({"segment": s} for s in segments), divide=divide, pages=4, attempts=1)
    kept = B.Keyed(spark, f"{folder}-table", "o_orderkey", "o_orderkey long, o_orderpriority string, h string")
    take = lambda batch, _: kept.upsert(batch.select(F.col("id").cast("long").alias("o_orderkey"), F.col("priority").alias("o_orderpriority"), F.md5("record").alias("h")), "h")
    for slices in (1, 40):  # stopped after one slice; the second walk finds where the first was
        service.register(spark, "archive", asked)
        service.walk(spark, "archive", take, f"{folder}-checkpoint", slices)
    return kept.read().select("o_orderkey", "o_orderpriority")


def _streamed(spark, rows, part, start, folder):
    """``rows`` appended in three parts, each a batch of the stream that ``start`` makes; what it wrote."""
    for k in range(3):
        rows.where(part == k).write.mode("append").parquet(f"{folder}/in")
        found = start(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        out = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        out.start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query(
    "stream_retries",
    """WITH g AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
    a AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS attempts FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, attempts::INTEGER AS attempts, CASE WHEN event_type <> 'error' THEN 'done' WHEN attempts >= 4 THEN 'failed' ELSE 'retry' END AS status,
    CASE WHEN event_type = 'error' AND attempts < 4 THEN date_trunc('milliseconds', ts) + to_seconds(least(60 * power(2, attempts - 1), 300)::INT) END AS next_retry_at FROM a""",
)
def stream_retries(spark, sf):
    """ST-10, ST-12: the ledger that a stateful stream keeps of each user's attempts, over three batches."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("n"))
    bounds = e.agg(F.min("at").cast("double").alias("a"), F.max("at").cast("double").alias("b")).first()
    width = max(1.0, (bounds["b"] or 0) - (bounds["a"] or 0)) + 1
    part = F.floor((F.col("at").cast("double") - (bounds["a"] or 0)) * 3 / width)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = _streamed(spark, e, part, lambda s: ledgers.retry_ledger(s, 60, 300, 4, 400 * 86400, "1 second"), scratch(spark, "retries"))
    finally:
        spark.conf.set(setting, before)
    last = rows.where("event = 'attempt'").groupBy("key").agg(F.max_by(F.struct("attempts", "status", "next_retry_at"), F.struct("at", "n")).alias("x"))
    return last.select(F.col("key").cast("long").alias("user_id"), "x.attempts", "x.status", F.col("x.next_retry_at").cast("timestamp_ntz").alias("next_retry_at"))


@query("stream_once", "SELECT DISTINCT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day FROM events WHERE event_type = 'click'")
def stream_once(spark, sf):
    """M-05 on a stream: one request of a key in a window, over batches that are out of order by up to half a window."""
    e = table(spark, sf, "events").where("event_type = 'click'").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"))
    bounds = e.agg(F.min("at").cast("double").alias("a"), F.max("at").cast("double").alias("b")).first()
    width = max(1.0, (bounds["b"] or 0) - (bounds["a"] or 0)) + 50_000
    shifted = F.col("at").cast("double") - (bounds["a"] or 0) + (F.col("event_id") % 12) * 3600
    found = _streamed(spark, e, F.floor(shifted * 3 / width), lambda s: ledgers.once_in_window(s, "user_id", "at", "1 day"), scratch(spark, "once"))
    return found.select("user_id", F.date_trunc("day", "at").cast("timestamp_ntz").alias("day"))


@query(
    "flushed_batches",
    """WITH RECURSIVE c AS (SELECT doc_id // 250 AS range, n_chars // 900 AS u, row_number() OVER (PARTITION BY doc_id // 250 ORDER BY doc_id) AS i FROM documents WHERE n_chars // 900 > 0),
    w AS (SELECT range, i, u, 0 AS batch, 1 AS n, u AS total FROM c WHERE i = 1
      UNION ALL SELECT c.range, c.i, c.u, CASE WHEN w.total >= 30 OR w.n >= 12 THEN batch + 1 ELSE batch END, CASE WHEN w.total >= 30 OR w.n >= 12 THEN 1 ELSE n + 1 END, CASE WHEN w.total >= 30 OR w.n >= 12 THEN c.u ELSE total + c.u END
      FROM w JOIN c ON c.range = w.range AND c.i = w.i + 1)
    SELECT range, batch::INTEGER AS batch, count(*)::INTEGER AS sources, sum(u)::BIGINT AS units, 'done' AS status FROM w GROUP BY 1, 2""",
)
def flushed_batches(spark, sf):
    """ST-06, M-29: sources in batches of a budget, flushed in order; a run that was stopped goes on behind its last ledger row."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("source"), F.floor(F.col("n_chars") / 900).alias("units"))
    cut = flushes.numbered(d, F.floor(F.col("source") / 250), "units", 30, 12)
    none = spark.createDataFrame([], flushes.LEDGER)
    ledger = scratch(spark, "flushes")

    def stops(own) -> None:
        if own["batch"].iloc[0] >= 2:
            raise ConnectionError("the store is gone")

    flushes.flush(cut, none, stops, (ConnectionError,)).write.parquet(ledger)
    first = spark.read.schema(none.schema).parquet(ledger)
    second = flushes.flush(cut, first, lambda own: None)
    return first.where("status = 'done'").union(second).select("range", "batch", "sources", "units", "status")


def fetch_from(text: dict[int, str]):
    """A fetch function for ``paged.read_pages`` over landed pages, for tests and replays."""
    return lambda offset, rows: text.get(offset, json.dumps({"error": f"no page at {offset}"}))


__all__ = ["fetch_from", "landed", "landed_lines", "paged"]


_CLEAN = "CASE WHEN lower(trim({c})) IN ('none', 'null', 'n/a') THEN '' ELSE trim({c}) END"


@query(
    "notice_records",
    """SELECT 'OP' || o_orderkey AS notice_id, n_name AS country, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS notice_type, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS notice_date,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE timezone('UTC', timezone(coalesce(z, 'UTC'), o_orderdate::DATE::TIMESTAMP + to_minutes(CASE WHEN z IS NULL THEN 1439 WHEN o_orderkey % 3 = 0 THEN 1020 ELSE 1439 END))) END AS deadline_at,
    '<p>' || o_orderstatus || '</p>' AS notice_text_sanitized
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (VALUES (1, 'Asia/Tashkent'), (2, 'Europe/Berlin')) zz(k, z) ON k = n_nationkey WHERE o_orderkey % 11 <> 0""",
)
def notice_records(spark, sf):
    """F-05, M-03: irregular JSON records as typed notices; a record without an id goes."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    at = F.when(k % 2 == 0, F.date_format(d, "dd-MMM-yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    record = F.to_json(
        F.struct(
            F.when(k % 11 != 0, F.concat(F.lit("OP"), k.cast("string"))).otherwise(" N/A ").alias("id"), F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("  "), "o_orderpriority")).alias("notice_type"),
            F.when(k % 7 == 0, "soon").otherwise(at).alias("noticedate"), F.when(k % 4 != 0, F.date_format(d, "yyyy-MM-dd'T'00:00:00'Z'")).alias("submission_deadline_date"),
            F.when(k % 3 == 0, "17:00").alias("submission_deadline_time"), F.col("n_name").alias("project_ctry_name"),
            F.concat(F.lit("<p onclick=x()>"), "o_orderstatus", F.lit("</p><script>alert(1)</script>")).alias("notice_text"),
        )
    )
    zones = {"NATION_1": "Asia/Tashkent", "NATION_2": "Europe/Berlin"}
    found = R.map_notices(o.select(record.alias("record")), zones=zones)
    return found.select("notice_id", "country", "notice_type", "notice_date", F.col("deadline_at").cast("timestamp_ntz").alias("deadline_at"), "notice_text_sanitized")


@query(
    "project_records",
    """SELECT 'P' || s_suppkey AS project_id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey * 1000)::DOUBLE END AS amount, n_name || ',Water' AS sectors, CASE WHEN s_suppkey % 2 = 0 THEN 'Roads' ELSE 'Towns' END AS themes
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def project_records(spark, sf):
    """F-07, M-03: project records; lists of objects become lists of names."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    named = lambda n, key: F.struct(n.alias(key))
    record = F.to_json(
        F.struct(
            F.concat(F.lit("P"), k.cast("string")).alias("id"), F.concat(F.col("s_name"), F.lit(" ")).alias("project_name"),
            F.when(k % 4 != 0, F.concat(F.lit("$"), F.format_number(k * 1000, 0))).otherwise("n/a").alias("totalamt"),
            F.array(named(F.col("n_name"), "Name"), named(F.lit("Water"), "Name"), named(F.lit(" "), "Name")).alias("sector"),
            F.when(k % 2 == 0, F.array(F.lit("Roads"))).alias("theme"), F.array(named(F.lit("Towns"), "name")).alias("theme_list"),
        )
    )
    p = R.map_projects(s.select(record.alias("record")))
    return p.select("project_id", "name", F.col("total_amount_usd").cast("double").alias("amount"), F.array_join("sectors", ",").alias("sectors"), F.array_join("themes", ",").alias("themes"))


@query(
    "picked_reviews",
    """WITH d AS (SELECT source AS project_id, 'g' || doc_id AS guid, CASE doc_id % 6 WHEN 0 THEN 'Appraisal Environmental and Social Review Summary (ESRS) - ESRSA' || lpad(doc_id::VARCHAR, 5, '0') WHEN 1 THEN 'Concept stage' ELSE 'Plan' END AS title,
    CASE doc_id % 6 WHEN 1 THEN 'Environmental and Social Review Summary' ELSE 'Other' END AS kind, DATE '2020-01-01' + (doc_id % 300)::INTEGER AS doc_date FROM documents)
    SELECT project_id, guid, doc_date, regexp_extract(title, 'ESRSA[0-9]+') AS report_no FROM d WHERE kind <> 'Other' OR title LIKE 'Appraisal%' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY title LIKE 'Appraisal%' DESC, doc_date DESC, guid DESC) = 1""",
)
def picked_reviews(spark, sf):
    """F-08, F-09, M-03: document records of projects, and the review summary of each."""
    k = F.col("doc_id")
    title = F.when(k % 6 == 0, F.concat(F.lit("Appraisal Environmental and Social Review Summary (ESRS) - esrsa"), F.lpad(k.cast("string"), 5, "0"))).when(k % 6 == 1, "Concept stage").otherwise("Plan")
    record = F.to_json(
        F.struct(
            F.concat(F.lit("g"), k.cast("string")).alias("id"), title.alias("docna"), F.when(k % 6 == 1, "Environmental and Social Review Summary").otherwise("Other").alias("docty"),
            F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'").alias("docdt"),
        )
    )
    d = R.map_documents(table(spark, sf, "documents").select(F.col("source").alias("project_id"), record.alias("record")))
    return R.pick_review(d).select("project_id", "guid", "doc_date", "report_no")


@query("sniffed_pages", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'html' ELSE 'text' END AS kind, length(sha256(url)) AS digits FROM pages")
def sniffed_pages(spark, sf):
    """S-06, S-17: kinds by first bytes, never by name."""
    k = F.col("page_id") % 4
    content = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), "url")).when(k == 1, F.concat(F.lit("PK\u0003\u0004"), "url")).when(k == 2, F.col("html")).otherwise(F.col("url"))
    files = table(spark, sf, "pages").select("page_id", F.encode(content, "UTF-8").alias("content"))
    return L.sniff(files).select("page_id", "kind", F.length("sha256").cast("long").alias("digits"))


@query(
    "text_blocks",
    r"""WITH d AS (SELECT doc_id, [trim(x) FOR x IN string_split(regexp_replace(text, '[#|`~=\-]', ' ', 'g'), chr(10)) IF trim(x) <> ''] AS l FROM documents),
    n AS (SELECT doc_id, len(l) AS n, doc_id % 4 AS k, l[1] AS first FROM d)
    SELECT doc_id, (n + CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 2 END)::BIGINT AS blocks, (CASE k WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END)::BIGINT AS tables, (k = 1)::BIGINT AS code,
    CASE k WHEN 0 THEN trim(first) WHEN 1 THEN 'Top' WHEN 2 THEN 'Over > Under' ELSE '' END AS path FROM n""",
)
def text_blocks(spark, sf):
    """S-08, M-38: every line of a text as a paragraph, under headings and beside tables and fences of several styles."""
    k = F.col("doc_id") % 4
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", r"[#|`~=\-]", " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    body = lambda a: F.array_join(a, "\n\n")
    first = F.coalesce(F.get("l", 0), F.lit(""))
    text = (
        F.when(k == 0, F.concat(F.lit("\n"), first, F.lit("\n=====\n\n"), body(F.slice("l", 2, 1 << 30)), F.lit("\n\n## \n")))
        .when(k == 1, F.concat(F.lit("~~~\n# no heading\n```\n~~~\n# Top #\n"), body(F.col("l"))))
        .when(k == 2, F.concat(F.lit("# Over\n\nUnder\n-----\nname | n\n--- | ---\na | 1\n\n"), body(F.col("l"))))
        .otherwise(F.concat(body(F.col("l")), F.lit("\n\n| a | b |\n| 1 | 2 |\n```\nopen | to the end")))
    )
    d = table(spark, sf, "documents").select("doc_id", lines.alias("l"))
    b = K.blocks(d.select("doc_id", text.alias("text")))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return b.groupBy("doc_id").agg(F.count("*").alias("blocks"), of("table").alias("tables"), (of("code") - F.when(F.max("doc_id") % 4 == 3, 1).otherwise(0)).alias("code"), F.max_by("path", "block_no").alias("path"))


_BODY = "regexp_replace(html, '(?is)^.*?<body[^>]*>|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', '', 'g')"
_DECODED = "x"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_a}', '{_b}')"


@query(
    "html_blocks",
    rf"""WITH b AS (SELECT page_id, html, string_split(regexp_replace(regexp_replace({_BODY}, '(?i)</?(p|div|li|ul|ol|br|hr|section|article|header|footer|nav|h[1-6])\b[^>]*>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS x FROM pages),
    c AS (SELECT page_id, html, [trim(regexp_replace({_DECODED}, '\s+', ' ', 'g')) FOR x IN x] AS x FROM b), d AS (SELECT page_id, html, [y FOR y IN x IF y <> ''] AS x FROM c)
    SELECT page_id, len(x)::BIGINT AS blocks, len(regexp_extract_all(html, '<h1', 0))::BIGINT AS headings, md5(array_to_string(x, chr(10))) AS digest FROM d""",
)
def html_blocks(spark, sf):
    """S-08: headings and paragraphs of markup in order."""
    b = K.html_blocks(table(spark, sf, "pages"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    return b.groupBy("page_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "heading").alias("headings"), F.md5(F.array_join(texts, "\n")).alias("digest"))


@query(
    "csv_corrections",
    "WITH r AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN '' ELSE (p_partkey - p_partkey % 10 // 9)::VARCHAR END AS k, CASE WHEN p_partkey % 7 = 0 THEN 'odd' ELSE 'it' END AS c FROM part) SELECT k, c, CASE WHEN k = '' THEN 'empty key' WHEN count(*) OVER (PARTITION BY k) > 1 THEN 'repeated key' WHEN c <> 'it' THEN 'unknown c' END AS problem FROM r",
)
def csv_corrections(spark, sf):
    """S-09, S-12, M-39: written as CSV and read back with its problems."""
    p = F.col("p_partkey")
    k = F.when(p % 50 == 0, "").otherwise((p - F.when(p % 10 == 9, 1).otherwise(0)).cast("string"))
    rows = table(spark, sf, "part").select(k.alias("k"), F.when(p % 7 == 0, "odd").otherwise("it").alias("c"))
    path = scratch(spark, "corrections")
    L.write_csv(rows, path)
    found = L.read_corrections(spark, path, "k", {"c": ["it", "supply"]})
    return found.select(F.coalesce("k", F.lit("")).alias("k"), "c", "problem")


@query("jsonl_round_trip", "SELECT conv_id, turn, role FROM conversations")
def jsonl_round_trip(spark, sf):
    """S-10, S-11: decisions as JSON lines, read back under a schema."""
    path = scratch(spark, "jsonl")
    table(spark, sf, "conversations").select("conv_id", "turn", "role").write.json(path)
    return spark.read.schema("conv_id long, turn long, role string").json(path)


@query(
    "vector_upsert",
    """SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN -1 ELSE label END AS label, len(embedding)::INTEGER AS width, round(CASE WHEN vec_id % 6 = 0 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 6) AS head
    FROM embeddings WHERE vec_id % 10 <> 9 OR vec_id % 6 = 0""",
)
def vector_upsert(spark, sf):
    """S-14, V-09, V-11: points with their vectors replaced by key; a source's points deleted."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.sha2(F.to_json(F.struct("label", "embedding")), 256).alias("h"))
    turned = F.transform("embedding", lambda x: (-x).cast("float"))
    new = e.where("vec_id % 6 = 0").withColumns({"label": F.lit(-1), "embedding": turned})
    new = new.withColumn("h", F.sha2(F.to_json(F.struct("label", "embedding")), 256))
    found = I.upsert(e.where("vec_id % 10 <> 9"), new, "vec_id", "h")
    return found.select("vec_id", "label", F.size("embedding").alias("width"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("head"))


@query("blob_names", "SELECT page_id, left(sha256(url), 2) || '/' || sha256(url) || '.pdf' AS name FROM pages")
def blob_names(spark, sf):
    """S-15"""
    pages = table(spark, sf, "pages").select("page_id", F.encode("url", "UTF-8").alias("content"))
    return pages.select("page_id", L.blob_name("content", "pdf").alias("name"))


@query(
    "upload_intake",
    "WITH u AS (SELECT 'f' || page_id || CASE page_id % 3 WHEN 0 THEN '.exe' ELSE '.pdf' END AS path, CASE WHEN page_id % 10 = 1 THEN '' ELSE 'c' || page_id % 40 END AS c FROM pages) SELECT path, CASE WHEN ends_with(path, '.exe') THEN 'suffix' WHEN c = '' THEN 'empty' WHEN min(path) FILTER (WHERE NOT ends_with(path, '.exe')) OVER (PARTITION BY c) <> path THEN 'repeated' END AS refusal FROM u",
)
def upload_intake(spark, sf):
    """S-17, M-43"""
    n = F.col("page_id")
    path = F.concat(F.lit("f"), n.cast("string"), F.when(n % 3 == 0, ".exe").otherwise(".pdf"))
    content = F.when(n % 10 == 1, "").otherwise(F.concat(F.lit("c"), (n % 40).cast("string")))
    files = table(spark, sf, "pages").select(path.alias("path"), F.encode(content, "UTF-8").alias("content"))
    return L.intake(files, ("pdf", "docx", "html", "txt"), 1 << 20).select("path", "refusal")


@query("source_vocabulary_zero_fill", "SELECT n_name AS value, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) ON n_nationkey = c_nationkey")
def source_vocabulary_zero_fill(spark, sf):
    """S-13"""
    counts = table(spark, sf, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return A.zero_filled(table(spark, sf, "nation"), counts, "n_nationkey").select(F.col("n_name").alias("value"), "n")


@query(
    "link_registry",
    "WITH l AS (SELECT url, page_id, CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS r FROM pages UNION ALL SELECT url, page_id + 100000, 1 FROM pages WHERE page_id % 2 = 0) SELECT sha256(url) AS key, min(r)::INTEGER AS kind, count(DISTINCT page_id) AS notices FROM l GROUP BY url",
)
def link_registry(spark, sf):
    """M-01, M-02, M-16: links registered by hash, the most telling kind kept, every notice attached."""
    p = table(spark, sf, "pages").select("url", "page_id")
    a = p.withColumn("r", (F.col("page_id") % 3).cast("int"))
    b = p.where("page_id % 2 = 0").select("url", (F.col("page_id") + 100000).alias("page_id"), F.lit(1).alias("r"))
    known = I.register_links(b.withColumnsRenamed({"page_id": "notice", "r": "kind"}))
    found = I.register_links(a.withColumnsRenamed({"page_id": "notice", "r": "kind"}), known)
    return found.select("key", "kind", F.size("notices").cast("long").alias("notices"))


@query("once_per_window", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2")
def once_per_window(spark, sf):
    """M-05: at most one request of a key in a window."""
    e = table(spark, sf, "events").where("event_type = 'click'")
    return e.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.min("event_id").alias("event_id"))


@query("lookup_queue", "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderstatus = 'P' ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey LIMIT 25")
def lookup_queue(spark, sf):
    """M-10: unchecked rows, newest first."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").withColumn("d", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")))
    return o.orderBy(F.desc_nulls_last("d"), "o_orderkey").limit(25).select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


@query("answer_normalisation", "SELECT event_id, least(greatest((value)::INTEGER, 1), 99) AS n, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'medium' END AS importance FROM events WHERE event_type <> 'error'")
def answer_normalisation(spark, sf):
    """M-20: rows without evidence go, counts are clamped, unknown importance gets the default."""
    e = table(spark, sf, "events").where("event_type <> 'error'")
    n = F.least(F.greatest(F.rint("value").cast("int"), F.lit(1)), F.lit(99))
    return e.select("event_id", n.alias("n"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("medium").alias("importance"))


@query(
    "document_states",
    "WITH d AS (SELECT source, length(trim(coalesce(text, ''))) >= 200 AS ok FROM documents) SELECT source, count(*) FILTER (WHERE ok) AS readable, count(*) FILTER (WHERE NOT ok) AS supplied, count(*) FILTER (WHERE ok) = 0 AS contact FROM d GROUP BY source",
)
def document_states(spark, sf):
    """M-28, M-23: by the texts themselves."""
    from ..functions.text import refusal

    d = table(spark, sf, "documents").select("source", (refusal(F.col("text"), 200) == "").alias("ok"))
    ok = F.count_if("ok")
    return d.groupBy("source").agg(ok.alias("readable"), F.count_if(~F.col("ok")).alias("supplied"), (ok == 0).alias("contact"))


@query("resanitise_report", "SELECT count(*) AS pages, 0::BIGINT AS changed_again FROM pages")
def resanitise_report(spark, sf):
    """M-36, M-40, M-41: maintenance is idempotent: a second pass changes nothing."""
    from ..functions.text import sanitize

    short_batches(spark)
    once = table(spark, sf, "pages").select(sanitize(F.col("html")).alias("once"))
    return once.agg(F.count("*").alias("pages"), F.count_if(sanitize(F.col("once")) != F.col("once")).alias("changed_again"))


@query("id_arrays", "SELECT l_partkey, string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS notices FROM lineitem GROUP BY 1")
def id_arrays(spark, sf):
    """M-37, M-26"""
    l = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))).alias("n"))
    return l.select("l_partkey", F.array_join("n", ",").alias("notices"))


