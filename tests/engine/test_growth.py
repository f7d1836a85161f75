"""What lets figures grow with the input: steps that are done once, or by a faster way to the same result."""

import pytest
from pyspark.sql import functions as F

from noticelake.functions import awards as A
from noticelake.functions import classify as K
from noticelake.functions import contacts as C


def test_markers_read_a_text_in_one_pass(spark):
    """Patterns of many branches that end nowhere cost a long text little, and fold letters as the SQL does."""
    texts = ["TEAM  LEADER, at\x0bleast; ISO 9001", "DİPLOM нЕ  МЕНЕЕ 5 лет", "5 летний", "shortlist\nкраткий список", "", None, "ſhort-list", "minimum"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", K.marker_score(F.col("t"), K.MARKERS).alias("s"))
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
    got = [r["s"] for r in rows.orderBy("i").collect()]
    duckdb = pytest.importorskip("duckdb")
    sql = duckdb.connect()
    assert got == [sql.execute(f"SELECT {K.marker_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] for t in texts]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_dealt_before_they_are_cut_to_lines(spark):
    bodies = spark.createDataFrame([(1, "<p>Awarded Bidder(s):<br>Two (1234)<br>Contract Price<br>EUR 7</p>")], "notice_id long, html string")
    plan = _plan(A.bidders(bodies))
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")  # the plan's last steps stand first


def test_contacts_of_one_file_are_read_by_many_tasks(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("Attn: Ann Lee E-mail: ann.lee@x.org").alias("text")).coalesce(1)
    found = C.body_contacts(docs)
    assert found.rdd.getNumPartitions() > 1 and found.where("email = 'ann.lee@x.org' AND name = 'Ann Lee'").count() == 100


class _Timers:
    """A handle of one key: its value and its timers, and how often these were set or taken back."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)
        self.calls += 1

    def deleteTimer(self, at):
        self.timers.discard(at)
        self.calls += 1


def _told(batches, base, most, limit, ttl):
    """What a ledger is to tell of one key, by looking at every batch anew: attempts, then what the watermark has passed, in order of time."""
    out, attempts, status, latest, due = [], 0, "", None, None
    for rows, now in batches:
        for ms, ok in sorted(rows):
            attempts = 0 if ok else attempts + 1
            status = "done" if ok else "failed" if attempts >= limit else "retry"
            due = ms + 1000 * min(base * 2 ** (attempts - 1), most) if status == "retry" else None
            latest = ms if latest is None else max(latest, ms)
            out.append(("attempt", ms, status, attempts))
        if latest is not None and due is not None and due <= min(now, latest + 1000 * ttl):
            out.append(("due", due, status, attempts))
            due = None
        if latest is not None and latest + 1000 * ttl <= now:
            out.append(("expired", latest + 1000 * ttl, status, attempts))
            attempts, status, latest, due = 0, "", None, None
    return out


@pytest.mark.parametrize("ttl", [50, 150, 5000])
def test_a_ledgers_timers_move_when_they_fire(ttl):
    """Attempts of a key go through the ledger as rows; the timer of its expiry is not set anew at each batch."""
    import random
    from types import SimpleNamespace

    from pyspark.sql import Row

    from noticelake.streaming import ledgers

    Attempt = Row("us", "n", "ok")
    for seed in range(60):
        r = random.Random(seed)
        clock, batches = 1000, []
        for _ in range(12):
            rows = [(clock + 1000 * r.randrange(1, 90), r.random() < 0.4) for _ in range(r.choice([0, 1, 1, 3]))]
            rows = list({ms: (ms, ok) for ms, ok in rows}.values())
            clock += 1000 * r.choice([10, 90, 90, 400])
            batches.append((rows, clock))
        handle, ledger, got = _Timers(), ledgers.RetryLedger(60, 300, 4, ttl), []
        ledger.init(handle)
        for rows, now in batches:
            at = SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
            if rows:
                got += ledger.handleInputRows(("k",), iter([Attempt(1000 * ms, i, ok) for i, (ms, ok) in enumerate(rows)]), at)
            for t in sorted(x for x in handle.timers if x <= now):
                got += ledger.handleExpiredTimer(("k",), at, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))
                handle.timers.discard(t)
        assert [(x["event"], x["at"] // 1000, x["status"], x["attempts"]) for x in got] == _told(batches, 60, 300, 4, ttl)
    handle, ledger = _Timers(), ledgers.RetryLedger(60, 300, 4, ttl)
    ledger.init(handle)
    for k in range(20):
        list(ledger.handleInputRows(("k",), iter([Attempt(1_000_000 * k, k, True)]), None))
    assert handle.calls == 1


def test_requirements_are_found_within_a_row(spark):
    """No task holds more than a row: the criteria of a body need no shuffle, sort or window; the first sentence of each key counts."""
    from noticelake.functions import text as T

    texts = [
        "The annual turnover is at least: USD 2,000,000 or EUR 1 million. Liquid assets of USD 700. Liquid assets of USD 300. Annual turnover of EUR 9.",
        "Liquid assets are to be at least: (a) USD 5,000 or USD 4,000. Nothing else.",
        "The bid security: Nothing. Bid security of EUR 3,000 is asked for.", "Annual turnover:", "", None,
    ]
    docs = spark.createDataFrame([(i, t, 2026) for i, t in enumerate(texts)], "doc_id long, text string, year int")
    found = T.requirements(docs)
    assert not any(step in _plan(found) for step in ("Exchange", "Sort", "Window", "Aggregate"))
    got = sorted((r["doc_id"], r["key"], r["value"], r["unit"], r["quote"]) for r in found.collect())
    assert got == [
        (0, "annual_turnover_avg", 2_000_000.0, "USD", "The annual turnover is at least: USD 2,000,000 or EUR 1 million."), (0, "liquid_assets", 700.0, "USD", "Liquid assets of USD 700."),
        (1, "liquid_assets", 4_000.0, "USD", "Liquid assets are to be at least: (a) USD 5,000 or USD 4,000."), (2, "bid_security", 3_000.0, "EUR", "Bid security of EUR 3,000 is asked for."),
    ]


def test_a_record_is_parsed_once(spark):
    """The test for an id stays with the parsed record; as a filter it went down to the source and parsed the record again for each use of its id."""
    from noticelake.sources import records as R

    rows = spark.createDataFrame([('{"id": " N/A "}',), ('{"id": " a "}',), ("{}",), ("bad",), (None,), ('{"id": ["b", "c"]}',)], "record string")
    found = R.map_notices(rows.select(F.concat("record", F.lit(" ")).alias("record")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(MapType") == 1 and "Filter" not in plan
    assert sorted(r["notice_id"] for r in found.collect()) == ["a", "b c"]


def test_dates_are_tried_only_in_forms_that_fit(spark):
    """The same dates as by trying every form on every text."""
    from noticelake.functions import scalars as S
    from noticelake.sources import records as R

    texts = ["2024-03-05", " 2024-03-05T10:00:00Z ", "05-Mar-2024", "5-Mar-2024", "05/03/2024", "25/12/2024", "12/25/2024", "2024/03/05", "Mar 5, 2024", "Mar 05, 2024", "March 5, 2024", "soon", "", None]
    texts += ["2024-3-5", "20240305", "+12024-03-05", "-0001-01-01", "24-03-05", "05-03-2024", "2024-02-30", "31/02/2024", "a-b-c", "1/2/2024", "12/2024", "ab/cd", "Mar 5,2024", "05-Mar-2024T10:00", "2024/03/05T1", "--/", "/", "-", ","]
    v = F.trim("t")
    plain = [F.try_to_date(F.substring_index(v, "T", 1), "yyyy-MM-dd")] + [F.try_to_date(v, f) for f in ("dd-MMM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MMM d, yyyy")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    one, two = F.coalesce(*plain), F.coalesce(*plain, F.try_to_date(v, "MM/dd/yyyy"))
    got = rows.select("t", S.parse_date(F.col("t")).cast("string").alias("a"), one.cast("string").alias("b"), R.record_date(F.col("t")).cast("string").alias("c"), two.cast("string").alias("d")).collect()
    assert [(r["t"], r["a"], r["c"]) for r in got] == [(r["t"], r["b"], r["d"]) for r in got] and sum(r["c"] is not None for r in got) >= 9


def test_a_text_of_a_batch_is_cleaned_once():
    import pandas as pd

    from noticelake.functions import text as T

    asked = []
    texts = pd.Series(["a", None, "b", "a", None], index=[3, 4, 5, 6, 9])
    found = T.each_once(texts, lambda t: asked.append(t) or f"<{t or ''}>")
    assert asked == ["a", None, "b"] and list(found) == ["<a>", "<>", "<b>", "<a>", "<>"] and list(found.index) == [3, 4, 5, 6, 9]
