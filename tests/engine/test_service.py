"""The paged service as a data source: pushed filters, ends, errors, and a walk that is cut off and goes on."""

import json

import pytest
from pyspark.sql import functions as F

from noticelake.sources import service as P

ROWS = [{"id": f"n{i:03}", "country": ("A", "B", "C")[i % 3], "date": f"2024-{i % 12 + 1:02}-01", "n": i} for i in range(130)]


def fetcher(log: str, told: bool = True, fails: str = "", cap: int | None = None):
    """A service over ROWS that notes what it is asked, and fails where the file ``fails`` names an offset."""

    def fetch(filters: dict, offset: int, rows: int) -> str:
        import os

        with open(log, "a") as f:
            f.write(json.dumps([filters, offset, rows]) + "\n")
        if fails and os.path.exists(fails) and json.loads(open(fails).read()) == [filters, offset]:
            return '{"error": "limit"}'
        found = [r for r in ROWS if all({"country": r["country"] == v, "part": r["n"] % 2 == int(v) if k == "part" else True, "date_from": r["date"] >= v, "date_to": r["date"] <= v}.get(k, True) for k, v in filters.items())]
        if cap is not None and offset >= cap:
            return '{"error": "offset"}'
        page = {"rows": found[offset : offset + rows]}
        return json.dumps(page | {"total": str(len(found))} if told else page)

    return fetch


def asked(log) -> list:
    return [json.loads(x) for x in open(log)]


@pytest.mark.parametrize("told", [True, False])
def test_filters_go_with_the_request_and_other_pages_are_not_fetched(spark, tmp_path, told):
    log = str(tmp_path / "log")
    P.register(spark, f"pages_{told}", P.Service(fetcher(log, told), ("id", "country", "date"), "rows", ("date",), rows=10))
    df = spark.read.format(f"pages_{told}").load().where("country = 'B' AND date >= '2024-06-01'").where(F.get_json_object("record", "$.n").cast("int") > 20)
    expected = sorted(r["id"] for r in ROWS if r["country"] == "B" and r["date"] >= "2024-06-01" and r["n"] > 20)
    assert sorted(r["id"] for r in df.select("id").collect()) == expected
    assert {tuple(sorted(x[0].items())) for x in asked(log)} == {(("country", "B"), ("date_from", "2024-06-01"))}
    matching = sum(r["country"] == "B" and r["date"] >= "2024-06-01" for r in ROWS)
    assert max(x[1] for x in asked(log)) < matching + 10  # an empty page at most behind the last one
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("Filter") :].split("\n")[0]
    assert "get_json_object" in left and "country" not in left and "date" not in left


def test_failed_pages_are_seen_through_pushed_filters(spark, tmp_path):
    (tmp_path / "fails").write_text(json.dumps([{"country": "B"}, 10]))
    P.register(spark, "pages_seen", P.Service(fetcher(str(tmp_path / "log"), True, str(tmp_path / "fails")), ("id", "country"), "rows", rows=10, attempts=1))
    rows = spark.read.format("pages_seen").load().where("country = 'B'").collect()
    assert [r["page"] for r in rows if r["error"]] == [10] and len(rows) == sum(r["country"] == "B" for r in ROWS) - 10 + 1


def test_a_page_that_fails_is_a_row_and_ends_nothing(spark, tmp_path):
    (tmp_path / "fails").write_text(json.dumps([{}, 20]))
    P.register(spark, "pages_fail", P.Service(fetcher(str(tmp_path / "log"), True, str(tmp_path / "fails")), ("id",), "rows", rows=10, attempts=2, tasks=3))
    rows = spark.read.format("pages_fail").load().collect()
    assert [r["page"] for r in rows if r["error"]] == [20] and len({r["id"] for r in rows if r["id"]}) == 120
    assert sum(x[1] == 20 for x in asked(tmp_path / "log")) == 2


def _walk(spark, tmp_path, name, slices, kept):
    return P.walk(spark, name, lambda rows, number: kept.extend((number, r["id"]) for r in rows.collect()), f"file://{tmp_path}/c", slices)


def test_a_walk_that_is_cut_off_goes_on_and_divides(spark, tmp_path):
    log, fails = str(tmp_path / "log"), tmp_path / "fails"
    divide = lambda scope: [scope | {"part": str(k)} for k in (0, 1)] if "part" not in scope else []
    service = P.Service(fetcher(log, True, str(fails), 30), ("id", "country"), "rows", rows=10, cap=30, scopes=({"country": "A"}, {"country": "B"}), divide=divide, pages=2, attempts=1)
    P.register(spark, "walk", service)
    kept: list = []
    fails.write_text(json.dumps([{"country": "B"}, 20]))
    assert _walk(spark, tmp_path, "walk", 1, kept) == 1 and len(kept) == 40
    # a new session of the walk goes on at its offsets; the page that fails stays where it is
    P.register(spark, "walk", service)
    _walk(spark, tmp_path, "walk", 9, kept)
    ids = [i for _, i in kept]
    assert {r["id"] for r in ROWS if r["country"] == "A"} <= set(ids)  # both halves, though the scope itself ends at its cap
    b = [r["id"] for r in ROWS if r["country"] == "B"]
    assert set(ids) & set(b) == set(b[:20])
    fails.unlink()
    P.register(spark, "walk", service)
    _walk(spark, tmp_path, "walk", 9, kept)
    assert {i for _, i in kept} == {r["id"] for r in ROWS if r["country"] in "AB"}
    before = len(asked(log))
    assert _walk(spark, tmp_path, "walk", 9, kept) == 0 and len(asked(log)) == before  # nothing open: nothing is asked
    offsets = [(json.dumps(x[0], sort_keys=True), x[1]) for x in asked(log) if x[2] == 10]
    assert len(offsets) == len(set(offsets))  # every page was read once
