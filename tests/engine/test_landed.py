"""Landed pages of a record a line, and how often a walk asks for them."""

import json

from noticelake.queries.ingest import landed_lines
from noticelake.sources import service as P


def test_a_page_is_read_by_line(spark, tmp_path):
    """All records of a page come, of however many files and whatever signs; one record is asked for without the rest of its page."""
    texts = [f"{i}   я \"x\"" for i in range(5000)]
    rows = spark.createDataFrame([(json.dumps({"id": t}, ensure_ascii=False), "all", 7) for t in texts], "value string, scope string, page long")
    rows.repartition(3).write.partitionBy("scope", "page").text(f"file://{tmp_path}/p")
    fetch = landed_lines(f"file://{tmp_path}/p", {0: 9})
    whole, one, none = (json.loads(fetch({}, *x)) for x in ((7, 100), (7, 1), (8, 100)))
    assert sorted(r["id"] for r in whole["notices"]) == sorted(texts) and len(one["notices"]) == 1 and one["notices"][0]["id"] in texts
    assert none["notices"] == [] and whole["total"] == one["total"] == none["total"] == 9


def test_a_slice_asks_for_a_page_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def fetch(filters, offset, rows):
        with open(log, "a") as f:
            f.write(f"{offset} {rows}\n")
        return json.dumps({"total": 40, "notices": [{"id": str(i)} for i in range(offset, min(offset + rows, 40))]})

    P.register(spark, "asked_once", P.Service(fetch, ("id",), "notices", rows=10, attempts=1))
    seen = []

    def apply(rows, number):
        seen.append((rows.count(), sorted(int(r["id"]) for r in rows.collect())))

    P.walk(spark, "asked_once", apply, f"file://{tmp_path}/c", 1)
    assert seen == [(40, list(range(40)))]
    assert sorted(x for x in open(log).read().split("\n") if x.endswith(" 10")) == ["0 10", "10 10", "20 10", "30 10"]
