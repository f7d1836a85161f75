"""Searches that ask once: by the texts themselves, without an index of places."""

import random
import re

from pyspark.sql import functions as F

from noticelake import catalog
from noticelake.functions import text as T
from noticelake.operators import fulltext as FT
from noticelake.queries.rollups import quoted
from noticelake.session import scratch

TEXTS = ["Bridges and roads", "roads roads and THE bridge", None, "", "water 12 for all", "and bridges"]


def test_texts_answer_as_their_index_does(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (0, "other water")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "roads and bridges"), (2, "Water 12"), (3, "nothing"), (4, None)], "qid long, text string")
    rows = lambda source: sorted(map(tuple, FT.lexical(asked, source, 3).collect()))
    got = rows(FT.Texts(docs))
    assert got == rows(FT.build(docs, scratch(spark, "texts"))) and got[0] == (1, 0, 1.0, 1)


def test_every_item_is_asked_and_no_pair_is_dealt(spark):
    found = catalog.queries()["lexical_overlap"](spark, "/root/testdata/sf0.001")
    items = {r.item_id for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id").collect()}
    assert {r.qid for r in found.collect()} == items and " % 100" not in catalog.oracle_sql()["lexical_overlap"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" not in "".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan))


def test_best_of_tasks_are_the_best_of_all(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [a + b + c for a in "abcd" for b in "xyz" for c in "xyz"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = spark.createDataFrame([(None if i % 97 == 5 else i % 350, text(rng.randrange(12))) for i in range(400)], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, text(i % 9)) for i in range(40)], "qid long, text string")
    expected = sorted(map(repr, FT.lexical(asked, FT.build(docs, scratch(spark, "best")), 7).collect()))
    for at_once in (4_096, 11):
        monkeypatch.setattr(FT, "QUERIES_AT_ONCE", at_once)
        assert sorted(map(repr, FT.lexical(asked, FT.Texts(docs), 7).collect())) == expected
    assert FT.lexical(asked.limit(0), FT.Texts(docs), 7).collect() == []


def test_long_quotes_ask_no_index(spark):
    docs = spark.createDataFrame([(1, "say one two three four five then"), (2, "one two")], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, "one two three four five"), (8, "one TWO")], "item_id long, quote string")

    def index():
        raise AssertionError("no quote needs it")

    assert sorted(map(tuple, quoted(docs, quotes, index).collect())) == [(7, 1), (8, 1), (8, 2)]


def test_stems_are_those_of_the_patterns(spark):
    ends = ["ies", "aies", "eies", "es", "aes", "ees", "oes", "s", "us", "ss", "y", "ties", "Ies"]
    words = [(head + x,) for head in ("", "a", "ab", "abc") for x in ends]
    t = F.col("w")
    long = F.length(t) > 3
    ies, es = long & t.rlike("ies$") & ~t.rlike("[ea]ies$"), long & t.rlike("es$") & ~t.rlike("[aeo]es$")
    s = long & t.rlike("s$") & ~t.rlike("(us|ss|es)$")
    plain = F.when(ies, F.regexp_replace(t, "ies$", "y")).when(es | s, F.regexp_replace(t, "s$", "")).otherwise(t)
    assert spark.createDataFrame(words, "w string").where(plain != FT.stem(t)).collect() == []


def test_batches_of_long_texts_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        T.long_chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
        assert int(spark.conf.get(name)) <= 256
        spark.conf.set(name, "10000")
        catalog.queries()["resanitise_report"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(name)) <= 256
    finally:
        spark.conf.set(name, before)
