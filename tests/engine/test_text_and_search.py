"""Text, selection, sources and incremental jobs on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from noticelake.functions import awards as A
from noticelake.functions import scalars as S
from noticelake.functions import text as T
from noticelake.operators import ordering as O
from noticelake.operators import vectors as V
from noticelake.sources import files as L
from noticelake.sources import paged
from noticelake.streaming import incremental as I

AWARD = (
    "<div><p>Awarded Bidder(s):<br>METAG TICARET (851176)<br>Konutkent Mah. ANKARA<br>Country: Turkiye<br>\"YASHIL\" LLC (1066189)<br>Nasaf street<br>Country: Uzbekistan<br>"
    "Bid Price at Opening<br>USD<br>Signed Contract price<br>USD 9,613,518.63</p><p>Beneficial Ownership Details<br>METAG TICARET (851176)</p>"
    "<p>Evaluated Bidder(s):<br>2-SON MKK (882180)<br>Country: Uzbekistan<br>Evaluated Bid Price<br>USD 9014065.00</p><p>Rejected Bidder(s):<br>FAYZ (1057031)<br>Country: Uzbekistan<br>Evaluated Bid Price<br>USD</p></div>"
)


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clocks(spark):
    values = ["17:00", "17.00", "1700", "5:00 PM", "12:00 AM", "", None, "25:00", "9"]
    assert column(spark, values, S.clock_minutes) == [1020, 1020, 1020, 1020, 0, None, None, None, 540]


def test_sentences_and_passages(spark):
    text = "See No. 5 of the list. It is long (very)! Is it? yes. (Really) so. End"
    assert column(spark, [text], T.sentences)[0] == ["See No. 5 of the list.", "It is long (very)!", "Is it? yes.", "(Really) so.", "End"]
    assert T.pack([5, 5, 5, 20, 1], 10) == [[0, 1], [2], [3], [4]]
    assert T.pack([4, 4, 4], 9, 1) == [[0, 1], [1, 2]]
    docs = spark.createDataFrame([(1, "A first one is here. " * 60), (2, ""), (3, None), (4, "x" * 2000)], "doc_id long, text string")
    got = T.chunks(docs).collect()
    assert {r.doc_id for r in got} == {1, 4}
    assert all(r.content == ("A first one is here. " * 60)[r.char_start : r.char_end] for r in got if r.doc_id == 1)


def test_canonical():
    raw = "<p>It&rsquo;s &amp;nbsp; here</p><div>“Two”  ﬁles</div>.."
    assert T.canonical_text(raw) == 'It\'s here. "Two" files.'
    assert T.canonical_text(None) == ""


def test_awards(spark):
    df = spark.createDataFrame([(1, AWARD), (2, ""), (3, None)], "notice_id long, html string")
    got = {(r.role, r.name): (r.reference, r.country, r.currency, r.price and float(r.price)) for r in A.bidders(df).collect()}
    assert got == {
        ("awardee", "METAG TICARET"): ("851176", "Turkiye", None, None),
        ("awardee", '"YASHIL" LLC'): ("1066189", "Uzbekistan", "USD", 9613518.63),
        ("evaluated", "2-SON MKK"): ("882180", "Uzbekistan", "USD", 9014065.0),
        ("rejected", "FAYZ"): ("1057031", "Uzbekistan", "USD", None),
    }


def test_contacts_and_links(spark):
    text = "Write to Info@Bank.org. Phone +998 71 120-11-22. Or info@bank.org or x@y.uz; ToR: https://a.b/c_(d)). see https://a.b/c_(d)"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {(r.email, r.phone) for r in T.contacts(df).collect()} == {("info@bank.org", "+998 71 120-11-22"), ("x@y.uz", None)}
    assert {(r.email) for r in T.contacts(df, F.lit("X@y.uz")).collect()} == {"info@bank.org"}
    assert [(r.url, r.kind) for r in T.links(df).collect()] == [("https://a.b/c_(d)", "tor")]


def test_fusion_is_a_function_of_rank(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 13, 2)], "qid long, id long, rank int")
    got = [(r.id, r.retrieval) for r in V.fuse([("dense", a), ("lexical", b)]).orderBy("place").collect()]
    assert got == [(12, "hybrid"), (10, "dense"), (11, "dense"), (13, "lexical")]


def test_selection_drops_copies_and_fourth_passages(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    rows = [(1, 1, "n", 1, words), (1, 2, "m", 2, words + " 12"), (1, 3, "n", 3, "short one"), (1, 4, "n", 4, "another short"), (1, 5, "n", 5, "third"), (1, 6, "o", 6, "short one")]
    df = spark.createDataFrame(rows, "qid long, doc_id long, notice string, rank int, text string")
    assert [r.doc_id for r in V.select_passages(df, 10).orderBy("place").collect()] == [1, 3, 4, 6]


def test_rerank_survives_its_scorer(spark):
    df = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "bbb"), (1, 3, 3, "cc")], "qid long, doc_id long, rank int, text string")

    def broken(texts):
        raise RuntimeError

    order = lambda f: [r.doc_id for r in V.rerank(df, f, 3).orderBy("rank").collect()]
    assert order(None) == [1, 2, 3] and order(broken) == [1, 2, 3]
    assert order(lambda texts: [len(t) for t in texts]) == [2, 3, 1]


def test_pages_with_a_failure(spark):
    bodies = {0: {"r": [{"a": 1}, {"a": 2}]}, 2: {"error": "limit"}, 4: {"r": [{"a": 5}]}}

    def fetch(offset, rows):
        return json.dumps(bodies[offset])

    got = paged.read_pages(spark, fetch, 5, 2, "r", 1).collect()
    assert sorted(json.loads(r.record)["a"] for r in got if r.record) == [1, 2, 5]
    assert [(r.offset, "limit" in r.error) for r in got if r.error] == [(2, True)]


def test_envelope_and_keyset(spark):
    df = spark.range(45)
    env = O.envelope(df, ["-id"], 3, 20)
    assert (env["count"], env["total_pages"], env["next"], env["previous"], len(env["results"])) == (45, 3, None, 2, 5)
    assert O.envelope(df.limit(0), ["id"])["total_pages"] == 1
    assert [(r.id, r.has_more) for r in O.keyset(df, "id", 3, 5).orderBy("id").collect()] == [(0, False), (1, False), (2, False)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "k long, v string, h string")
    new = spark.createDataFrame([(2, "B", "h3"), (3, "c", "h4"), (None, "x", "h5")], "k long, v string, h string")
    once = I.upsert(old, new, "k", "h")
    twice = I.upsert(once, new, "k", "h")
    assert sorted(map(tuple, once.collect())) == [(1, "a", "h1"), (2, "B", "h3"), (3, "c", "h4")]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    assert {r.action for r in I.changes(once, new, "k", "h").collect()} == {"unchanged", "skipped"}


def test_blobs_once(spark, tmp_path):
    df = spark.createDataFrame([(b"one",), (b"two",), (b"one",)], "content binary")
    got = L.write_blobs(df, f"file://{tmp_path}/blobs").collect()
    assert len(got) == 2 and all((tmp_path / "blobs" / r.name).stat().st_size == r.size for r in got)
    assert len(L.write_blobs(df, f"file://{tmp_path}/blobs").collect()) == 2


@pytest.mark.parametrize("raw, want", [("20,000,000", "20000000.00"), ("$5", "5.00"), ("", None), ("about 5", None)])
def test_money_strings(spark, raw, want):
    got = column(spark, [raw], S.parse_money)[0]
    assert (None if got is None else str(got)) == want
