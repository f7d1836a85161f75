"""Hostile markup, odd addresses, late rows, stated filters, gates and records, on small cases."""

import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F

from noticelake.functions import classify as K
from noticelake.functions import expressions as X
from noticelake.functions import scalars as S
from noticelake.functions import text as T
from noticelake.operators import vectors as V
from noticelake.plans import extraction as E
from noticelake.sources import files as L
from noticelake.sources import records as R
from noticelake.streaming import incremental as I


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


CLEANED = {
    "<p>Hello <b>world</b><br><ul><li>one</li></ul></p>": "<p>Hello <b>world</b><br><ul><li>one</li></ul></p>",
    "<p>ok</p><script>alert('xss')</script>": "<p>ok</p>",
    '<div onclick="steal()" onmouseover="x()" class=\'row\' style=\'color:red\'>text</div>': "<div>text</div>",
    '<a href="javascript:alert(1)">click</a>': "<a>click</a>",
    '<a href=" java\tscript&#58;alert(1)" title=\'a"b\'>x</a>': '<a title="a&quot;b">x</a>',
    "<a href=https://e.org>e</a>": '<a href="https://e.org">e</a>',
    '<a href="/docs?a=1&amp;b=2">d</a><a HREF="MAILTO:a@b.c">m</a><a href="data:text/html,x">y</a>': '<a href="/docs?a=1&amp;b=2">d</a><a href="MAILTO:a@b.c">m</a><a>y</a>',
    "<style>body{display:none}</style><iframe src='//evil'></iframe><template><b>t</b></template><p>hi</p>": "<p>hi</p>",
    '<img src=x onerror="alert(1)">': "",
    "<p/onclick=alert(1)>x</p>": "<p>x</p>",
    "a < b & c &copy; &bogus; &#8217;": "a &lt; b &amp; c &copy; &amp;bogus; &#8217;",
    "<scr<script></script>ipt>alert(1)</script>": "alert(1)",
    "<b>open <i>both": "<b>open <i>both</i></b>",
    "</p>stray</div>": "stray",
    "<p> &nbsp; </p><p><p></p></p>x": "x",
    "<!-- c --><h4>t</h4><h5>u</h5>": "<h4>t</h4>u",
    "a\n\n\n\n\tb": "a\n\n b",
    None: "",
    "": "",
}


def test_sanitizer_lets_no_markup_through(spark):
    assert dict(zip(CLEANED, column(spark, list(CLEANED), T.sanitize), strict=True)) == CLEANED
    assert [T.sanitized(x) for x in CLEANED.values()] == list(CLEANED.values())
    for cut in ("<img src=x onerror=alert(1) ", '<a href="javascript:x', "<p onclick=", "<script>alert(1)", "<style>x{", "<svg/onload=alert(1)>", "<math><mi//xlink:href='data:x'>"):
        out = T.sanitized(cut)
        assert "<" not in out.replace("<p>", "").replace("</p>", "").replace("<a>", "").replace("</a>", ""), out


def test_html_text_decodes_references(spark):
    values = ["caf&eacute; &#8217;x&#x27; &euro;5 &ndash;&nbsp;&nbsp;y", "<p>Hello   <b>world</b></p>", "<style>a</style>b<!-- c -->", None, "&amp;lt;"]
    assert column(spark, values, T.html_to_text) == ["café ’x' €5 – y", "Hello world", "b", None, "&lt;"]
    assert column(spark, ["<p>abc defg hij</p>"], lambda c: T.html_to_text(c, 9)) == ["abc defg…"]


def test_hosts_that_are_not_public(spark):
    good = ["http://example.org/x", "https://user:pw@example.org:8443/x?y", "HTTP://8.8.8.8/", "https://документы.рф/x", "http://172.32.0.1"]
    bad = [
        "http://a.b@10.0.0.1/x", "http://example.org@192.168.1.1", "http://100.64.0.1", "http://2130706433/", "http://0x7f.1/", "http://127.1", "http://[::1]/", "http://localhost.", "http://a.local/x",
        "http://169.254.169.254", "http://224.0.0.1", "ftp://example.org", "http://example", "http://10.0.0.1\\@example.org/", "", None, "http://017700000001", "http://172.31.9.9",
    ]
    assert column(spark, good, S.fetchable) == [True] * len(good)
    assert column(spark, bad, S.fetchable) == [False] * len(bad)


def test_a_refused_copy_hides_no_good_file(spark):
    rows = [("a.exe", b"x"), ("b.pdf", b"x"), ("c.pdf", b"x"), ("d.pdf", b""), ("e.pdf", b"long enough")]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert {r.path: r.refusal for r in L.intake(df, ("pdf",), 8).collect()} == {"a.exe": "suffix", "b.pdf": None, "c.pdf": "repeated", "d.pdf": "empty", "e.pdf": "size"}


def test_upsert_takes_the_last_row_of_a_key(spark):
    kind = "k long, v string, h string, at int"
    old = spark.createDataFrame([(1, "a", "h1", 5), (4, "d", "h9", 1)], kind)
    new = spark.createDataFrame([(2, "x", "h2", 1), (2, "y", "h3", 2), (1, "late", "h4", 4), (4, "e", "h8", 1), (None, "n", "h5", 9), (4, "same", "h9", 0)], kind)
    assert sorted(map(tuple, I.upsert(old, new, "k", "h", "at").collect())) == [(1, "a", "h1", 5), (2, "y", "h3", 2), (4, "e", "h8", 1)]
    assert sorted(r.k for r in I.upsert(old, new, "k", "h").collect()) == [1, 2, 4]


def test_stated_filters_of_similar_contracts(spark):
    start = "Experience in similar contracts of at least two (2) contracts"
    texts = [
        f"{start} of USD 5,000,000 or EUR 1 million within the last ten (10) years.",
        f"{start} within the last five (5) years (2016-2025).",
        f"{start}.",
        "Bid security of USD 2,000 is asked for. Nothing else.",
    ]
    docs = spark.createDataFrame([(i, t, 2026) for i, t in enumerate(texts)] + [(9, texts[0], None)], "doc_id long, text string, year int")
    got = {r.doc_id: (r.key, r.value, r.least_amount, r.from_year, r.mandatory) for r in T.requirements(docs).collect()}
    count = "similar_contracts_count"
    assert got == {
        0: (count, 2.0, 1_000_000.0, 2017, True), 1: (count, 2.0, None, 2016, True), 2: (count, 2.0, None, None, True),
        3: ("bid_security", 2000.0, None, None, False), 9: (count, 2.0, 1_000_000.0, None, True),
    }


def test_families_in_two_languages(spark):
    texts = {
        "master's degree and 10 years of experience, key experts": {"experience_years", "key_experts", "education"},
        "Высшее образование, опыт работы не менее 5 лет": {"threshold", "experience_years", "education"},
        "должен иметь лицензию; краткий список; годовой оборот": {"obligation", "credential", "shortlist", "financial"},
        "Nothing of the kind": set(),
        "квалификация, критерии отбора, ключевые эксперты": {"qualification", "eligibility", "key_experts"},
    }
    for name, pattern in K.MARKERS.items():
        assert column(spark, list(texts), lambda c, p=pattern: c.rlike(p)) == [name in want for want in texts.values()], name


def test_gate_and_slices(spark):
    docs = spark.createDataFrame([(1, "Firms must show turnover."), (2, "The annual turnover shall be known."), (3, "Nice weather. It rains."), (4, None)], "doc_id long, text string")
    known = spark.createDataFrame([(2, "annual_turnover_avg")], "doc_id long, key string")
    assert [r.doc_id for r in E.worth_asking(docs, known).collect()] == [1]
    assert sorted(r.doc_id for r in E.worth_asking(docs, known.limit(0)).collect()) == [1, 2]
    text = "Nothing is said here at all. " * 300
    long = text + "Firms must have turnover of at least USD 5. " + text + "A certificate is required. " + text
    docs = spark.createDataFrame([(1, "Firms must have turnover."), (2, long), (3, text), (4, "turnover"), (5, "shall have a certificate, bad")], "doc_id long, text string")
    kept = {(r.doc_id, r.position): (r.total, r.score) for r in E.slices(docs, whole=5000).collect()}
    assert kept[1, 1] == (1, 2) and {d for d, _ in kept} == {1, 2, 5}
    assert [s for (d, _), (_, s) in sorted(kept.items()) if d == 2] == [3]

    def model(body, keys):
        if "bad" in body:
            raise ValueError
        return [{"key": "a", "value": 1.0, "quote": body[:5]}, {"key": "a", "value": 1.0, "quote": body[:5]}, {"key": "held", "quote": "x"}]

    known = spark.createDataFrame([(1, "held")], "doc_id long, key string")
    got = sorted((r.doc_id, r.key or "", r.problem or "") for r in E.read_slices(docs, known, model, whole=5000).collect())
    assert got == [(1, "a", ""), (2, "a", ""), (2, "held", ""), (5, "", "ValueError")]


def test_routes_by_scope_and_language(spark):
    rows = [
        ("What is the deadline?", False, 0, "deep", "analysis:unscoped"), ("What is the deadline?", True, 3, "fast", "lookup:word"), ("Nega muddat uzaytirildi?", True, 0, "deep", "analysis:word"),
        ("Какой срок?", True, 1, "fast", "lookup:word"), ("Сравните сроки", True, 0, "deep", "analysis:word"), ("Tell me about it", True, 0, "fast", "lookup:scoped_opener"),
        ("Tell me about it", True, 2, "deep", "analysis:default"), ("so " * 26 + "deadline", True, 0, "deep", "analysis:length"), (None, None, None, "deep", "analysis:default"), ("mosque", True, 1, "deep", "analysis:default"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, q string, s boolean, h int")
    got = [tuple(r.r) for r in df.select("i", K.route(F.col("q"), F.col("s"), F.col("h")).alias("r")).orderBy("i").collect()]
    assert got == [r[3:] for r in rows]


def test_records_fail_soft(spark):
    full = {"id": "OP1", "notice_type": ["Request", None, "x"], "noticedate": "22-Jul-2026", "submission_deadline_date": "2026-08-12T00:00:00Z", "submission_deadline_time": "17:00", "project_ctry_name": "Uz", "notice_text": "<p>Body</p><script>alert(1)</script>"}
    raw = [json.dumps(full), json.dumps(dict(reversed(full.items()))), json.dumps({"id": "OP2", "noticedate": "garbage", "notice_type": "None"}), json.dumps({"id": " "}), "no json", None]
    df = spark.createDataFrame([(r,) for r in raw], "record string")
    got = R.map_notices(df, zones={"Uz": "Asia/Tashkent"}).collect()
    assert sorted(r.notice_id for r in got) == ["OP1", "OP1", "OP2"]
    one, two = [r for r in got if r.notice_id == "OP1"]
    assert one == two and one.notice_type == "Request x" and one.notice_date == datetime.date(2026, 7, 22) and one.notice_text_sanitized == "<p>Body</p>"
    assert one.deadline_at == datetime.datetime(2026, 8, 12, 12, 0)
    other = next(r for r in got if r.notice_id == "OP2")
    assert (other.notice_type, other.notice_date, other.deadline_at, other.notice_text_raw) == ("", None, None, "")
    projects = spark.createDataFrame([(json.dumps({"id": "P1", "totalamt": "20,000,000", "sector": [{"Name": "A"}, {"name": "b"}, "c", {"x": 1}, None], "theme": "odd"}),)], "record string")
    p = R.map_projects(projects).first()
    assert (p.project_id, str(p.total_amount_usd), p.sectors, p.themes, p.closing_date) == ("P1", "20000000.00", ["A", "b", "c"], [], None)


def test_ids_links_and_explanations(spark):
    got = spark.createDataFrame([("doc:1", "s0"), ("doc:2", "p1")], "a string, b string").select("a", "b", S.point_id(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r.x == str(uuid.uuid5(S.POINTS, f"{r.a}|{r.b}")) for r in got)
    assert column(spark, ["Koji Nishida", "J. van der Berg", "Cher", "", None], lambda c: S.author_url(c, "b")) == ["b/k/koji-nishida", "b/v/van-berg", "", "", ""]
    assert [tuple(x) for x in column(spark, ["1,250.50", "yes", " x ", "", "1,2"], S.draft_value)] == [("number", "1250.50"), ("boolean", "true"), ("text", "x"), ("none", None), ("text", "1,2")]
    node = {"kind": "any", "children": [{"kind": "scalar", "key": "a", "op": ">=", "value": 5}, {"kind": "not", "child": {"kind": "exists", "entity": "e", "where": [{"field": "f", "op": "==", "value": "x"}]}}]}
    df = spark.createDataFrame([({"a": "4"}, {"e": [{"f": None}]})], "scalars map<string,string>, collections map<string,array<map<string,string>>>")
    r = df.select(X.explain(node).alias("l"), X.absent(node).alias("m")).first()
    assert r.l == ["[UNKNOWN] any of", "  [FAILED] a >= 5", "  [UNKNOWN] not", "    [UNKNOWN] some e where f == x"] and r.m == ["e.f"]


def test_fresh_notices_come_before_the_budget(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(1, True, False, None), (2, False, True, day(1)), (3, False, True, None), (4, False, True, day(9)), (5, False, False, None), (6, False, True, day(2))]
    df = spark.createDataFrame(rows, "id long, fresh boolean, open boolean, computed_at timestamp")
    got = sorted((r.id, r.tier) for r in V.due_for_neighbours(df, F.lit("2024-01-05").cast("timestamp"), 2).collect())
    assert got == [(1, 0), (2, 1), (3, 1)]
