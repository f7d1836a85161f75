"""Awards, contacts, links, cuts and canonical text on hand-made bodies, and intervals against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from noticelake.functions import awards as A
from noticelake.functions import contacts as C
from noticelake.functions import text as T
from noticelake.functions.spans import cut, spans

JOINT = (
    "<p>Evaluated Bidder(s):<br>2-SON (882180)<br>Samarkand<br>Country: Uzbekistan<br>FOROUZANDEH (1066186)<br>5th floor<br>Country: Iran, Islamic Republic of<br>Evaluation Scores<br>Bid Price at Opening<br>USD<br>"
    "Evaluated Bid Price<br>USD 9,014,065.00</p><p>Rejected Bidder(s):<br>FAYZ LLC (1057031)<br>-<br>Registry ID<br>77<br>Country: Uzbekistan<br>Evaluated Bid Price<br>USD<br>Reason for Rejection<br>Non Responsive (2024)</p>"
    "<p>Awarded Bidder(s):<br>METAG &amp; Co (851176)<br>Konutkent Mah. No : 6/29<br>Ankara<br>Country: Turkiye<br>&quot;YASHIL&quot; LLC (1066189)<br>Nasaf street<br>Country: Uzbekistan<br>Signed Contract price<br>USD 9613518.63</p>"
    "<p>Beneficial Ownership Details<br>METAG &amp; Co (851176)<br>Name<br>Ahmet Agca</p>"
)
SMALL = "<p>Contract Signature Date<br>2024/2/9<br>Awarded Firm/Individual:<br>PRICEWATERHOUSECOOPERS<br>Price:<br>Currency:<br>Amount:<br>Kyrgyzstan Som (Kyrgyzstan Som)<br>1,234.50</p>"
ALONE = "<p>Awarded Firm(s):<br>Individual Consultant<br>Country: Chad<br>Price:<br>Currency:<br>Amount:<br>Euro (of the Union)<br>10</p>"
NAMED = "<p>Awarded Bidder(s):<br>Name: Alke A.S.<br>Address:<br>Country: Turkey<br>Bid Price at Opening: USD 7,384,272.25<br>Evaluated Bid Price: USD 7,384,272.00<br>Evaluated Bidder(s):<br>Name: JV Runner Up Ltd<br>Country: Kazakhstan</p>"


@pytest.fixture(scope="module")
def bodies(spark):
    return spark.createDataFrame([(1, JOINT), (2, SMALL), (3, ALONE), (4, NAMED), (5, "<p>Contract Award</p>"), (6, None), (7, "")], "notice_id long, html string")


def test_bidders_of_both_templates_in_any_order(bodies):
    found = {}
    for r in A.bidders(bodies).collect():
        found.setdefault(r["notice_id"], {})[r["role"], r["place"]] = (r["name"], r["reference"], r["address"], r["country"], r["currency"], r["price"] and float(r["price"]), r["reason"])
    assert found[1] == {
        ("evaluated", 1): ("2-SON", "882180", "Samarkand", "Uzbekistan", None, None, ""), ("evaluated", 2): ("FOROUZANDEH", "1066186", "5th floor", "Iran, Islamic Republic of", "USD", 9014065.0, ""),
        ("rejected", 1): ("FAYZ LLC", "1057031", "", "Uzbekistan", "USD", None, "Non Responsive (2024)"),
        ("awardee", 1): ("METAG & Co", "851176", "Konutkent Mah. No : 6/29\nAnkara", "Turkiye", None, None, ""), ("awardee", 2): ('"YASHIL" LLC', "1066189", "Nasaf street", "Uzbekistan", "USD", 9613518.63, ""),
    }
    assert found[2] == {("awardee", 1): ("PRICEWATERHOUSECOOPERS", "", "", "", None, None, "")}
    assert found[3][("awardee", 1)][:4] == ("Individual Consultant", "", "", "Chad")
    assert {k: v[0] for k, v in found[4].items()} == {("awardee", 1): "Alke A.S.", ("evaluated", 1): "JV Runner Up Ltd"}
    assert found.keys() == {1, 2, 3, 4}


def test_summaries(bodies):
    s = {r["notice_id"]: r for r in A.summaries(bodies).collect()}
    money = lambda r: tuple(None if r[c] is None else float(r[c]) for c in ("bid_price_opening", "evaluated_price", "contract_price"))
    assert (s[1]["supplier_name"], s[1]["supplier_country"], s[1]["currency"], money(s[1]), s[1]["useful"]) == ("METAG & Co", "Turkiye", "USD", (None, 9014065.0, 9613518.63), True)
    assert (s[2]["supplier_name"], s[2]["currency"], money(s[2]), str(s[2]["award_date"])) == ("PRICEWATERHOUSECOOPERS", "Kyrgyzstan Som", (None, None, 1234.5), "2024-02-09")
    assert (s[3]["supplier_name"], s[3]["supplier_country"], s[3]["currency"], money(s[3]), s[3]["useful"]) == ("", "", "Euro (of the Union)", (None, None, 10.0), True)
    assert (s[4]["supplier_name"], money(s[4]), s[4]["currency"]) == ("Alke A.S.", (7384272.25, 7384272.0, None), "USD")
    assert [s[k]["useful"] for k in (5, 6, 7)] == [False] * 3 and len(s) == 7


def test_people_own_the_text_up_to_the_next(spark):
    text = (
        "Expressions of interest must be delivered to the address below. Attn: Mr. Mirodil Khusanov - Project Coordinator 27, Nazim str. Tel: +998 71 239-59-76 E-mail: pmu@ihma.uz; m.xusanov@ihma.uz; a.rossi@ihma.uz. "
        "To: Satori D.A. - PMU Director Phone number: (99412) 5253449 and 12345678901. " + "x" * 500 + " late@firm.org; M.XUSANOV@ihma.uz. For further information write to &lt;ask@firm.org&gt; or To: The Office."
    )
    rows = C.body_contacts(spark.createDataFrame([(1, text), (2, None), (3, "no one")], "doc_id long, text string")).orderBy("place").collect()
    assert [(r["name"], r["role"], r["email"], r["others"], r["phone"], r["purpose"]) for r in rows] == [
        ("Mirodil Khusanov", "Project Coordinator", "pmu@ihma.uz", ["m.xusanov@ihma.uz"], "+998 71 239-59-76", "submission"), ("Satori D.A.", "PMU Director", "", [], "(99412) 5253449", "submission"),
        ("", "", "a.rossi@ihma.uz", [], "", "submission"), ("", "", "late@firm.org", [], "", ""), ("", "", "ask@firm.org", [], "", "enquiry"),
    ]
    found = C.body_contacts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    primary = spark.createDataFrame([(1, "KHUSANOV Mirodil", "PMU@ihma.uz", "+99871 2395976")], "doc_id long, name string, email string, phone string")
    kept = [(r["name"], r["email"], r["phone"], r["same_as_primary"]) for r in C.beside_primary(found, primary).orderBy("place").collect()]
    assert kept[0] == ("Mirodil Khusanov", "m.xusanov@ihma.uz", "", True) and kept[1] == ("Satori D.A.", "", "(99412) 5253449", False) and len(kept) == 5


def test_intervals_equal_plain_loops(spark):
    r, docs = random.Random(5), []
    for k in range(60):
        parts = [r.choice(["Attn: Ivan Petrov, ", "Contact: Anna Lee. ", "a.lee@x.org ", "office@x.org ", "ivan.petrov@y.org, ", "b.stone@z.org; ", "Tel: +998 71 2345678 ", "word " * r.randrange(1, 130)]) for _ in range(r.randrange(1, 14))]
        docs.append((k, "".join(parts)))
    found = {}
    for x in C.body_contacts(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        found.setdefault(x["doc_id"], []).append((x["place"], x["name"], [e for e in [x["email"], *x["others"]] if e], x["phone"]))
    for k, text in docs:
        people = [[m[1], m.start(), m.end(), [], ""] for m in re.finditer(r"(?:Attn|Contact): (Ivan Petrov|Anna Lee)", text)]
        for i, p in enumerate(people):
            p[2] = min(people[i + 1][1] if i + 1 < len(people) else len(text), p[2] + 420)
        for m in re.finditer(r"Tel: (\+998 71 2345678)", text):
            for p in people:
                if p[1] <= m.start() < p[2] and not p[4]:
                    p[4] = m[1]
                    break
        alone, seen = [], set()
        for m in re.finditer(r"[\w.]+@\w+\.org", text):
            if m[0] in seen:
                continue
            seen.add(m[0])
            own = next((p for p in people if p[1] <= m.start() < p[2]), None)
            if own and (m[0] == "office@x.org" or own[0].split()[1].lower() in m[0]):
                own[3].append(m[0])
            else:
                alone.append(m[0])
        expected = [(p[0], p[3], p[4]) for p in people if p[3] or p[4]] + [("", [e], "") for e in alone]
        assert [x[1:] for x in sorted(found.get(k, []))] == expected


def test_every_place_of_a_link_is_judged(spark):
    far = " and more" * 40
    text = f"https://e.org/a/b said first. The Terms of Reference: https://e.org/a?x=1&amp;y=2{far} see https://e.org/a, then{far} bidding documents at https://e.org/a."
    found = {r["url"]: r["kind"] for r in T.links(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert found == {"https://e.org/a/b": "other", "https://e.org/a?x=1&y=2": "tor", "https://e.org/a": "bidding"}


def test_tor_addresses(spark):
    rows = [("Send to a@b.org. " + "x " * 150 + "The TOR is at t@b.org.", "t@b.org", True), ("Terms of\nreference: see c@d.org", "c@d.org", True), ("c@d.org has Terms of Reference", "", True), ("store c@d.org", "", False), (None, "", False)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "i long, t string")
    got = df.select("i", C.tor_address(F.col("t")).alias("a"), C.mentions_tor(F.col("t")).alias("m")).orderBy("i").collect()
    assert [(r["a"], r["m"]) for r in got] == [(a, m) for _, a, m in rows]


def test_nothing_is_lost_at_a_cut(spark):
    long = "w" * 30_000
    df = spark.createDataFrame([(long, "one two " + long, f"<p>{long}</p>", f"{long}. Next one.")], "a string, b string, c string, d string")
    r = df.select(cut(F.col("a"), 50, "…").alias("a"), cut(F.col("b"), 50, "…").alias("b"), T.html_to_text(F.col("c"), 50).alias("c"), T.compress(F.col("a"), F.lit(""), 50).alias("e"), T.bounded(F.col("d"), 20_000).alias("d")).first()
    assert r["a"] == "w" * 49 + "…" and r["b"] == "one two…" and r["c"] == r["a"] and r["e"] == "w" * 48 + " …"
    assert (r["d"]["text"], r["d"]["kept"], r["d"]["total"]) == (long + ".", 1, 2)
    texts = ["", "One. Two. Three", "A" * 12 + ". Bc. D"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.bounded(F.col("t"), 9).alias("b")).orderBy("i").collect()
    assert [(x["b"]["text"], x["b"]["kept"], x["b"]["total"]) for x in got] == [("", 0, 0), ("One. Two.", 2, 3), ("A" * 12 + ".", 1, 3)]


def test_canonical_text_has_no_footnote_marks():
    assert T.canonical_text("<p>joint venture member[1] of two[12]</p>[123] x") == "joint venture member of two. [123] x"


def test_references_are_decoded_once(spark):
    rows = ["a &amp; b &lt;c&gt; &copy; &#39;x&#39;", "&amp;lt; stays", "&eacute; &#233; &#xe9; &amp;", "&unknown; &", None, "AT&T &c. x&y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string")
    import html

    got = [r["x"] for r in df.select("i", T.decoded(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [None if t is None else html.unescape(t) for t in rows]


def test_long_units_are_cut_at_items(spark):
    text = "The firm shall have: (a) ten years of work (b) two contracts; (c) a licence 1. one more 2) and the last " + "z" * 50
    spans_ = T.unit_spans(text, [text], 40)
    assert "".join(text[a:b] for a, b in spans_) == text and all(b - a <= 40 for a, b in spans_)
    assert [text[a:b].strip() for a, b in spans_][:5] == ["The firm shall have:", "(a) ten years of work", "(b) two contracts; (c) a licence", "1. one more", "2) and the last"]


def test_spans_are_those_of_the_pattern(spark):
    texts = ["", "a1b22c", "11", "x", None, "1 1 1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [[(s["start"], s["stop"], s["text"]) for s in r["s"]] for r in df.select("i", spans(F.col("t"), r"\d+").alias("s")).orderBy("i").collect()]
    assert got == [[(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", t or "")] for t in texts]


def test_a_sheet_of_a_notice(spark):
    from noticelake.functions import scalars as S
    from noticelake.plans import discovery as P

    notices = spark.createDataFrame([(1, "P1", "Attn: Ivan Petrov E-mail: i.petrov@x.org", " ", "me@x.org", None), (2, None, None, None, None, "")], "doc_id long, project string, text string, name string, email string, phone string")
    projects = spark.createDataFrame([("P1", "Bo Chen, Ann  Lee", "https://a.org/e.pdf#1")], "project string, leads string, url string")
    docs = spark.createDataFrame([("https://A.org/e.pdf", "fetched", "CONTACT POINT\nContact: Lee Ann Title: Expert\nE-mail: ann@b.org\nContact: Zed Other\nTelephone No: +1 2\n")], "url string, status string, text string")
    found = P.contact_sheet(notices, projects, docs.withColumn("key", S.url_key(F.col("url"))), spark.createDataFrame([("bo CHEN", "Chief", "bo@found.org")], "name string, title string, email string"))
    assert [(r["doc_id"], r["tier"], r["place"], r["name"], r["role"], r["email"], r["phone"]) for r in found.orderBy("doc_id", "priority", "place").collect()] == [
        (1, "notice", 0, "", "", "me@x.org", ""), (1, "body", 0, "Ivan Petrov", "", "i.petrov@x.org", ""),
        (1, "bank", 0, "Bo Chen", "Chief", "bo@found.org", ""), (1, "bank", 1, "Ann Lee", "Expert", "ann@b.org", ""), (1, "bank", 2, "Zed Other", "", "", "+1 2"),
    ]
