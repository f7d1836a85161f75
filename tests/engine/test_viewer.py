"""Pieces, quotes and their spans, and pages of persons."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from noticelake.functions import text as T
from noticelake.plans import viewer as W

TEXTS = [
    "One  “quoted” line\nand more.\n\n  Second — part\there.\n \n\nThird ﬁnal.",
    "\n\n lead only",
    "",
    None,
    "no break at all",
    "a\n\nb\n\n\n\nc",
]


def paragraphs(text):
    return [(m.start(), m.end()) for m in re.finditer(r"\S(?:(?!\n[ \t]*\n).)*?(?=\s*(?:\n[ \t]*\n|\Z))", text or "", re.S)]


def test_pieces_are_offsets_of_paragraphs(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: [(p.start, p.end) for p in r.p] for r in df.select("doc_id", W.pieces_of(F.col("text")).alias("p")).collect()}
    assert got == {i: paragraphs(t) for i, t in enumerate(TEXTS)}


def test_quotes_are_found_in_folded_form(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    quotes = [(0, 1, '"QUOTED" LINE AND MORE'), (0, 2, "more. second - part"), (0, 3, "third final"), (0, 4, "absent"), (0, 5, ""), (0, 6, None), (3, 1, "x"), (1, 9, "Lead"), (99, 1, "x")]
    q = spark.createDataFrame(quotes, "doc_id long, quote_id long, quote string")
    located = W.locate(docs, q)
    spans = {(r.doc_id, r.quote_id): (r.start, r.end) for r in located.collect()}
    assert {k: TEXTS[k[0]][a:b] for k, (a, b) in spans.items() if a is not None} == {
        (0, 1): "“quoted” line\nand more", (0, 2): "more.\n\n  Second — part", (0, 3): "Third ﬁnal", (1, 9): "lead",
    }
    assert {k for k, (a, _) in spans.items() if a is None} == {(0, 4), (0, 5), (0, 6), (3, 1)}
    rows = {r.doc_id: r for r in W.payload(docs, located).collect()}
    assert [(h.quote_id, h.piece, h.start, h.end) for h in rows[0].highlights] == [(1, 0, 5, 27), (2, 0, 23, 28), (2, 1, 0, 13), (3, 2, 0, 10)]
    assert list(rows[0].missing) == [4, 5, 6] and list(rows[2].pieces) == [] and list(rows[4].highlights) == []
    sources = spark.createDataFrame([("o", 0, 1), ("o", 1, 9), ("p", 4, None), ("p", 5, 2)], "owner string, doc_id long, richness int")
    assert {(r.owner, r.doc_id, r.found) for r in W.best_source(located, sources).collect()} == {("o", 0, 3), ("p", 5, 0)}


def test_pages_of_persons(spark):
    bio = "Jane Doe " + "builds bridges &amp; roads. " * 5
    page = f'<title>Jane Doe | Senior &amp; Lead</title><p>Jane Doe</p>Languages EN <p>{bio}</p> Posts Jane Doe wrote <img src="https://x/p.jpg">'
    rows = [(1, page, "Jane Doe"), (2, "<title>No bar</title>Languages Jane Doe short Posts", "Jane Doe"), (3, None, "x"), (4, page, None), (5, page.replace("Languages", ""), "Jane Doe")]
    df = spark.createDataFrame(rows, "i int, h string, n string")
    got = {r.i: tuple(r.a) for r in df.select("i", T.author_page(F.col("h"), F.col("n"), "Languages", ("Posts", "Footer"), r'<img src="([^"]+)"').alias("a")).collect()}
    assert got[1] == ("Senior & Lead", bio.replace("&amp;", "&").strip(), "https://x/p.jpg")
    assert got[2] == got[3] == ("", "", "") and got[4] == got[5] == ("Senior & Lead", "", "https://x/p.jpg")


def folded(text):
    """The folded form a character at a time, with the offset of each."""
    out, at = [], []
    for i, raw in enumerate(text):
        for c in unicodedata.normalize("NFKC", raw).translate(T.PLAIN).casefold():
            c = " " if c.isspace() else c
            if c != " " or (out and out[-1] != " "):
                out.append(c)
                at.append(i)
    return "".join(out), at


def test_texts_fold_in_blocks_and_keep_their_offsets(monkeypatch):
    r = random.Random(1)
    for block in (1, 2, 3, 7, 4096):
        monkeypatch.setattr(W, "BLOCK", block)
        for _ in range(300):
            text = "".join(r.choice("ab  \n\t\x1cﬁß“”—¨İ😀é") for _ in range(r.randrange(30)))
            got, (form, at) = W.Folded(text), folded(text)
            assert (got.text, [got.offset(i) for i in range(len(at))]) == (form, at)


def test_quotes_are_looked_for_once(spark):
    docs = spark.createDataFrame([(1, "One.\n\nTwo.")], "doc_id long, text string")
    shown = W.payload(docs, W.locate(docs, spark.createDataFrame([(1, 1, "two")], "doc_id long, quote_id long, quote string")))
    assert "MapInPandas" not in shown._jdf.queryExecution().toString()
    assert [tuple(h) for h in shown.first().highlights] == [(1, 1, 0, 3)]
