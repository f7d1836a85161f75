"""Injected models, writers and parsers on scripted results."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from noticelake import catalog
from noticelake.functions import classify as K
from noticelake.functions import text as T
from noticelake.operators import ordering as O
from noticelake.operators import vectors as V
from noticelake.plans import answers as A
from noticelake.plans import extraction as E
from noticelake.sources import files as L
from noticelake.sources.blocks import blocks


def test_partial_answers():
    body = '{"claims": [{"text": "one", "sources": [1]}, {"text": "tw\\"o", "sources": []}, {"text": "thr'
    assert [c["text"] for c in A.complete_claims(body)] == ["one", 'tw"o']
    assert A.draft(body) == "thr" and A.draft(body + 'ee"') == "" and A.draft(body + "\\u00e") == ""
    assert A.complete_claims("{") == [] and A.draft("") == ""


def test_answer_checks_citations_and_survives_its_writer(spark):
    q = spark.createDataFrame([(1, "what?"), (2, "fails")], "qid long, text string")
    hits = [(i, d, f"n{d}", d, f"Title {d}", True, f"passage number {d} of {i}") for i in (1, 2) for d in (1, 2, 3)]
    h = spark.createDataFrame(hits, "qid long, doc_id long, notice string, rank int, title string, open boolean, text string")

    def writer(question, passages):
        if question == "fails":
            raise RuntimeError
        return {"claims": [{"text": "a", "sources": [3, 1, 9, 1]}, {"text": " ", "sources": [1]}, {"text": f"{len(passages)}", "sources": [0]}]}

    got = {r.qid: r for r in A.answer(q, h, writer).collect()}
    assert [(c.text, c.sources) for c in got[1].claims] == [("a", [1, 3]), ("3", [])]
    assert (got[1].unsupported, got[1].problem) == (1, "") and (got[2].claims, got[2].problem) == ([], "RuntimeError")


def test_reranking_decides_what_the_writer_sees_first(spark, tmp_path):
    # five words each shared with the question, so that the search itself goes by doc_id; texts grow with it
    words = "alpha beta gamma delta epsilon"
    docs = [(d, f"{words} " + " ".join(f"{chr(97 + d)}{chr(97 + k)}{c}" for k in range(9 + d) for c in ("xyz",)), f"s{d}") for d in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = catalog.queries()["cited_answers"](spark, str(tmp_path)).first()
    shown = [c["text"].split(" (")[0] for c in json.loads(row.claims)[:5]]
    assert shown == [f"[{k}] Document {5 - k}" for k in range(1, 6)] and (row.n, row.unsupported, row.problem) == (6, 1, "")


def test_layers_and_grounding(spark):
    text = "The average annual turnover shall be at least USD 5,000. Staff must have licenses. Nothing else."
    docs = spark.createDataFrame([(1, text, 2020), (2, "No rules here.", 2020)], "doc_id long, text string, year int")

    def model(body, keys):
        assert "annual_turnover_avg" in keys
        return [{"key": "annual_turnover_avg", "value": 1.0, "quote": "at least USD 5,000"}, {"key": "licenses", "value": None, "quote": "staff MUST have licenses"}, {"key": "iso", "value": 9001.0, "quote": "ISO 9001"}, {"key": "x", "quote": " "}]

    got = {(r.layer, r.key): (r.grounding, r.superseded) for r in E.layered(docs, [("model", model)]).collect()}
    assert got == {
        ("rules", "annual_turnover_avg"): ("verified", False),
        ("model", "annual_turnover_avg"): ("verified", True),
        ("model", "licenses"): ("verified", False),
        ("model", "iso"): ("not_found", False),
    }


def test_compression_and_subdirections(spark):
    df = spark.createDataFrame([("<b>Supply of pumps for X</b>:  a​b \x07 c\n\n\n\nd", "Supply of  Pumps for X"), ("word " * 400, "")], "t string, title string")
    a, b = [r.c for r in df.select(T.compress(F.col("t"), F.col("title"), 100).alias("c")).collect()]
    assert a == "ab c\n\nd" and b.endswith("word …") and len(b) <= 102
    rows = [("consulting", "External audit of the project", ""), ("supply", "External audit", ""), ("consulting", "Something", "training of trainers and audit"), ("consulting", "Hello", "")]
    df = spark.createDataFrame(rows, "d string, t string, b string")
    got = [r.s for r in df.select(K.subdirection(F.col("d"), F.col("t"), F.col("b"))["sub"].alias("s")).collect()]
    assert got == ["audit", "", "training", "other"]


def test_long_and_structural_chunks(spark):
    assert T.unit_spans("aaa bbb; ccc ddd", ["aaa bbb; ccc ddd"], 9) == [(0, 9), (9, 16)]
    assert T.unit_windows([(0, 4), (5, 9), (10, 14), (15, 19)], 14, 1) == [(0, 14), (10, 19)]
    text = ". ".join(f"Sentence number {i} stands here" for i in range(80)) + "."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = sorted(T.long_chunks(docs, 300, 2, 100).collect(), key=lambda r: r.position)
    assert all(r.content in text and len(r.content) <= 300 for r in got) and got[0].content.startswith("Sentence number 0") and got[-1].content.endswith("79 stands here.")
    md = spark.createDataFrame([(1, "# A\n\npara one\n\npara two\n\n## B\n| x |\n\ntail")], "doc_id long, text string")
    chunks = [r.content for r in sorted(T.structural_chunks(blocks(md)).collect(), key=lambda r: r.first_block)]
    assert chunks == ["A\npara one\n\npara two", "A > B", "A > B\n| x |", "A > B\ntail"]


def test_contact_points(spark):
    text = "x\nIII. CONTACT POINT\nWorld Bank\nTask Team Leader: Ann  Lee Title: Senior Expert\nTelephone No: +1 202 E-mail: ann@bank.org\nContact: Bob Ray\nline\nE-mail: bob@bank.org\nContact: ann lee\n\nBorrower/Client/Recipient\nContact: Not Me\n"
    df = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")
    got = {r.name: (r.title, r.label, r.email, r.phone) for r in T.contact_points(df).collect()}
    assert got == {"Ann Lee": ("Senior Expert", "Task Team Leader", "ann@bank.org", "+1 202"), "Bob Ray": ("", "Contact", "bob@bank.org", None)}


def test_embedding_is_checked(spark):
    df = spark.createDataFrame([(1, "aa"), (2, None), (3, "b")], "vec_id long, text string")
    got = {r.vec_id: r.embedding for r in V.embed(df, lambda ts: [[len(t), 1.0] for t in ts], 2).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0], 3: [1.0, 1.0]}
    assert all("width" in r.problem and r.embedding is None for r in V.embed(df, lambda ts: [[1.0] for t in ts], 2).collect())


def test_parsed_files_and_count_memo(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p>")
    rows = [("a.pdf", b"%PDF-1.4 /Type /Page x /Type /Pages /Type/Page"), ("b", held.getvalue()), ("c", b"<html><p>Hi</p></html>"), ("d", b"plain"), ("e", b"PK\x03\x04broken"), ("f", b"")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.kind, r.text, r.page_count) for r in L.parse_documents(L.sniff(df)).collect()}
    assert got["a.pdf"] == ("pdf", "", 2) and got["b"][:2] == ("docx", "One. Two.") and got["c"][0] == "html" and "Hi" in got["c"][1]
    assert got["d"] == ("text", "plain", None) and got["e"][0] == "unknown" and got["f"][0] == "unknown"
    now = [0.0]
    memo = O.CountMemo(60, lambda: now[0])
    assert memo.count(spark.range(5)) == 5 and memo.count(spark.range(5)) == 5 and len(memo.held) == 1
