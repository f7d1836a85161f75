"""Queries without SQL, written once more as plain loops over the smallest tables."""

import html
import re
import unicodedata

from noticelake import catalog

SF = "/root/testdata/sf0.001"
BLOCK = {"p", "div", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "br", "section", "article", "header", "footer", "nav"}


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def canonical(raw):
    out, i = "", 0
    while i < len(raw):
        end = raw.find(">", i) if raw[i] == "<" else -1
        if end < 0:
            out += raw[i]
            i += 1
            continue
        name = re.match(r"</?([a-zA-Z][a-zA-Z0-9]*)(?![\w])", raw[i:end])
        out += ". " if name and name[1].lower() in BLOCK else ""
        i = end + 1
    plain = unicodedata.normalize("NFKC", html.unescape(html.unescape(out)))
    for a, b in (("‘", "'"), ("’", "'"), ("ʼ", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("‐", "-"), ("‑", "-")):
        plain = plain.replace(a, b)
    words, kept = plain.split(), []
    for w in words:  # stops in a row are one
        kept.append(w)
    text = " ".join(kept)
    while (shorter := re.sub(r"\.\s*\.\s*", ". ", text)) != text:
        text = shorter
    text = text.strip(" ")
    return text[2:] if text.startswith(". ") else text


def test_canonical_pages(spark):
    got = {r.page_id: r.text for r in catalog.queries()["canonical_pages"](spark, SF).collect()}
    assert got == {r.page_id: canonical(r.html) for r in rows(spark, "pages")}


def sentence_spans(text):
    short = ("No.", "Nos.", "Ltd.", "Inc.", "Co.", "St.", "approx.", "i.e.", "e.g.", "U.S.")
    spans, start = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z(])", text):
        if not text[start : m.start()].endswith(short):
            spans.append((start, m.start()))
            start = m.end()
    spans.append((start, len(text)))
    trimmed = []
    for a, b in spans:
        while a < b and text[a] == " ":
            a += 1
        while b > a and text[b - 1] == " ":
            b -= 1
        if a < b:
            trimmed.append((a, b))
    return trimmed


def test_sentence_chunks(spark):
    got = {}
    for r in catalog.queries()["sentence_chunks"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.content))
    want = {}
    for r in rows(spark, "documents"):
        batch, size, out = [], 0, []
        for a, b in [*sentence_spans(r.text), (None, None)]:
            if batch and (a is None or size + b - a > 900):
                out.append((batch[0][0], batch[-1][1]))
                batch, size = [], 0
            if a is not None:
                batch.append((a, b))
                size += b - a
        chunks = [(a, b, r.text[a:b].strip()) for a, b in out if len(r.text[a:b].strip()) >= 80]
        if chunks:
            want[r.doc_id] = chunks
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_long_passages_cover_their_documents(spark):
    got = {}
    for r in catalog.queries()["long_passages"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.position, r.total, r.content))
    texts = {r.doc_id: r.text for r in rows(spark, "documents")}
    assert set(got) == {i for i, t in texts.items() if t.strip()}
    for i, own in got.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(1, len(own) + 1)) and {t for _, t, _ in own} == {len(own)}
        at = 0
        for _, _, content in own:
            assert len(content) <= 6000
            k = texts[i].find(content, max(0, at - 6000))
            assert 0 <= k <= at or not texts[i][at:k].strip(), (i, k, at)  # nothing between two slices
            at = k + len(content)
        assert not texts[i][at:].strip()
        assert len(own) == 1 or len(texts[i]) > 6000


def test_near_duplicate_selection(spark):
    words = lambda t: list(dict.fromkeys(re.findall(r"[^\W\d_]{3,}", t.lower())))
    docs = [(r.doc_id, r.source, words(r.text)) for r in rows(spark, "documents")]
    want = set()
    for q in rows(spark, "benchmark"):
        if q.item_id % 100:
            continue
        asked = set(words(q.text))
        hits = sorted((-round(len(asked & set(w)) / len(asked), 6), i, source, set(w)) for i, source, w in docs if asked & set(w))[:60]
        kept, count = [], {}
        for _, i, source, own in hits:
            if len(kept) == 8:
                break
            close = len(own) >= 8 and any(len(own & s) >= 0.9 * len(own | s) for s in kept)
            if count.get(source, 0) < 3 and not close:
                kept.append(own)
                count[source] = count.get(source, 0) + 1
                want.add((q.item_id, i, len(kept)))
    assert {(r.qid, r.doc_id, r.place) for r in catalog.queries()["near_duplicate_selection"](spark, SF).collect()} == want
