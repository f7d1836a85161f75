"""Queries over whole tables, on rows that narrower queries leave out."""

import re

import numpy as np

from noticelake import catalog
from noticelake.operators import vectors as V
from noticelake.operators import fulltext as FT
from noticelake.queries.rollups import quoted
from noticelake.session import scratch


def test_quotes_are_found_in_every_document(spark):
    docs = [(1, "xOne two three Four five sixy"), (41, "one two  three four five six"), (80, None), (81, "one two three four"), (2, "")]
    quotes = [(0, "one two three four five six"), (40, "two three"), (7, "one two  three four five six"), (8, "absent words that stand nowhere")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    quotes = spark.createDataFrame(quotes, "item_id long, quote string")
    assert sorted(map(tuple, quoted(docs, quotes, FT.build(docs, scratch(spark, "quotes"))).collect())) == [(0, 1), (7, 41), (40, 1), (40, 81)]


def sentences(text):
    short = re.compile(r"(No|Nos|Ltd|Inc|Co|St|approx|i\.e|e\.g|U\.S)\.$")
    found = []
    for part in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", text or ""):
        if found and short.search(found[-1]):
            found[-1] += " " + part
        else:
            found.append(part)
    return [s for s in found if s.strip()]


def passage(text):
    t = re.sub("<[^>]{1,200}>", " ", text or "")
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t)
    t = re.sub("[​-‏﻿]", "", t)
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t\r]+", " ", t))).strip(" ")
    if len(t) <= 300:
        return t
    cut = re.match(r"(?s)(.{0,299}) ", t)
    return re.sub(r"[ ,;:\-]+$", "", cut[1] if cut else "") + " …"


def test_documents_of_every_kind_are_counted(spark, tmp_path):
    texts = ["Acme Ltd. Supplies goods. It is paid.", "See No. 7. (Then) go. Co. Ltd. Works", "a\tb\x01c​d – e", "é " * 400, None, "", "word " * 100, "<b>x</b>\r\n\n\n\n y"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, brute in (("sentence_counts_all", lambda t: len(sentences(t))), ("compressed_passages_all", lambda t: len(passage(t)))):
        got = {r.doc_id: r.n for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {i: brute(t) for i, t in rows}, name


def test_representative_passages_are_chosen(spark):
    rows = [
        (1, "Supply of Irrigation pumps", 10, "irrigation pumps and supply", 8),  # boilerplate, though on topic
        (1, "Supply of Irrigation pumps", 11, "the supply of other things", 0),
        (1, "Supply of Irrigation pumps", 12, "PUMPS for a town", 7),
        (1, "Supply of Irrigation pumps", 13, "pumps again", 2),
        (2, None, 20, None, 9),
        (2, None, 21, "boilerplate", 8),
        (3, "Road", 31, "nothing", 1),
        (3, "Road", 30, "nothing", 1),
    ]
    df = spark.createDataFrame(rows, "source long, title string, vec_id long, content string, duplicates long")
    got = sorted((r.source, r.place, r.vec_id, r.topicality) for r in V.representatives(df, 3).collect())
    assert got == [(1, 1, 13, 1), (1, 2, 12, 1), (1, 3, 11, 0), (2, 1, 21, 0), (2, 2, 20, 0), (3, 1, 30, 0), (3, 2, 31, 0)]
    assert sorted(r.vec_id for r in V.representatives(df).collect()) == [13, 21, 30]


def test_representatives_are_sought_among_all_passages(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 260
    vectors = [v / np.linalg.norm(v) for v in rng.normal(size=(n, 8)) + 0.6 * rng.integers(0, 2, (n, 1))]
    texts = [" ".join(rng.choice(["bridge", "river", "school", "road", "supply"], 4)) for _ in range(n)]
    items = [(i, f"Supply of {a} and {b}") for i, (a, b) in enumerate(rng.choice(["bridge", "river", "school", "road"], (45, 2)))]
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(list(enumerate(texts))[:250], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    single = np.array(vectors, np.float32).astype(float)
    expected = []
    for owner in range(50):
        own = []
        for v in range(owner, n, 50):
            near = sorted((-round(float(single[v] @ single[u]), 6), u) for u in range(n) if u % 50 != owner and round(float(single[v] @ single[u]), 6) >= 0.3)[:40]
            title = {w for w in dict(items).get(owner, "").lower().split() if w not in V.TITLE_STOPWORDS and len(w) > 2}
            own.append((v, len(title & set(texts[v].split())) if v < 250 else 0, len({u % 50 for _, u in near})))
        pool = [x for x in own if (x[2] >= V.BOILERPLATE) == min(y[2] >= V.BOILERPLATE for y in own)]
        best = sorted(pool, key=lambda x: (-x[1], x[2], x[0]))[:3]
        expected += [(owner, v, t, d, i) for i, (v, t, d) in enumerate(best, 1)]
    got = catalog.queries()["representative_passages"](spark, str(tmp_path)).select("source", "vec_id", "topicality", "duplicates", "place")
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_quotes_of_any_length_equal_containment(spark):
    texts = ["the red fox ran, and ran", "A Red foxes' den", "red", "fo-x red fox. x", "", None, "no such words here", "xred foxy", "  the   red fox"]
    asked = ["red fox ran", "red", "e red fo", "fo-x red fox.", "- , -", "the   red", "zzz red zzz", "a red foxes' den", "ran, and ran", "such words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    quotes = spark.createDataFrame(list(enumerate(asked)), "item_id long, quote string")
    found = sorted(map(tuple, quoted(docs, quotes, FT.build(docs, scratch(spark, "quotes"))).collect()))
    assert found == sorted((i, k) for i, q in enumerate(asked) for k, t in enumerate(texts) if t is not None and q.lower() in t.lower())
