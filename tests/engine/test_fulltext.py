"""The positional index against plain loops, and what a search reads of it."""

import math
import re

import pytest

from noticelake.operators import fulltext as FT

DOCS = {
    1: "Terms of Reference for road works. The roads need new bridges.",
    2: "Reference terms: road work, bridge, and a school",
    3: "Schools and hospitals; terms of reference of 12 schools",
    4: "A hospital near the road",
    5: None,
    6: "",
    7: "glass gas bus ties series movies shoes heroes buses",
    8: "work road work road work road",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id long, text string")
    return FT.build(docs, f"file://{tmp_path_factory.mktemp('index')}")


def _stem(w):
    if len(w) > 3:
        if w.endswith("ies") and w[-4] not in "ea":
            return w[:-3] + "y"
        if w.endswith("es") and w[-3] not in "aeo" or w.endswith("s") and not w.endswith(("us", "ss", "es")):
            return w[:-1]
    return w


def _plain(text):
    """{doc_id: score} of a web-style query by looking at every text."""
    words = {k: [_stem(w) for w in re.findall(r"[^\W\d_]+|\d+", (t or "").lower())] for k, t in DOCS.items()}
    choices, now = [], []
    for raw in re.findall(r'-?"[^"]*"|[^\s"]+', text):
        if raw.lower() == "or":
            choices.append(now)
            now = []
        elif w := [_stem(x) for x in re.findall(r"[^\W\d_]+|\d+", raw.lower())]:
            now.append((raw.startswith("-"), w))
    found: dict[int, float] = {}
    count = lambda own, w: sum(own[i : i + len(w)] == w for i in range(len(own)))
    for items in [x for x in [*choices, now] if x]:
        for k, own in words.items():
            if any(count(own, w) for no, w in items if no) or not all(count(own, w) for no, w in items if not no):
                continue
            score = 0.0
            for w in [w for no, w in items if not no]:
                docs = sum(count(x, w) > 0 for x in words.values())
                score += count(own, w) / (count(own, w) + FT.SATURATION) * math.log1p(len(DOCS) / docs)
            found[k] = max(found.get(k, 0.0), round(score, 6))
    return found


QUERIES = [
    "road", "roads", "terms reference", '"terms of reference"', '"reference terms"', "school or hospital", "road -bridge", 'road -"terms of reference"', "school hospital OR bridge road",
    "-road", "", "nothing", '"road work road"', '"never closed', "12", "terms -", "bus", "movie", "shoe", "glasses", "OR road or", '"" road', "road road",
]


def test_search_equals_looking_at_every_text(spark, index):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid long, text string")
    rows = FT.search(asked, index, 20).collect()
    for k, text in enumerate(QUERIES):
        own = {r["doc_id"]: r["score"] for r in rows if r["qid"] == k}
        expected = _plain(text)
        assert own.keys() == expected.keys(), text
        assert all(math.isclose(own[d], expected[d], abs_tol=2e-6) for d in own), text
        best = [r["doc_id"] for r in sorted((r for r in rows if r["qid"] == k), key=lambda r: r["rank"])]
        assert best == sorted(own, key=lambda d: (-own[d], d))


def test_only_folders_of_the_asked_stems_are_read(spark, index):
    asked = FT.asked_terms(spark.createDataFrame([(1, "road")], "qid long, text string"))
    plan = index.of(asked)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters: [" in plan and "EqualTo(stem,road)" in plan.replace(" ", "")
    assert len(index.of(asked).inputFiles()) >= 1 and {r["stem"] for r in index.of(asked).collect()} == {"road"}


def test_lexical_reads_the_index_and_null_texts_have_no_word(spark, index):
    asked = spark.createDataFrame([(1, "The Roads of schools"), (2, None), (3, "a b")], "qid long, text string")
    rows = {(r["qid"], r["doc_id"]): r["score"] for r in FT.lexical(asked, index, 9).collect()}
    words = lambda t: set(re.findall(r"[^\W\d_]{3,}", (t or "").lower()))
    q = words("The Roads of schools")
    assert rows == {(1, k): round(len(q & words(t)) / len(q), 6) for k, t in DOCS.items() if q & words(t)}


def test_the_index_is_built_once_and_again_where_files_change(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "one")], "doc_id long, text string").write.parquet(path)
    first = FT.index_of(spark.read.parquet(path))
    assert FT.index_of(spark.read.parquet(path)) is first
    spark.createDataFrame([(2, "two one")], "doc_id long, text string").write.mode("append").parquet(path)
    assert FT.index_of(spark.read.parquet(path)).documents.count() == 2


def test_codes_are_looked_up(spark):
    asked = spark.createDataFrame([(1, "what about op-12 or AB-9-x?"), (2, "well-known"), (3, None)], "qid long, text string")
    labels = spark.createDataFrame([(5, "Lot OP-12", None), (6, None, "xab-9-X/3"), (4, "op-123", "ab-9-x"), (7, None, None)], "id long, title string, project string")
    assert [tuple(r) for r in FT.probe(asked, labels).orderBy("rank").collect()] == [(1, 4, "OP-12", 1), (1, 5, "OP-12", 2), (1, 6, "AB-9-X", 3)]
