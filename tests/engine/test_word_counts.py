"""A word that many queries ask for is counted once a document, before the queries meet it."""

import re

from noticelake.operators import fulltext as FT


def test_common_words_are_not_dealt_for_each_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat the dog"), (2, "the bird"), (3, "dog cat")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, "the") for i in range(5)] + [(5, '"the dog"'), (6, "the -cat"), (7, "cat or bird")], "qid long, text string")
    found = FT.search(queries, FT.build(docs, f"{tmp_path}/index"))
    got = {(r.qid, r.doc_id) for r in found.collect()}
    assert got == {(i, d) for i in range(5) for d in (1, 2)} | {(5, 1), (6, 2), (7, 1), (7, 2), (7, 3)}
    assert re.search(r"Aggregate \[stem#\d+, doc_id#\d+L?\]", found._jdf.queryExecution().optimizedPlan().toString())


def test_a_term_of_a_document_is_one_row_and_a_document_meets_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "road work road work road"), (2, "a road"), (2, "works of a road"), (3, None)], "doc_id long, text string")
    index = FT.build(docs, f"{tmp_path}/index")
    rows = sorted((r.doc_id, r.term, list(r.places)) for r in index.postings.collect())
    assert rows == [(1, "road", [0, 2, 4]), (1, "work", [1, 3]), (2, "a", [0]), (2, "a", [2]), (2, "of", [1]), (2, "road", [1]), (2, "road", [3]), (2, "works", [0])]
    queries = spark.createDataFrame([(1, '"road work"'), (2, "work road"), (3, '-"work of"'), (4, '"road work road"'), (None, "road")], "qid long, text string")
    found = FT.search(queries, index)
    assert sorted((r.qid, r.doc_id) for r in found.collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 3), (4, 1)]
    # items and queries are decided where a document's places are: neither a place nor an item of a query is dealt
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("start" in k or "qid" in k and "item" in k for k in keys)
