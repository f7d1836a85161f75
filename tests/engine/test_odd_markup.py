"""Texts on which queries and their SQL fell apart: references cut short, abbreviations in a row, blanks at a passage's end."""

import os

import duckdb
import pytest

from noticelake import catalog
from noticelake.functions import text as T

PAGES = [
    "<html><body><h1>A &ampB</h1><p>x &amp; y&amp</p><p>Tom &Jerry &copy 1 &copy; &&& z</p></body></html>",
    '<html><body><a href="/a">AT&T</a> cut &am</body></html>',
]
TEXTS = ["Go. No.\nNo. Anna came.  It is (St. Co. Ltd. Works).", "a" * 888, "a" * 887, "a" * 889, "b" * 880 + " |   #  ", "See No.   Five. Yes."]


@pytest.mark.parametrize("name", ["html_text", "html_sanitized", "html_blocks", "sentence_counts", "bounded_source", "structural_passages"])
def test_odd_texts_agree_with_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"create view {t} as select * from '{os.path.join(tmp_path, t)}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    found = con.sql(catalog.oracle_sql()[name])
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in found.fetchall())


def test_lone_ampersands_stay_and_hide_nothing():
    assert T.sanitized("<b>x&y</b>") == "<b>x&amp;y</b>"
    assert T.sanitized("<b>x&y &ampz &lt;i&gt; &NoReference;</b>", T.LONE) == "<b>x&y &ampz &lt;i&gt; &NoReference;</b>"
    assert T.sanitized('<a href="/?a=1&copy=2">q</a><a href="java&NoReference;script:x()">z</a>', T.LONE) == '<a href="/?a=1&amp;copy=2">q</a><a>z</a>'
    assert T.closed_references("&amp &amp; &copy=1") == "&amp;amp &amp; &amp;copy=1"
