"""Latest, first and last-N rows, and conversations (W-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.spans import cut
from ..operators import ordering as O
from ..plans.standins import AWARDS, awards
from ..registry import query, table


@query("latest_per_key", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC, event_id) = 1")
def latest_per_key(spark, sf):
    """W-01"""
    found = O.first_per_key(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("value"), F.col("event_id")])
    return found.select("user_id", "event_type", "event_id", "value")


@query(
    "first_per_winner",
    f"""WITH a AS ({AWARDS}), r AS (SELECT lower(trim(supplier)) AS winner, price, notice_id, l_linenumber, row_number() OVER (PARTITION BY lower(trim(supplier)) ORDER BY price DESC NULLS LAST, notice_id, l_linenumber) AS place FROM a)
    SELECT winner, price, notice_id FROM r WHERE place = 1 ORDER BY price DESC NULLS LAST, notice_id, winner LIMIT 20""",
)
def first_per_winner(spark, sf):
    """W-02"""
    a = awards(spark, sf).withColumn("winner", F.lower(F.trim("supplier")))
    order = [F.desc_nulls_last("price"), F.col("notice_id"), F.col("l_linenumber")]
    return O.first_per_key(a, ["winner"], order).orderBy(F.desc_nulls_last("price"), "notice_id", "winner").limit(20).select("winner", "price", "notice_id")


@query("rank_by_score", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) - 1 AS rank FROM embeddings QUALIFY rank < 20")
def rank_by_score(spark, sf):
    """W-03: ranks from 0 by falling score, twenty kept."""
    e = table(spark, sf, "embeddings").withColumn("score", F.get("embedding", F.lit(0)))
    found = O.first_per_key(e, ["label"], [F.desc("score"), F.col("vec_id")], 20)
    return found.select("label", "vec_id", (F.col("place") - 1).cast("long").alias("rank"))


@query("passage_cap", "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def passage_cap(spark, sf):
    """W-04"""
    return O.first_per_key(table(spark, sf, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id", "n_chars")


@query(
    "page_islands",
    "WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT f.*, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f JOIN events USING (event_id, user_id, event_type)) SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY 1, 2",
)
def page_islands(spark, sf):
    """W-06: runs of one kind in a row."""
    found = O.islands(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return found.select("user_id", "island", "event_type", "n")


@query("history_last_n", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 6")
def history_last_n(spark, sf):
    """W-08"""
    found = O.first_per_key(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn"), F.desc("role")], 6)
    return found.select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query(
    "previous_user_turn",
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations QUALIFY role = 'assistant'",
)
def previous_user_turn(spark, sf):
    """W-09: for each answer the question before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return table(spark, sf, "conversations").withColumn("question", asked).where("role = 'assistant'").select("conv_id", "turn", "question")


@query("prune_beyond_newest", "WITH t AS (SELECT conv_id, conv_id % 7 AS owner, max(turn) AS turns FROM conversations GROUP BY 1) SELECT owner, conv_id FROM t QUALIFY row_number() OVER (PARTITION BY owner ORDER BY conv_id DESC) > 10")
def prune_beyond_newest(spark, sf):
    """W-10: what an owner has beyond the newest ten."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns")).withColumn("owner", F.col("conv_id") % 7)
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("conv_id")))
    return t.withColumn("place", place).where("place > 10").select("owner", "conv_id")


@query("best_chunk", "SELECT lang, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY lang")
def best_chunk(spark, sf):
    """W-11: the first of the best."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query(
    "conversation_titles",
    r"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1), s AS (SELECT conv_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM f)
    SELECT conv_id, CASE WHEN length(t) <= 60 THEN t WHEN regexp_extract(t, '^(.{0,59})\s', 1) = '' THEN left(t, 59) || '…' ELSE regexp_extract(t, '^(.{0,59})\s', 1) || '…' END AS title FROM s""",
)
def conversation_titles(spark, sf):
    """W-12, F-21: the first question, cut at a word."""
    f = table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    s = f.select("conv_id", F.trim(F.regexp_replace("t", r"\s+", " ")).alias("t"))
    return s.select("conv_id", cut(F.col("t"), 60, "…").alias("title"))


@query("adopt_sessions", "SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'u1' WHEN conv_id % 3 = 0 THEN 'u2' END AS owner FROM (SELECT DISTINCT conv_id FROM conversations)")
def adopt_sessions(spark, sf):
    """M-34: threads of a session pass to the user who signs in, unless they have one."""
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    c = c.withColumn("owner", F.when(F.col("conv_id") % 4 == 0, "u1")).withColumn("session", F.col("conv_id") % 3)
    return c.select("conv_id", F.when(F.col("owner").isNull() & F.col("session").isin(0), "u2").otherwise(F.col("owner")).alias("owner"))
