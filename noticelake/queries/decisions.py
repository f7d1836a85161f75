"""Requirement trees, joint ventures and scores (E-*, A-14 to A-17, A-20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import aggregates as A
from ..registry import query, table

TURNOVER = {"kind": "scalar", "key": "acctbal", "op": ">=", "value": 5000}
CONTRACTS = {"kind": "count", "entity": "orders", "op": ">=", "value": 3, "where": [{"field": "price", "op": ">=", "value": 150000}, {"field": "year", "op": ">=", "value": 1997}]}
CLOSED = {"kind": "exists", "entity": "orders", "where": [{"field": "status", "op": "==", "value": "F"}]}
TREE = {"kind": "all", "children": [CONTRACTS, {"kind": "any", "children": [TURNOVER, CLOSED]}, {"kind": "not", "child": {"kind": "scalar", "key": "segment", "op": "==", "value": "BUILDING"}}]}

#: Profiles as SQL: each third balance undeclared, each fifth customer without a collection, some prices missing.
_BASE = """
o AS (SELECT o_custkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS price, year(o_orderdate) AS y, o_orderstatus AS s FROM orders),
k AS (SELECT o_custkey, count(*) FILTER (WHERE price >= 150000 AND y >= 1997) AS matched,
  count(*) FILTER (WHERE price IS NULL AND y >= 1997) AS unclear, count(*) FILTER (WHERE s = 'F') AS closed FROM o GROUP BY 1),
c AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS bal, c_custkey % 5 <> 0 AS declared,
  coalesce(matched, 0) AS matched, coalesce(unclear, 0) AS unclear, coalesce(closed, 0) AS closed FROM customer LEFT JOIN k ON c_custkey = o_custkey),
v AS (SELECT *, bal >= 5000 AS turnover,
  CASE WHEN NOT declared THEN NULL WHEN matched >= 3 THEN true WHEN unclear > 0 THEN NULL ELSE false END AS contracts,
  CASE WHEN NOT declared THEN NULL ELSE closed >= 1 END AS any_closed FROM c)
"""


def profiles(spark, sf):
    """Customers as bidders: declared scalars and their orders as records."""
    o = table(spark, sf, "orders")
    record = F.create_map(
        F.lit("price"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).cast("decimal(18,2)").cast("string"),
        F.lit("year"), F.year("o_orderdate").cast("string"),
        F.lit("status"), F.col("o_orderstatus"),
    )
    records = o.groupBy("o_custkey").agg(F.collect_list(record).alias("records"))
    c = table(spark, sf, "customer").join(records, F.col("c_custkey") == F.col("o_custkey"), "left")
    scalars = F.map_filter(
        F.create_map(F.lit("acctbal"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).cast("decimal(18,2)").cast("string"), F.lit("segment"), F.col("c_mktsegment")),
        lambda k, v: v.isNotNull(),
    )
    none = F.array().cast("array<map<string,string>>")
    held = F.create_map(F.lit("orders"), F.coalesce("records", none))
    empty = F.create_map().cast("map<string,array<map<string,string>>>")
    return c.select("c_custkey", "c_nationkey", scalars.alias("scalars"), F.when(F.col("c_custkey") % 5 != 0, held).otherwise(empty).alias("collections"))


@query("kleene_scalar", f"WITH {_BASE} SELECT c_custkey, turnover AS verdict FROM v")
def kleene_scalar(spark, sf):
    """E-01, F-25, F-26"""
    return profiles(spark, sf).select("c_custkey", X.compile_node(TURNOVER).alias("verdict"))


@query("kleene_count", f"WITH {_BASE} SELECT c_custkey, contracts AS verdict, any_closed FROM v")
def kleene_count(spark, sf):
    """E-02, E-03"""
    return profiles(spark, sf).select("c_custkey", X.compile_node(CONTRACTS).alias("verdict"), X.compile_node(CLOSED).alias("any_closed"))


@query("kleene_tree", f"WITH {_BASE} SELECT c_custkey, contracts AND (turnover OR any_closed) AND NOT c_mktsegment = 'BUILDING' AS verdict FROM v")
def kleene_tree(spark, sf):
    """E-04, A-17, F-28"""
    return profiles(spark, sf).select("c_custkey", X.compile_node(TREE).alias("verdict"))


_JV = f"""WITH {_BASE}, m AS (SELECT *, c_nationkey AS bid, c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey) AS lead FROM v), g AS (
  SELECT bid, bool_or(NOT turnover) AS any_f, bool_or(turnover) AS any_t, count(*) FILTER (WHERE turnover IS NULL) AS n_null, sum(bal) AS total FROM m GROUP BY bid)
SELECT bid, (SELECT turnover FROM m WHERE m.bid = g.bid AND lead) AS single, total >= 5000 AS combined,
  CASE WHEN any_f THEN false WHEN n_null > 0 THEN NULL ELSE true END AS every, CASE WHEN any_t THEN true WHEN n_null > 0 THEN NULL ELSE false END AS some FROM g"""


@query("jv_modes", _JV)
def jv_modes(spark, sf):
    """E-05, A-20: customers of one nation bid together, in the four modes."""
    m = profiles(spark, sf).select(F.col("c_nationkey").alias("bid"), "c_custkey", "scalars", "collections")
    found = X.evaluate_all(m, "bid", "c_custkey", TURNOVER)
    return found.withColumnsRenamed(dict(zip(X.MODES, ("single", "combined", "every", "some"), strict=True)))


@query(
    "verdict_traces",
    f"""WITH {_BASE}, t AS (SELECT c_custkey, contracts, turnover, any_closed, c_mktsegment = 'BUILDING' AS building FROM v),
    w AS (SELECT c_custkey, contracts AS a, turnover AS b, any_closed AS c, building AS d, turnover OR any_closed AS o, NOT building AS n, contracts AND (turnover OR any_closed) AND NOT building AS r FROM t)
    SELECT c_custkey, '[' || coalesce(CASE WHEN r THEN 'SATISFIED' WHEN NOT r THEN 'FAILED' END, 'UNKNOWN') || '] all of' || chr(10) || '  [' || coalesce(CASE WHEN a THEN 'SATISFIED' WHEN NOT a THEN 'FAILED' END, 'UNKNOWN')
    || '] count of orders >= 3 where price >= 150 000 and year >= 1997' || chr(10) || '  [' || coalesce(CASE WHEN o THEN 'SATISFIED' WHEN NOT o THEN 'FAILED' END, 'UNKNOWN') || '] any of' || chr(10) || '    ['
    || coalesce(CASE WHEN b THEN 'SATISFIED' WHEN NOT b THEN 'FAILED' END, 'UNKNOWN') || '] acctbal >= 5000' || chr(10) || '    [' || coalesce(CASE WHEN c THEN 'SATISFIED' WHEN NOT c THEN 'FAILED' END, 'UNKNOWN')
    || '] some orders where status == F' || chr(10) || '  [' || coalesce(CASE WHEN n THEN 'SATISFIED' WHEN NOT n THEN 'FAILED' END, 'UNKNOWN') || '] not' || chr(10) || '    ['
    || coalesce(CASE WHEN d THEN 'SATISFIED' WHEN NOT d THEN 'FAILED' END, 'UNKNOWN') || '] segment == BUILDING' AS explanation FROM w""",
)
def verdict_traces(spark, sf):
    """E-07, F-27: the working behind each verdict as indented lines."""
    return profiles(spark, sf).select("c_custkey", F.array_join(X.explain(TREE), "\n").alias("explanation"))


@query(
    "open_inputs",
    f"""WITH {_BASE}, m AS (SELECT c_custkey AS k, bool_or(o_totalprice IS NOT NULL AND o_orderkey % 6 = 0) AS gap FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT c_custkey, concat_ws(',', CASE WHEN NOT declared THEN 'orders' WHEN gap THEN 'orders.price' END, CASE WHEN bal IS NULL THEN 'acctbal' END) AS missing FROM v JOIN m ON k = c_custkey""",
)
def open_inputs(spark, sf):
    """X-35: what a bidder could still declare."""
    return profiles(spark, sf).select("c_custkey", F.array_join(X.absent(TREE), ",").alias("missing"))


@query(
    "assessment",
    f"""WITH {_BASE}, r AS (SELECT c_custkey, 'turnover' AS k, turnover AS computed FROM v UNION ALL SELECT c_custkey, 'contracts', contracts FROM v UNION ALL SELECT c_custkey, 'closed', any_closed FROM v),
    d AS (SELECT c_custkey, k, CASE WHEN k = 'closed' AND c_custkey % 8 = 0 THEN true ELSE computed END AS verdict FROM r)
    SELECT c_custkey, count(*) FILTER (WHERE verdict) AS met, count(*) FILTER (WHERE NOT verdict) AS failed, count(*) FILTER (WHERE verdict IS NULL) AS open,
    coalesce(string_agg(k, ',' ORDER BY k) FILTER (WHERE NOT verdict AND k <> 'closed'), '') AS blockers FROM d GROUP BY c_custkey""",
)
def assessment(spark, sf):
    """E-06, E-08: requirements by bid; a declaration stands over what was computed."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), X.compile_node(n).alias("computed")) for k, n in (("turnover", TURNOVER), ("contracts", CONTRACTS), ("closed", CLOSED))])
    p = profiles(spark, sf).select("c_custkey", F.inline(rows))
    declared = table(spark, sf, "customer").where("c_custkey % 8 = 0").select("c_custkey", F.lit("closed").alias("k"), F.lit(True).alias("declared"))
    v = p.join(declared, ["c_custkey", "k"], "left").withColumn("verdict", F.coalesce("declared", "computed"))
    blocked = F.when(~F.col("verdict") & (F.col("k") != "closed"), F.col("k"))
    return v.groupBy("c_custkey").agg(
        F.count_if(F.col("verdict")).alias("met"),
        F.count_if(~F.col("verdict")).alias("failed"),
        F.count_if(F.col("verdict").isNull()).alias("open"),
        F.array_join(F.array_sort(F.collect_list(blocked)), ",").alias("blockers"),
    )


_ROWS = """r AS (SELECT source, CASE lang WHEN 'en' THEN 'high' WHEN 'de' THEN 'medium' ELSE 'low' END AS importance,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality = 1 END AS verdict, toxic = 1 AS mandatory FROM labels JOIN documents USING (doc_id)),
w AS (SELECT *, CASE importance WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END AS weight FROM r)"""


def requirement_rows(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    importance = F.when(F.col("lang") == "en", "high").when(F.col("lang") == "de", "medium").otherwise("low")
    return d.select("doc_id", "source", importance.alias("importance"), F.when(F.col("doc_id") % 4 != 0, F.col("quality") == 1).alias("verdict"), (F.col("toxic") == 1).alias("mandatory"))


@query(
    "readiness_score",
    f"""WITH {_ROWS}, g AS (SELECT source, coalesce(sum(weight) FILTER (WHERE verdict), 0)::BIGINT AS earned, coalesce(sum(weight) FILTER (WHERE verdict IS NULL), 0)::BIGINT AS open,
    coalesce(sum(weight) FILTER (WHERE NOT verdict), 0)::BIGINT AS lost, coalesce(bool_or(mandatory AND NOT verdict), false) AS blocked FROM w GROUP BY source)
    SELECT *, round(earned / (earned + open + lost), 3) AS score, round((earned + open) / (earned + open + lost), 3) AS ceiling FROM g""",
)
def readiness_score(spark, sf):
    """A-15, F-32: importance weights 5, 3 and 1."""
    return A.readiness(requirement_rows(spark, sf), ["source"], "verdict", "importance", "mandatory", {"high": 5, "medium": 3, "low": 1})


@query(
    "assessment_status",
    f"""WITH {_ROWS} SELECT source, CASE WHEN count(*) FILTER (WHERE mandatory) = 0 THEN 'unrated' WHEN coalesce(bool_or(mandatory AND NOT verdict), false) THEN 'blocked'
    WHEN count(*) FILTER (WHERE mandatory AND verdict IS NULL) > 0 THEN 'incomplete' ELSE 'eligible' END AS status, round(count(verdict) / count(*), 3) AS coverage FROM r GROUP BY source""",
)
def assessment_status(spark, sf):
    """A-16"""
    return A.status(requirement_rows(spark, sf), ["source"], "verdict", "mandatory")


@query(
    "grounding_rate",
    f"WITH {_ROWS} SELECT importance, count(*) FILTER (WHERE verdict) AS verified, count(*) FILTER (WHERE NOT verdict) AS not_found, round(count(*) FILTER (WHERE verdict) / nullif(count(verdict), 0), 3) AS rate FROM r GROUP BY importance",
)
def grounding_rate(spark, sf):
    """A-14, P-17: the rate is over checked rows alone."""
    v = F.col("verdict")
    return requirement_rows(spark, sf).groupBy("importance").agg(F.count_if(v).alias("verified"), F.count_if(~v).alias("not_found"), A.rate(F.count_if(v), F.count(v)).alias("rate"))


@query("kleene_folds", f"WITH {_ROWS} SELECT source, CASE WHEN bool_or(NOT verdict) THEN false WHEN count(*) > count(verdict) THEN NULL ELSE true END AS every, CASE WHEN bool_or(verdict) THEN true WHEN count(*) > count(verdict) THEN NULL ELSE false END AS some FROM r GROUP BY source")
def kleene_folds(spark, sf):
    """A-17 over rows"""
    return requirement_rows(spark, sf).groupBy("source").agg(A.kleene_all(F.col("verdict")).alias("every"), A.kleene_any(F.col("verdict")).alias("some"))


@query("layer_precedence", "SELECT user_id, event_type AS key, arg_min(event_id, (CASE WHEN value > 80 THEN 0 WHEN value > 40 THEN 1 ELSE 2 END, event_id)) AS kept, count(*) - 1 AS superseded FROM events GROUP BY 1, 2")
def layer_precedence(spark, sf):
    """X-33, M-24: the first layer to establish a key wins; the others are counted."""
    layer = F.when(F.col("value") > 80, 0).when(F.col("value") > 40, 1).otherwise(2)
    return table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("key")).agg(F.min_by("event_id", F.struct(layer, "event_id")).alias("kept"), (F.count("*") - 1).alias("superseded"))
