"""Listing queries: filters, scopes, facets, orders and pages over notices (P-*, O-*, A-01 to A-06)."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ordering as O
from ..operators import predicates as P
from ..plans.standins import NOTICES, notices
from ..registry import query, table

NOW = datetime.date(1998, 6, 1)
REGION = ["NATION_1", "NATION_3", "NATION_5", "NATION_7"]
TYPES = ["1-URGENT", "2-HIGH"]
_IN = "country IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_7')"
_FOCUS = f"notice_type IN ('1-URGENT', '2-HIGH') AND deadline >= DATE '1998-06-01' AND {_IN}"


@query("facet_values", "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 300")
def facet_values(spark, sf):
    """A-01"""
    return A.facet(table(spark, sf, "orders"), "o_orderpriority", 300)


@query("count_map", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def count_map(spark, sf):
    """A-02"""
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n"))


@query("method_facets", "SELECT p_brand AS code, coalesce(nullif(trim(p_type), ''), p_brand) AS label, count(*) AS n FROM part GROUP BY 1, 2")
def method_facets(spark, sf):
    """A-03: two keys, the label falling back to the code."""
    part = table(spark, sf, "part")
    return part.groupBy(F.col("p_brand").alias("code"), P.first_nonblank("p_type", "p_brand").alias("label")).agg(F.count("*").alias("n"))


@query(
    "stats_one_pass",
    f"""WITH n AS ({NOTICES}) SELECT count(*) AS total, min(notice_date) AS first_date, max(notice_date) AS last_date,
    count(*) FILTER (WHERE deadline >= DATE '1998-06-01') AS open_now, count(*) FILTER (WHERE deadline IS NULL) AS no_deadline,
    count(*) FILTER (WHERE amount > 100000) AS large, count(DISTINCT nullif(category, '')) AS categories,
    count(DISTINCT nullif(country, '')) AS countries FROM n""",
)
def stats_one_pass(spark, sf):
    """A-04, A-06: all numbers from one scan."""
    return notices(spark, sf).agg(
        F.count("*").alias("total"),
        F.min("notice_date").alias("first_date"),
        F.max("notice_date").alias("last_date"),
        F.count_if(P.open_at(NOW)).alias("open_now"),
        F.count_if(F.col("deadline").isNull()).alias("no_deadline"),
        F.count_if(F.col("amount") > 100000).alias("large"),
        F.countDistinct(F.nullif(F.col("category"), F.lit(""))).alias("categories"),
        F.countDistinct(F.nullif(F.col("country"), F.lit(""))).alias("countries"),
    )


@query(
    "focus_stats",
    f"""WITH n AS ({NOTICES}) SELECT category, country, count(*) AS total,
    count(*) FILTER (WHERE deadline = DATE '1998-06-10') AS closing, count(*) FILTER (WHERE category <> 'MACHINERY') AS classified
    FROM n WHERE {_FOCUS} GROUP BY GROUPING SETS ((), (category), (country))""",
)
def focus_stats(spark, sf):
    """A-05: totals, by category and by country in one pass over the focus feed."""
    found = notices(spark, sf).where(P.focus(TYPES, NOW, REGION))
    return found.groupingSets([[], ["category"], ["country"]], "category", "country").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("deadline") == F.lit(datetime.date(1998, 6, 10))).alias("closing"),
        F.count_if(F.col("category") != "MACHINERY").alias("classified"),
    )


@query(
    "focus_and_complement",
    f"WITH n AS ({NOTICES}) SELECT notice_id, coalesce({_FOCUS}, false) AS in_focus FROM n",
)
def focus_and_complement(spark, sf):
    """P-06: the two scopes hold every row once."""
    n = notices(spark, sf)
    inside = n.where(P.focus(TYPES, NOW, REGION)).select("notice_id", F.lit(True).alias("in_focus"))
    return inside.union(n.where(P.out_of_focus(TYPES, NOW, REGION)).select("notice_id", F.lit(False).alias("in_focus")))


@query(
    "iexact_icontains_search",
    """SELECT p_partkey, p_name FROM part WHERE upper(p_brand) = upper('brand#13') OR
    ((contains(upper(p_name), 'PART') OR contains(upper(p_type), 'PART')) AND (contains(upper(p_name), '1') OR contains(upper(p_type), '1')))""",
)
def iexact_icontains_search(spark, sf):
    """P-01, P-02, P-04, P-08"""
    return table(spark, sf, "part").where(P.iexact("p_brand", "brand#13") | P.search(["p_name", "p_type"], "part 1")).select("p_partkey", "p_name")


@query(
    "range_filters",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-03-31'
    AND o_totalprice >= 1000 AND o_totalprice <= 150000""",
)
def range_filters(spark, sf):
    """P-03: plain comparisons reach the scan."""
    o = table(spark, sf, "orders")
    first, last = (F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in ("1996-01-01", "1996-03-31"))
    return o.where(P.between("o_orderdate", first, last) & P.between("o_totalprice", 1000.0, 150000.0)).select("o_orderkey", "o_totalprice")


@query(
    "named_group_filter",
    f"WITH n AS ({NOTICES}) SELECT country, count(*) AS n FROM n WHERE {_IN} GROUP BY country",
)
def named_group_filter(spark, sf):
    """P-05: a known group; an unknown one adds nothing."""
    groups, n = {"region": REGION}, notices(spark, sf)
    known = n.where(P.named_group("country", groups, "region"))
    return known.union(n.where(P.named_group("country", groups, "elsewhere"))).groupBy("country").agg(F.count("*").alias("n"))


@query(
    "tri_state_counts",
    f"""WITH n AS ({NOTICES}) SELECT 'any' AS wanted, count(*) AS n FROM n UNION ALL
    SELECT 'yes', count(*) FROM n WHERE deadline >= DATE '1998-06-01' UNION ALL
    SELECT 'no', count(*) FROM n WHERE NOT deadline >= DATE '1998-06-01'""",
)
def tri_state_counts(spark, sf):
    """P-09"""
    n, out = notices(spark, sf), None
    for name, wanted in (("any", None), ("yes", True), ("no", False)):
        one = P.tri_state(n, P.open_at(NOW), wanted).agg(F.count("*").alias("n")).select(F.lit(name).alias("wanted"), "n")
        out = one if out is None else out.union(one)
    return out


@query(
    "scope_chain",
    f"""WITH n AS ({NOTICES}) SELECT notice_id, deadline FROM n
    WHERE deadline IS NOT NULL AND deadline >= DATE '1998-06-01' AND notice_status = 'O' AND {_IN}""",
)
def scope_chain(spark, sf):
    """P-10: named scopes chained with transform."""
    with_deadline = lambda df: df.where(F.col("deadline").isNotNull())
    still_open = lambda df: df.where(P.open_at(NOW))
    actionable = lambda df: df.where(F.col("notice_status") == "O")
    in_region = lambda df: df.where(F.col("country").isin(REGION))
    found = notices(spark, sf).transform(with_deadline).transform(still_open).transform(actionable).transform(in_region)
    return found.select("notice_id", "deadline")


@query(
    "stale_and_retry_due",
    f"""WITH n AS ({NOTICES}) SELECT notice_id,
    notice_date IS NULL OR notice_date < DATE '1998-06-01' - INTERVAL 90 DAY AS stale,
    deadline IS NULL OR deadline + INTERVAL 1 DAY * least(power(2, notice_id % 6), 16)::INT <= DATE '1998-06-01' AS retry_due FROM n""",
)
def stale_and_retry_due(spark, sf):
    """P-11: age cut-off, null or older, back-off elapsed."""
    wait = F.least(F.pow(F.lit(2), F.col("notice_id") % 6), F.lit(16)).cast("int")
    return notices(spark, sf).select(
        "notice_id",
        (F.col("notice_date").isNull() | (F.col("notice_date") < F.date_sub(F.lit(NOW), 90))).alias("stale"),
        (F.col("deadline").isNull() | (F.date_add("deadline", wait) <= F.lit(NOW))).alias("retry_due"),
    )


@query(
    "document_scopes",
    """SELECT lang, count(*) FILTER (WHERE n_chars >= 200) AS usable, count(*) FILTER (WHERE n_chars < 200) AS short,
    max(length(text)) AS longest FROM documents GROUP BY lang""",
)
def document_scopes(spark, sf):
    """P-12, P-19: scopes by length, and the length in place of the body."""
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count_if(F.col("n_chars") >= 200).alias("usable"),
        F.count_if(F.col("n_chars") < 200).alias("short"),
        F.max(F.length("text")).cast("long").alias("longest"),
    )


@query(
    "suspect_rows",
    """SELECT doc_id, quality, toxic FROM labels JOIN documents USING (doc_id)
    WHERE quality = 0 OR toxic = 1 OR lang = '' OR (lang = 'en' AND n_chars < 200) OR contains(source, 'src1')""",
)
def suspect_rows(spark, sf):
    """P-15: any of several weak signals."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    weak = [F.col("quality") == 0, F.col("toxic") == 1, F.col("lang") == "", (F.col("lang") == "en") & (F.col("n_chars") < 200), F.contains("source", F.lit("src1"))]
    return d.where(P.any_of(weak)).select("doc_id", "quality", "toxic")


@query(
    "computed_columns",
    f"""WITH n AS ({NOTICES}) SELECT notice_id, CAST(deadline - DATE '1998-06-01' AS INTEGER) AS days_left, deadline >= DATE '1998-06-01' AS is_open,
    'https://notices.example/' || notice_id AS url, coalesce(nullif(trim(category), ''), notice_id::VARCHAR) AS title FROM n""",
)
def computed_columns(spark, sf):
    """P-18, P-20"""
    return notices(spark, sf).select(
        "notice_id",
        F.datediff("deadline", F.lit(NOW)).alias("days_left"),
        P.open_at(NOW).alias("is_open"),
        F.concat(F.lit("https://notices.example/"), F.col("notice_id").cast("string")).alias("url"),
        P.first_nonblank("category", "notice_id").alias("title"),
    )


@query(
    "listing_filters",
    f"""WITH n AS ({NOTICES}) SELECT notice_id, category, amount FROM n WHERE upper(category) = 'BUILDING' AND amount >= 50000
    AND country IN ('NATION_1', 'NATION_2') AND deadline IS NOT NULL ORDER BY amount DESC NULLS LAST, notice_id LIMIT 50""",
)
def listing_filters(spark, sf):
    """P-21, P-22, O-05: filters, order and projection of a listing from a specification."""
    spec = {"category": ("iexact", "category"), "amount_from": ("gte", "amount"), "country": ("in", "country"), "undated": ("null", "deadline"), "status": ("exact", "notice_status")}
    given = {"category": "building", "amount_from": 50000.0, "country": ["NATION_1", "NATION_2"], "undated": False, "status": None}
    found = P.apply_filters(notices(spark, sf), spec, given)
    return O.ordered(found, "amount", {"amount": ["-amount", "notice_id"]}, "amount").limit(50).select("notice_id", "category", "amount")


@query(
    "plan_time_scope",
    "SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE CASE n_name WHEN 'NATION_2' THEN 'NATION_1' ELSE n_name END IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_7')",
)
def plan_time_scope(spark, sf):
    """P-23, F-13: canonical name by alias, then a semi join on the wanted set."""
    alias = F.create_map(F.lit("NATION_2"), F.lit("NATION_1"))
    wanted = table(spark, sf, "nation").where(F.col("n_name").isin(REGION)).select(F.col("n_name").alias("canonical"))
    named = table(spark, sf, "nation").withColumn("canonical", F.coalesce(alias[F.col("n_name")], "n_name"))
    return named.join(wanted, "canonical", "left_semi").select("n_nationkey", "n_name")


@query(
    "ownership",
    """SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 = 3 OR ('k' || (conv_id % 4) = 'k2' AND 'k2' <> '')""",
)
def ownership(spark, sf):
    """P-24: mine by user or by session; an empty session key matches nothing."""
    c = table(spark, sf, "conversations").select("conv_id", (F.col("conv_id") % 10).alias("user"), F.concat(F.lit("k"), (F.col("conv_id") % 4).cast("string")).alias("session"))
    mine = lambda user, key: (F.col("user") == user) | ((F.col("session") == key) if key else F.lit(False))
    return c.where(mine(3, "k2")).select("conv_id").union(c.where(mine(3, "")).select("conv_id")).distinct()


@query(
    "nulls_last_page",
    f"WITH n AS ({NOTICES}) SELECT notice_id, notice_date FROM n ORDER BY notice_date DESC NULLS LAST, notice_id DESC LIMIT 20 OFFSET 40",
)
def nulls_last_page(spark, sf):
    """O-01 to O-03"""
    return O.page(notices(spark, sf).select("notice_id", "notice_date"), ["-notice_date", "-notice_id"], 3, 20)


@query(
    "ascending_nulls_last",
    f"WITH n AS ({NOTICES}) SELECT notice_id, amount FROM n ORDER BY amount ASC NULLS LAST, notice_id LIMIT 100",
)
def ascending_nulls_last(spark, sf):
    """O-01, S-16: a page size over the limit is cut to it."""
    return O.page(notices(spark, sf).select("notice_id", "amount"), ["amount", "notice_id"], 1, 500)


@query(
    "keyset_page",
    """WITH t AS (SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY conv_id), p AS (
    SELECT *, count(*) OVER () AS c, row_number() OVER (ORDER BY conv_id DESC) AS r FROM (SELECT * FROM t WHERE conv_id < 60 ORDER BY conv_id DESC LIMIT 21))
    SELECT conv_id, turns, c > 20 AS has_more FROM p WHERE r <= 20""",
)
def keyset_page(spark, sf):
    """O-06"""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    return O.keyset(t, "conv_id", 60, 20)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf):
    """O-07"""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "open_first",
    f"""WITH n AS ({NOTICES}), t AS (SELECT notice_id, amount, deadline, row_number() OVER (ORDER BY amount DESC NULLS LAST, notice_id) AS place FROM n
    QUALIFY place <= 120) SELECT notice_id, coalesce(deadline >= DATE '1998-06-01', false) AS is_open, place FROM t ORDER BY is_open DESC, place LIMIT 10""",
)
def open_first(spark, sf):
    """O-08: twelve times as many as wanted, the open ones to the front, then cut."""
    top = notices(spark, sf).orderBy(F.desc_nulls_last("amount"), "notice_id").limit(120)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("amount"), "notice_id"))
    found = top.select("notice_id", F.coalesce(P.open_at(NOW), F.lit(False)).alias("is_open"), place.alias("place"))
    return found.orderBy(F.desc("is_open"), "place").limit(10)


@query(
    "tiered_queue",
    f"""WITH n AS ({NOTICES}) SELECT notice_id, CASE WHEN notice_date IS NULL THEN 0 WHEN deadline < DATE '1996-01-01' THEN 1 END AS tier
    FROM n WHERE notice_date IS NULL OR deadline < DATE '1996-01-01' ORDER BY tier, notice_id LIMIT 400""",
)
def tiered_queue(spark, sf):
    """O-09: never tried first, then due ones up to the remaining places."""
    due = [F.col("notice_date").isNull(), F.col("deadline") < F.lit(datetime.date(1996, 1, 1))]
    return O.tiers(notices(spark, sf), due, [F.col("notice_id")], 400).select("notice_id", "tier")


@query(
    "next_partition",
    f"""WITH n AS ({NOTICES}), p AS (SELECT country, count(*) AS total, max(notice_date) AS updated, min(notice_status) AS s FROM n GROUP BY country)
    SELECT country, total FROM p ORDER BY CASE WHEN updated > DATE '2001-07-25' THEN 0 WHEN s = 'F' THEN 1 ELSE 2 END,
    CASE WHEN s = 'F' THEN updated END NULLS LAST, total, country LIMIT 1""",
)
def next_partition(spark, sf):
    """O-11: recent, then in progress by oldest update, then smallest."""
    p = notices(spark, sf).groupBy("country").agg(F.count("*").alias("total"), F.max("notice_date").alias("updated"), F.min("notice_status").alias("s"))
    tier = F.when(F.col("updated") > F.lit(datetime.date(2001, 7, 25)), 0).when(F.col("s") == "F", 1).otherwise(2)
    return p.orderBy(tier, F.when(F.col("s") == "F", F.col("updated")).asc_nulls_last(), "total", "country").limit(1).select("country", "total")


@query(
    "display_order",
    """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, toxic DESC, doc_id) AS place
    FROM labels JOIN documents USING (doc_id)""",
)
def display_order(spark, sf):
    """O-12, O-13: within an owner, rank by a map, flags first, then key."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    rank = F.coalesce(F.create_map(F.lit("en"), F.lit(0), F.lit("de"), F.lit(1))[F.col("lang")], F.lit(2))
    ordered = d.select("source", "doc_id", rank.alias("rank"), (-F.col("toxic")).alias("flag"))
    return O.running(ordered, ["source"], ["rank", "flag", "doc_id"], F.lit(1), "place").select("source", "doc_id", F.col("place").cast("int").alias("place"))


@query("category_histogram", "SELECT category, n FROM (SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1) ORDER BY n DESC, category")
def category_histogram(spark, sf):
    """O-14"""
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


@query(
    "group_facet_zero_filled",
    """WITH v AS (SELECT r_regionkey, r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey), c AS (
    SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 GROUP BY n_name)
    SELECT r_name, n_name, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (n_name)""",
)
def group_facet_zero_filled(spark, sf):
    """M-17, S-13: every member of every group, zero where nothing matches."""
    nation = table(spark, sf, "nation")
    values = nation.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    counts = table(spark, sf, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    return A.zero_filled(values, counts, "n_name").select("r_name", "n_name", "n")
