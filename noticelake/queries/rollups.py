"""Joins, set operations and grouped rollups (J-*, U-*, A-07 to A-27, P-07, P-13, P-14)."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import fulltext as FT
from ..operators import ordering as O
from ..operators import vectors as V
from ..operators import predicates as P
from ..plans.standins import AWARDS, NOTICES, awards, notices
from ..registry import query, table
from ..session import stored


@query(
    "company_rollup",
    f"""WITH a AS ({AWARDS}) SELECT supplier, max(supplier_country) AS country, count(*) AS wins, min(award_date) AS first_award,
    max(award_date) AS last_award, round(sum(price) FILTER (WHERE currency = 'USD'), 2) AS total_usd,
    count(*) FILTER (WHERE currency = 'USD' AND price IS NOT NULL) AS usd_awards FROM a GROUP BY supplier
    ORDER BY wins DESC, supplier LIMIT 300""",
)
def company_rollup(spark, sf):
    """A-07, O-05: wins, dates and the sums in one currency, by company."""
    usd = F.col("currency") == "USD"
    found = awards(spark, sf).groupBy("supplier").agg(
        F.max("supplier_country").alias("country"),
        F.count("*").alias("wins"),
        F.min("award_date").alias("first_award"),
        F.max("award_date").alias("last_award"),
        F.round(A.sum_if(usd, F.col("price")), 2).alias("total_usd"),
        F.count_if(usd & F.col("price").isNotNull()).alias("usd_awards"),
    )
    return O.ordered(found, "-wins", {"-wins": ["-wins", "supplier"], "-total_usd": ["-total_usd", "supplier"]}, "-wins").limit(300)


@query(
    "company_summary",
    f"""WITH a AS ({AWARDS}), s AS (SELECT supplier, count(*) AS wins, round(sum(price) FILTER (WHERE currency = 'USD'), 2) AS total_usd,
    max(award_date) AS latest FROM a GROUP BY supplier), c AS (SELECT supplier, category, count(*) AS n FROM a WHERE category <> '' GROUP BY 1, 2),
    t AS (SELECT supplier, category AS top_category, n AS top_n FROM c QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY n DESC, category) = 1)
    SELECT supplier, wins, total_usd, latest, top_category, top_n FROM s JOIN t USING (supplier)""",
)
def company_summary(spark, sf):
    """A-08"""
    a = awards(spark, sf)
    s = a.groupBy("supplier").agg(F.count("*").alias("wins"), F.round(A.sum_if(F.col("currency") == "USD", F.col("price")), 2).alias("total_usd"), F.max("award_date").alias("latest"))
    c = a.where("category <> ''").groupBy("supplier", "category").agg(F.count("*").alias("n"))
    top = c.groupBy("supplier").agg(F.min_by(F.struct("category", "n"), F.struct(-F.col("n"), "category")).alias("t"))
    return s.join(top, "supplier").select("supplier", "wins", "total_usd", "latest", F.col("t.category").alias("top_category"), F.col("t.n").alias("top_n"))


@query("year_histogram", f"WITH n AS ({NOTICES}) SELECT CAST(year(notice_date) AS INTEGER) AS year, count(*) AS n FROM n WHERE notice_date IS NOT NULL GROUP BY 1")
def year_histogram(spark, sf):
    """A-09"""
    return notices(spark, sf).where("notice_date IS NOT NULL").groupBy(F.year("notice_date").alias("year")).agg(F.count("*").alias("n"))


@query(
    "status_window",
    """SELECT event_type AS status, count(*) AS runs, max(ts) AS last_run, max(ts) FILTER (WHERE value > 50) AS last_success,
    arg_max(event_id, (ts, event_id)) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND ts <= TIMESTAMP '2024-01-30' GROUP BY 1""",
)
def status_window(spark, sf):
    """A-10: runs of a trailing day, last run and last success."""
    e = table(spark, sf, "events")
    first, last = (F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in ("2024-01-29", "2024-01-30"))
    return e.where(P.between("ts", first, last)).groupBy(F.col("event_type").alias("status")).agg(
        F.count("*").alias("runs"),
        F.max("ts").alias("last_run"),
        F.max(F.when(F.col("value") > 50, F.col("ts"))).alias("last_success"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"),
    )


@query(
    "project_drilldown",
    """WITH l AS (SELECT l_orderkey, count(*) AS items, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1),
    o AS (SELECT o_custkey, count(*) AS orders, max(o_orderdate)::DATE AS latest, coalesce(sum(items), 0)::BIGINT AS items FROM orders
    LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT c_custkey, c_name, coalesce(orders, 0) AS orders, latest, coalesce(items, 0) AS items FROM customer LEFT JOIN o ON c_custkey = o_custkey""",
)
def project_drilldown(spark, sf):
    """A-11, J-10: each child is grouped before it is joined, so counts don't multiply."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    orders = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").cast("date").alias("latest"), F.sum("k").alias("items"))
    found = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return found.select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), "latest", F.coalesce("items", F.lit(0)).alias("items"))


@query(
    "corpus_report",
    """SELECT count(*) AS documents, count(*) FILTER (WHERE n_chars >= 200) AS usable, count(*) FILTER (WHERE n_chars < 200) AS short,
    count(*) FILTER (WHERE source = 'src0') AS walled, count(*) FILTER (WHERE text LIKE '%http%') AS with_link,
    round(avg(n_chars) FILTER (WHERE n_chars >= 200), 2) AS mean_chars,
    round(count(*) FILTER (WHERE n_chars >= 200) / nullif(count(*) FILTER (WHERE source <> 'src0'), 0), 3) AS reachable FROM documents""",
)
def corpus_report(spark, sf):
    """A-12"""
    usable, tried = F.col("n_chars") >= 200, F.col("source") != "src0"
    return table(spark, sf, "documents").agg(
        F.count("*").alias("documents"),
        F.count_if(usable).alias("usable"),
        F.count_if(~usable).alias("short"),
        F.count_if(~tried).alias("walled"),
        F.count_if(F.contains("text", F.lit("http"))).alias("with_link"),
        F.round(F.avg(F.when(usable, F.col("n_chars"))), 2).alias("mean_chars"),
        A.rate(F.count_if(usable), F.count_if(tried)).alias("reachable"),
    )


@query(
    "extraction_report",
    """SELECT event_type AS layer, round(coalesce(sum(value), 0), 2) AS cost, count(*) AS runs, count(*) FILTER (WHERE value > 90) AS yielded,
    round(count(*) FILTER (WHERE value > 90) / nullif(count(*), 0), 3) AS yield_rate, round(count(DISTINCT user_id) / nullif(count(*), 0), 3) AS coverage
    FROM events GROUP BY 1""",
)
def extraction_report(spark, sf):
    """A-13"""
    good = F.col("value") > 90
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("layer")).agg(
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("cost"),
        F.count("*").alias("runs"),
        F.count_if(good).alias("yielded"),
        A.rate(F.count_if(good), F.count("*")).alias("yield_rate"),
        A.rate(F.countDistinct("user_id"), F.count("*")).alias("coverage"),
    )


@query(
    "index_progress",
    f"""WITH n AS ({NOTICES}), p AS (SELECT country, count(*) AS total, count(*) FILTER (WHERE notice_date IS NOT NULL) + 20 AS offset_ FROM n GROUP BY 1)
    SELECT count(*) AS partitions, count(*) FILTER (WHERE offset_ >= total) AS done, sum(least(offset_, total))::BIGINT AS walked,
    round(100 * count(*) FILTER (WHERE offset_ >= total) / count(*), 1) AS percent FROM p""",
)
def index_progress(spark, sf):
    """A-19: rows walked never count over a partition's total."""
    p = notices(spark, sf).groupBy("country").agg(F.count("*").alias("total"), (F.count_if(F.col("notice_date").isNotNull()) + 20).alias("at"))
    done = F.count_if(F.col("at") >= F.col("total"))
    return p.agg(F.count("*").alias("partitions"), done.alias("done"), F.sum(F.least("at", "total")).alias("walked"), F.round(100 * done / F.count("*"), 1).alias("percent"))


@query(
    "live_status",
    f"""WITH n AS ({NOTICES}), a AS (SELECT * FROM n WHERE deadline >= DATE '1998-06-01') SELECT count(*) AS active,
    count(*) FILTER (WHERE notice_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS read,
    count(*) FILTER (WHERE notice_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS pending,
    count(*) FILTER (WHERE project_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS stalled FROM a""",
)
def live_status(spark, sf):
    """A-21: membership flags by left joins on distinct keys, then one aggregate."""
    active = notices(spark, sf).where(P.open_at(datetime.date(1998, 6, 1)))
    read = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("notice_id"), F.lit(True).alias("was_read")).distinct()
    poor = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("project_id"), F.lit(True).alias("poor"))
    found = active.join(read, "notice_id", "left").join(poor, "project_id", "left")
    return found.agg(F.count("*").alias("active"), F.count("was_read").alias("read"), F.count_if(F.col("was_read").isNull()).alias("pending"), F.count("poor").alias("stalled"))


@query(
    "recent_runs",
    """WITH i AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(parts, 0) AS parts, coalesce(suppliers, 0) AS suppliers FROM orders LEFT JOIN i ON o_orderkey = l_orderkey
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 30""",
)
def recent_runs(spark, sf):
    """A-22: newest runs first, children counted for those alone."""
    runs = table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey")
    children = table(spark, sf, "lineitem").join(runs, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    counts = children.groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))
    found = runs.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return found.select("o_orderkey", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("pending_counts", "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def pending_counts(spark, sf):
    """A-23"""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "evaluation_report",
    """SELECT lang, median(n_chars) AS median_chars, round(avg(n_chars), 2) AS mean_chars,
    round(count(*) FILTER (WHERE n_chars >= 5000) / count(*), 3) AS long_rate FROM documents GROUP BY lang""",
)
def evaluation_report(spark, sf):
    """A-24"""
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.median("n_chars").alias("median_chars"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), A.rate(F.count_if(F.col("n_chars") >= 5000), F.count("*")).alias("long_rate")
    )


@query(
    "counters_merge",
    """SELECT l_orderkey, sum(l_linenumber)::BIGINT AS total, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS flags,
    min(l_linestatus) FILTER (WHERE l_linestatus <> 'F') AS first_error FROM lineitem GROUP BY 1""",
)
def counters_merge(spark, sf):
    """A-25: integers add, lists join in order, the first non-empty text stays."""
    flags = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_linenumber").alias("total"), F.array_join(F.transform(flags, lambda x: x["l_returnflag"]), "").alias("flags"), F.min(F.when(F.col("l_linestatus") != "F", F.col("l_linestatus"))).alias("first_error")
    )


@query("requirement_dropdown", "SELECT s_suppkey AS id, s_name AS title, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def requirement_dropdown(spark, sf):
    """A-26"""
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return counts.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), "n")


@query(
    "cost_model",
    """WITH p(prefix, price) AS (VALUES ('p', 2.0), ('purchase', 5.0), ('c', 1.0), ('click', 3.0), ('', 0.5)), m AS (
    SELECT event_id, event_type, value, price FROM events JOIN p ON starts_with(event_type, prefix)
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY length(prefix) DESC) = 1)
    SELECT event_type, round(sum(value * price * CASE WHEN event_id % 3 = 0 THEN 0.1 WHEN event_id % 3 = 1 THEN 1.25 ELSE 1 END) / 1000000, 6) AS cost FROM m GROUP BY 1""",
)
def cost_model(spark, sf):
    """A-27: price by longest prefix, cached tokens at a tenth, cache writes at five quarters."""
    prices = spark.createDataFrame([("p", 2.0), ("purchase", 5.0), ("c", 1.0), ("click", 3.0), ("", 0.5)], "prefix string, price double")
    kinds = table(spark, sf, "events").select("event_type").distinct()
    priced = kinds.join(F.broadcast(prices), F.startswith("event_type", "prefix")).groupBy("event_type").agg(F.max_by("price", F.length("prefix")).alias("price"))
    factor = F.when(F.col("event_id") % 3 == 0, 0.1).when(F.col("event_id") % 3 == 1, 1.25).otherwise(1.0)
    found = table(spark, sf, "events").join(priced, "event_type").groupBy("event_type")
    return found.agg(F.round(F.sum(F.col("value") * F.col("price") * factor) / 1000000, 6).alias("cost"))


@query(
    "has_related_semi_anti",
    """WITH big AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM big) AS has_award FROM customer""",
)
def has_related_semi_anti(spark, sf):
    """P-07, J-05, J-06"""
    big = table(spark, sf, "orders").where("o_totalprice > 300000")
    c, same = table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")
    yes = c.join(big, same, "left_semi").select("c_custkey", F.lit(True).alias("has_award"))
    return yes.union(c.join(big, same, "left_anti").select("c_custkey", F.lit(False).alias("has_award")))


@query(
    "inner_and_left",
    f"""WITH n AS ({NOTICES}), a AS ({AWARDS}), w AS (SELECT notice_id, min(supplier) AS supplier FROM a WHERE currency = 'UZS' GROUP BY 1)
    SELECT notice_id, category, supplier FROM n LEFT JOIN w USING (notice_id)""",
)
def inner_and_left(spark, sf):
    """J-01, J-02"""
    w = awards(spark, sf).where("currency = 'UZS'").groupBy("notice_id").agg(F.min("supplier").alias("supplier"))
    return notices(spark, sf).join(w, "notice_id", "left").select("notice_id", "category", "supplier")


def listing(orders, customers, by: str):
    """The first forty orders; customers are joined only if the order asks for their balance."""
    if by == "balance":
        c = customers.select("c_custkey", "c_acctbal")
        return orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").orderBy(F.desc_nulls_last("c_acctbal"), "o_orderkey").limit(40).select("o_orderkey", "o_custkey")
    return orders.orderBy("o_orderkey").limit(40).select("o_orderkey", "o_custkey")


@query(
    "join_only_if_sorted",
    """(SELECT 'key' AS sorted_by, o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 40) UNION ALL
    (SELECT 'balance', o_orderkey, o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY c_acctbal DESC NULLS LAST, o_orderkey LIMIT 40)""",
)
def join_only_if_sorted(spark, sf):
    """J-03: both orders; the tests see that the first has no join in its plan."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    parts = [listing(o, c, by).select(F.lit(by).alias("sorted_by"), "o_orderkey", "o_custkey") for by in ("key", "balance")]
    return parts[0].union(parts[1])


@query("resolved_reference", "SELECT l_orderkey, l_linenumber, l_partkey, p_partkey AS resolved FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON l_partkey = p_partkey")
def resolved_reference(spark, sf):
    """J-04: a reference resolves only where the parent exists."""
    parents = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("resolved"))
    found = table(spark, sf, "lineitem").join(parents, F.col("l_partkey") == F.col("resolved"), "left")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "resolved")


@query("bridge_distinct", "SELECT DISTINCT p_partkey, p_brand FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1995-06-01'")
def bridge_distinct(spark, sf):
    """J-07: many to many through a bridge, each parent once, by semi joins without a distinct."""
    wanted = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP_NTZ '1995-06-01'")
    bridge = table(spark, sf, "lineitem").join(wanted, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return table(spark, sf, "part").join(bridge, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query(
    "prefetched_children",
    """SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS roles, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def prefetched_children(spark, sf):
    """J-08, M-45, M-25: families with their roles in order."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("c"))
    found = table(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return found.select("r_name", F.array_join(F.transform("c", lambda x: x["n_name"]), ",").alias("roles"), F.size("c").cast("long").alias("n"))


@query("first_related", "SELECT l_partkey, min(l_orderkey) AS notice_id, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS supplier FROM lineitem GROUP BY 1")
def first_related(spark, sf):
    """J-09"""
    first = F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey"))
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("notice_id"), first.alias("supplier"))


@query(
    "names_in_list",
    """WITH lists AS (SELECT l_orderkey, string_agg(DISTINCT s_name, ', ') AS names FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
    e AS (SELECT l_orderkey, lower(trim(unnest(string_split(names, ',')))) AS k FROM lists) SELECT s_suppkey, count(DISTINCT l_orderkey) AS n FROM e JOIN supplier ON lower(s_name) = k GROUP BY 1""",
)
def names_in_list(spark, sf):
    """J-11, M-11, M-14: names in a comma list, exploded and joined on the folded key."""
    lists = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lists = lists.groupBy("l_orderkey").agg(F.array_join(F.collect_set("s_name"), ", ").alias("names"))
    each = lists.select("l_orderkey", F.explode(F.split("names", ",")).alias("k")).withColumn("k", F.lower(F.trim("k"))).distinct()
    return each.join(table(spark, sf, "supplier"), F.lower("s_name") == F.col("k")).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query(
    "shared_name_token",
    """WITH p AS (SELECT p_name, count(*) AS rows_, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 2) AS t FROM part GROUP BY p_name),
    e AS (SELECT p_name, rows_, unnest(t) AS w FROM p) SELECT DISTINCT a.p_name AS a, b.p_name AS b, a.rows_ AS rows_a, b.rows_ AS rows_b FROM e a JOIN e b ON a.w = b.w AND a.p_name < b.p_name""",
)
def shared_name_token(spark, sf):
    """J-12: distinct names that share a folded token over two letters, and how many rows bear each."""
    words = F.filter(F.split(F.lower("p_name"), " "), lambda x: F.length(x) > 2)
    names = table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    e = names.select("p_name", "n", F.explode(words).alias("w"))
    a = e.select(F.col("p_name").alias("a"), F.col("n").alias("rows_a"), "w")
    b = e.select(F.col("p_name").alias("b"), F.col("n").alias("rows_b"), "w")
    return a.join(b, "w").where("a < b").select("a", "b", "rows_a", "rows_b").distinct()


@query(
    "priority_merge",
    """WITH f AS (SELECT doc_id, nullif(source, 'src0') AS source, lang FROM documents), l AS (SELECT doc_id + 3 AS doc_id, CASE quality WHEN 1 THEN 'good' END AS source, 'xx' AS lang FROM labels)
    SELECT coalesce(l.doc_id, f.doc_id) AS doc_id, coalesce(l.source, f.source, 'none') AS source, coalesce(f.lang, l.lang) AS lang FROM f FULL JOIN l ON f.doc_id = l.doc_id""",
)
def priority_merge(spark, sf):
    """J-13, M-12: fields from the first source that has them."""
    f = table(spark, sf, "documents").select("doc_id", F.nullif("source", F.lit("src0")).alias("fs"), F.col("lang").alias("fl"))
    l = table(spark, sf, "labels").select((F.col("doc_id") + 3).alias("doc_id"), F.when(F.col("quality") == 1, "good").alias("ls"), F.lit("xx").alias("ll"))
    return f.join(l, "doc_id", "full").select("doc_id", F.coalesce("ls", "fs", F.lit("none")).alias("source"), F.coalesce("fl", "ll").alias("lang"))


@query(
    "shortlist_per_role",
    "SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY s_name, s_suppkey) <= 5",
)
def shortlist_per_role(spark, sf):
    """J-14"""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return O.first_per_key(s, ["n_name"], [F.col("s_name"), F.col("s_suppkey")], 5).select("n_name", "s_name")


@query(
    "declarations_in_order",
    "SELECT d.source, l.doc_id, t.toxic AS answer, row_number() OVER (PARTITION BY d.source ORDER BY l.doc_id) AS place FROM labels l JOIN documents d USING (doc_id) LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) t USING (doc_id)",
)
def declarations_in_order(spark, sf):
    """J-15"""
    l = table(spark, sf, "labels")
    answers = l.where("toxic = 1").select("doc_id", F.col("toxic").alias("answer"))
    owned = l.select("doc_id").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    rows = owned.join(answers, "doc_id", "left").select("source", "doc_id", "answer")
    return O.running(rows, ["source"], ["doc_id"], F.lit(1), "place").withColumn("place", F.col("place").cast("int"))


#: Whole words inside a quote that key it.
QUOTE_WORDS = 3


def quoted(docs: DataFrame, quotes: DataFrame, index: FT.Index | Callable[[], FT.Index]) -> DataFrame:
    """(item_id, doc_id) for every document whose text holds the item's quote, in any case.

    The words of a quote but its first and last stand whole wherever the quote does.  Quotes of many words meet
    documents on the hash of the first QUOTE_WORDS of these, quotes of three or four on the rarest of their
    terms in the stored ``index`` of the documents (or a function that writes it, which is asked only where there are
    such quotes); every hit is verified.  Quotes without a whole word inside are a
    stated list that is held against all texts.
    """
    words = lambda c: F.split(F.lower(c), " ")
    run = lambda w, at: F.xxhash64(F.slice(w, at, F.lit(QUOTE_WORDS)))
    held, n = F.contains(F.lower("text"), F.lower("quote")), F.size(words(F.col("quote")))
    inner = FT.tokens(F.array_join(F.slice(words(F.col("quote")), F.lit(2), F.greatest(n - 2, F.lit(0))), " "))
    kind = F.when(n >= QUOTE_WORDS + 2, "long").when((n >= 3) & (F.size(inner) > 0), "short").otherwise("bare")
    quotes = quotes.withColumn("kind", kind)
    long, short, bare = (quotes.where(F.col("kind") == k) for k in ("long", "short", "bare"))
    keys = long.select("item_id", run(words(F.col("quote")), F.lit(2)).alias("key"))
    w = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") >= QUOTE_WORDS)
    runs = w.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (QUOTE_WORDS - 1)), lambda at: run(F.col("w"), at)))).alias("key"))
    met = runs.join(keys, "key").select("item_id", "doc_id")
    if not short.isEmpty():
        index = index() if callable(index) else index
        terms = short.select("item_id", F.explode(inner).alias("term")).withColumn("stem", FT.stem(F.col("term")))
        rare = terms.join(index.stems, "stem").groupBy("item_id").agg(F.min_by(F.struct("stem", "term"), "docs").alias("x")).select("item_id", "x.*")
        met = met.union(index.of(rare).select("stem", "term", "doc_id").join(F.broadcast(rare), ["stem", "term"]).select("item_id", "doc_id"))
    found = stored(met.distinct(), "quotes-met").join(docs, "doc_id").join(quotes, "item_id").where(held)
    every = V.meet(docs, bare.select(F.col("item_id").alias("qid"), "quote")).where(held)
    return found.select("item_id", "doc_id").union(every.select("qid", "doc_id"))


@query(
    "quote_containment",
    "WITH q AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS quote FROM benchmark) SELECT item_id, count(*) AS n FROM q JOIN documents d ON contains(lower(d.text), lower(quote)) GROUP BY 1",
)
def quote_containment(spark, sf):
    """J-16, X-05: the first five words of an item as a quote, found in any document."""
    b = table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("quote"))
    return quoted(table(spark, sf, "documents").select("doc_id", "text"), b, lambda: FT.index_of(table(spark, sf, "documents"))).groupBy("item_id").agg(F.count("*").alias("n"))


@query(
    "quote_matches",
    """WITH q AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS quote FROM benchmark)
    SELECT item_id, count(*) AS n FROM q JOIN documents d ON contains(lower(d.text), lower(quote)) GROUP BY 1""",
)
def quote_matches(spark, sf):
    """J-16, X-05: an item's first eight words, in all documents."""
    quotes = table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("quote"))
    return quoted(table(spark, sf, "documents").select("doc_id", "text"), quotes, lambda: FT.index_of(table(spark, sf, "documents"))).groupBy("item_id").agg(F.count("*").alias("n"))


@query(
    "json_text_search",
    """WITH b AS (SELECT l_orderkey, list(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey FROM orders JOIN b ON o_orderkey = l_orderkey
    WHERE len(s) > 0 AND (list_contains(s, 7) OR o_orderpriority = '1-URGENT')""",
)
def json_text_search(spark, sf):
    """P-13, P-14: non-empty array, and a match inside it or on the row."""
    b = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    found = table(spark, sf, "orders").join(b, F.col("o_orderkey") == F.col("l_orderkey"))
    return found.where((F.size("s") > 0) & (F.exists("s", lambda x: x == 7) | (F.col("o_orderpriority") == "1-URGENT"))).select("o_orderkey")


@query(
    "participants_union",
    """WITH j AS (SELECT l_orderkey, s_name, l_returnflag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT DISTINCT l_orderkey, s_name, CASE l_returnflag WHEN 'A' THEN 'awardee' WHEN 'N' THEN 'evaluated' ELSE 'rejected' END AS role FROM j WHERE s_name <> ''""",
)
def participants_union(spark, sf):
    """U-01: three lists of bidders with their roles, blanks dropped."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    of = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("s_name")))
    lists = j.groupBy("l_orderkey").agg(of("A").alias("a"), of("N").alias("n"), of("R").alias("r"))
    tagged = lambda c, role: F.transform(c, lambda x: F.struct(x.alias("s_name"), F.lit(role).alias("role")))
    every = F.concat(tagged("a", "awardee"), tagged("n", "evaluated"), tagged("r", "rejected"))
    return lists.select("l_orderkey", F.inline(every)).where("trim(s_name) <> ''")


@query(
    "ordered_union_first",
    """WITH u AS (SELECT p_partkey, 0 AS arm, p_retailprice AS score FROM part WHERE p_size = 7 UNION ALL SELECT p_partkey, 1, p_retailprice FROM part WHERE p_brand = 'Brand#13')
    SELECT p_partkey, arm FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY arm) = 1""",
)
def ordered_union_first(spark, sf):
    """U-02: union of arms, the earlier arm keeps a row."""
    p = table(spark, sf, "part")
    u = p.where("p_size = 7").select("p_partkey", F.lit(0).alias("arm")).union(p.where("p_brand = 'Brand#13'").select("p_partkey", F.lit(1).alias("arm")))
    return u.groupBy("p_partkey").agg(F.min("arm").alias("arm"))


@query(
    "set_union_minus_known",
    "SELECT n FROM (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal > 9000 UNION SELECT DISTINCT s_nationkey FROM supplier) WHERE n NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
)
def set_union_minus_known(spark, sf):
    """U-03"""
    c = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n"))
    known = table(spark, sf, "nation").where("n_regionkey = 2")
    every = c.union(table(spark, sf, "supplier").select("s_nationkey")).distinct()
    return every.join(known, F.col("n") == F.col("n_nationkey"), "left_anti")


@query(
    "create_update_split",
    """WITH old AS (SELECT p_partkey, p_brand FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 5 <> 0)
    SELECT coalesce(old.p_partkey, new.p_partkey) AS p_partkey, CASE WHEN old.p_partkey IS NULL THEN 'create' WHEN new.p_partkey IS NULL THEN 'gone' WHEN old.p_brand <> new.p_brand THEN 'update' ELSE 'same' END AS action
    FROM old FULL JOIN new ON old.p_partkey = new.p_partkey""",
)
def create_update_split(spark, sf):
    """U-04"""
    p = table(spark, sf, "part")
    old = p.where("p_partkey % 3 <> 0").select("p_partkey", F.col("p_brand").alias("before"))
    new = p.where("p_partkey % 5 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(F.col("p_brand")).alias("after"))
    action = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "gone").when(F.col("before") != F.col("after"), "update").otherwise("same")
    return old.join(new, "p_partkey", "full").select("p_partkey", action.alias("action"))


@query(
    "word_set_jaccard",
    """WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS s FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS t FROM w a JOIN w b ON b.item_id = a.item_id + 1)
    SELECT a, b, round(i / (t - i), 6) AS jaccard FROM p""",
)
def word_set_jaccard(spark, sf):
    """U-05, U-06"""
    w = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))
    a, b = w.select(F.col("item_id").alias("a"), F.col("s").alias("x")), w.select(F.col("item_id").alias("b"), F.col("s").alias("y"))
    pairs = a.join(b, F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


@query(
    "prune_dry_run",
    f"WITH n AS ({NOTICES}) SELECT count(*) FILTER (WHERE country NOT IN ('NATION_1', 'NATION_3')) AS would_go, count(*) FILTER (WHERE country IN ('NATION_1', 'NATION_3')) AS stays FROM n",
)
def prune_dry_run(spark, sf):
    """U-07: what a prune to the scope would delete."""
    inside = F.coalesce(F.col("country").isin("NATION_1", "NATION_3"), F.lit(False))
    return notices(spark, sf).agg(F.count_if(~inside).alias("would_go"), F.count_if(inside).alias("stays"))
