"""The notice-style tables over the given ones, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table

NOTICES = """
SELECT o_orderkey AS notice_id, o_orderpriority AS notice_type, o_orderstatus AS notice_status, n_name AS country,
       n_nationkey, n_regionkey, c_mktsegment AS category, c_custkey AS project_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS notice_date,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate + INTERVAL 30 DAY AS DATE) END AS deadline,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

AWARDS = """
SELECT l_orderkey AS notice_id, s_name AS supplier, n_name AS supplier_country, p_type AS category,
       CASE l_returnflag WHEN 'N' THEN 'USD' WHEN 'A' THEN 'EUR' ELSE 'UZS' END AS currency,
       CASE WHEN l_returnflag = 'N' AND l_linenumber % 9 = 0 THEN NULL ELSE l_extendedprice END AS price,
       CAST(l_shipdate AS DATE) AS award_date, l_linenumber
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
JOIN nation ON s_nationkey = n_nationkey
"""


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        key.alias("notice_id"),
        F.col("o_orderpriority").alias("notice_type"),
        F.col("o_orderstatus").alias("notice_status"),
        F.col("n_name").alias("country"),
        "n_nationkey",
        "n_regionkey",
        F.col("c_mktsegment").alias("category"),
        F.col("c_custkey").alias("project_id"),
        F.when(key % 7 != 0, date.cast("date")).alias("notice_date"),
        F.when(key % 5 != 0, F.date_add(date.cast("date"), 30)).alias("deadline"),
        F.when(key % 11 != 0, F.col("o_totalprice")).alias("amount"),
    )


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.col("l_orderkey").alias("notice_id"),
        F.col("s_name").alias("supplier"),
        F.col("n_name").alias("supplier_country"),
        F.col("p_type").alias("category"),
        F.when(flag == "N", "USD").when(flag == "A", "EUR").otherwise("UZS").alias("currency"),
        F.when(~((flag == "N") & (F.col("l_linenumber") % 9 == 0)), F.col("l_extendedprice")).alias("price"),
        F.col("l_shipdate").cast("date").alias("award_date"),
        "l_linenumber",
    )
