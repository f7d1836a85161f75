"""One run of a sync: pages applied to a keyed table, counted in the pass that writes, and its audit row."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .buckets import Keyed
from .incremental import latest_of_batch

#: Problems that an audit row carries.
PROBLEMS = 20
AUDIT = (
    "run string, trigger string, status string, started_at timestamp, finished_at timestamp, pages_fetched long, pages_failed long, seen long, "
    "created long, updated long, unchanged long, skipped long, out_of_scope long, superseded long, problems array<string>"
)


def status_of(fetched: int, failed: int) -> str:
    """failed without a page, partial with a failed one, else success."""
    return "failed" if not fetched else "partial" if failed else "success"


def sync(table: Keyed, pages: DataFrame, hashed: str, order: str, audit: str, in_scope: Column | None = None, trigger: str = "manual") -> dict:
    """Apply ``pages`` (page, error and the columns of ``table``) and append a row to the table of runs at ``audit``; the row.

    Of a key's rows the last by ``order`` counts, the others are superseded; rows without a key are skipped.  A page that
    failed is a row with its error.  Counts are observed while the table is written: the pages are fetched once, and
    nothing is read again to count it.
    """
    spark, started = pages.sparkSession, datetime.datetime.now()
    key, names = table.key, table.schema.names
    scope = F.coalesce(in_scope, F.lit(False)) if in_scope is not None else F.lit(True)
    seen, done = Observation(f"pages-{uuid.uuid4().hex}"), Observation(f"rows-{uuid.uuid4().hex}")
    row = F.col("error").isNull()
    fetched = pages.observe(
        seen,
        F.count_if(row).alias("seen"),
        F.count_if(row & F.col(key).isNull()).alias("skipped"),
        F.count_if(~row).alias("pages_failed"),
        F.size(F.collect_set(F.when(row, F.col("page")))).alias("pages_fetched"),
        F.slice(F.array_sort(F.collect_set("error")), 1, PROBLEMS).alias("problems"),
    )
    # one fetch; what is written below reads these rows
    batch = stored(fetched.where(F.col(key).isNotNull() | ~row), "pages").where(row).select(*names)
    latest = latest_of_batch(batch, key, order).withColumn("__in", scope)
    touched = table.touched(batch)
    old = table.read(touched)
    known = old.select(key, F.col(hashed).alias("__hash"), F.col(order).alias("__order"), F.lit(True).alias("__known"))
    older = F.coalesce(F.col(order) < F.col("__order"), F.lit(False))
    action = (
        F.when(~F.col("__in"), "out_of_scope").when(F.col("__known").isNull(), "created")
        .when((F.col("__hash") == F.col(hashed)) | older, "unchanged").otherwise("updated")
    )
    named = latest.join(known, key, "left").withColumn("__action", action)
    counts = [F.count_if(F.col("__action") == a).alias(a) for a in ("created", "updated", "unchanged", "out_of_scope")]
    # every incoming row passes here once; those that change nothing are dropped behind the count
    counted = named.observe(done, *counts, F.count("*").alias("keys")).where("__action IN ('created', 'updated')").select(*names)
    both = old.withColumn("__new", F.lit(0)).unionByName(counted.withColumn("__new", F.lit(1)))
    merged = both.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*names), "__new").alias("r")).select("r.*")
    if touched:
        table.put(merged, touched)
        got = done.get
    else:
        got = dict.fromkeys(("created", "updated", "unchanged", "out_of_scope", "keys"), 0)
    first = seen.get
    counters = {k: first[k] for k in ("pages_fetched", "pages_failed", "seen", "skipped")} | {k: got[k] for k in ("created", "updated", "unchanged", "out_of_scope")}
    counters["superseded"] = first["seen"] - first["skipped"] - got["keys"]
    found = {"run": uuid.uuid4().hex, "trigger": trigger, "status": status_of(first["pages_fetched"], first["pages_failed"]), "started_at": started, "finished_at": datetime.datetime.now()}
    found |= counters | {"problems": list(first["problems"] or [])}
    spark.createDataFrame([found], AUDIT).write.mode("append").parquet(audit)
    return found


def runs(spark: SparkSession, audit: str) -> DataFrame:
    """The table of runs."""
    return spark.read.schema(AUDIT).parquet(audit)
