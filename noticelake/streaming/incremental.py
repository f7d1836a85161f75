"""Incremental tables: hash-gated upserts, ledgers, retries, expiry.

Frames of (old, new) meet by joins on their key; ``buckets`` keeps such tables and rewrites what a change touches.
Every function is idempotent: applied to its own output it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_of_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; of rows that tie, the one whose columns are greatest in turn.

    The rows of a key fold where they are before they meet, however many there are.
    """
    row = F.struct(*batch.columns)
    best = batch.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(F.col(order).alias("o"), row.alias("row"))).alias("x"))
    return best.select("x.row.*")


def changes(old: DataFrame, new: DataFrame, key: str, hashed: str, in_scope: Column | None = None, order: str | None = None) -> DataFrame:
    """What an upsert does with each key of ``new``: key and action, once a key, as ``upsert`` applies one row of it.

    create, update, unchanged (also where the row is older than the one in ``old``); out_of_scope where the scope says no
    of the row that counts.  Rows without a key are skipped, each for itself.
    """
    scope = F.coalesce(in_scope, F.lit(False)) if in_scope is not None else F.lit(True)
    none = new.where(F.col(key).isNull()).select(key, F.lit("skipped").alias("action"))
    latest = latest_of_batch(new.where(F.col(key).isNotNull()), key, order or hashed).withColumn("__in", scope)
    known = old.select(F.col(key), F.col(hashed).alias("__old"), (F.col(order) if order else F.lit(None)).alias("__order"), F.lit(True).alias("__known"))
    older = F.coalesce(F.col(order) < F.col("__order"), F.lit(False)) if order else F.lit(False)
    action = (
        F.when(~F.col("__in"), "out_of_scope").when(F.col("__known").isNull(), "create")
        .when((F.col("__old") == F.col(hashed)) | older, "unchanged").otherwise("update")
    )
    return latest.join(known, key, "left").select(key, action.alias("action")).union(none)


def upsert(old: DataFrame, new: DataFrame, key: str, hashed: str, order: str | None = None) -> DataFrame:
    """``old`` with the changed and new rows of ``new``; rows with the same hash stay untouched.

    Of the rows of a key in ``new`` the last by ``order`` counts (without it, by the hash).  With ``order`` a
    row that is older than the one in ``old`` changes nothing; at a tie the new row stands.  Rows without a
    key go.
    """
    latest = latest_of_batch(new.where(F.col(key).isNotNull()).select(*old.columns), key, order or hashed)
    known = old.select(key, F.col(hashed).alias("__hash"), (F.col(order) if order else F.lit(None)).alias("__order"), F.lit(True).alias("__known"))
    later = F.col(order) >= F.col("__order") if order else F.lit(True)
    moved = F.col("__known").isNull() | ((F.col("__hash") != F.col(hashed)) & F.coalesce(later, F.lit(True)))
    fresh = latest.join(known, key, "left").where(F.coalesce(moved, F.lit(True))).select(*old.columns)
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh)


def pending(sources: DataFrame, ledger: DataFrame, key: str, on: list[str]) -> DataFrame:
    """Sources whose fingerprint, model or version the ledger doesn't have."""
    return sources.join(ledger.select(key, *on), [key, *on], "left_anti")


def next_state(rows: DataFrame, ok: Column, base: int, most: int, limit: int, now: Column) -> DataFrame:
    """Retry ledger after an attempt: status, attempts, next_retry_at."""
    attempts = F.when(ok, F.lit(0)).otherwise(F.col("attempts") + 1)
    wait = F.least(base * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(16))), F.lit(float(most))).cast("int")
    given_up = ~ok & (attempts >= limit)
    return rows.withColumns(
        {
            "status": F.when(ok, "done").when(given_up, "failed").otherwise("retry"),
            "next_retry_at": F.when(~ok & ~given_up, now + F.make_dt_interval(secs=wait)),
            "attempts": attempts,
        }
    )


def register_links(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The registry of links after ``found`` (url, notice, kind): key, url, kind, notices (distinct ids).

    A link is its hash.  Of several kinds the smallest, the most telling, stays, and every notice is attached.
    ``known`` is a registry from before; its links keep what they had.
    """
    rows = found.select(F.sha2("url", 256).alias("key"), "url", "kind", "notice")
    if known is not None:
        rows = rows.unionByName(known.select("key", "url", "kind", F.explode("notices").alias("notice")))
    return rows.groupBy("key").agg(F.min("url").alias("url"), F.min("kind").alias("kind"), F.array_sort(F.collect_set("notice")).alias("notices"))


def not_expired(store: DataFrame, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    return store.where(F.col(at) > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def overwrite(df: DataFrame, values: dict[str, Column], source: str, protected: tuple[str, ...]) -> DataFrame:
    """New values except where a row's provenance is protected."""
    free = ~F.coalesce(F.col(source).isin(*protected), F.lit(False))
    return df.withColumns({c: F.when(free, v).otherwise(F.col(c)) for c, v in values.items()})
