"""Total orders, pages and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def nulls_last(*names: str) -> list[Column]:
    """``-name`` descends; nulls come last in either direction."""
    return [F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_last() for n in names]


def ordered(df: DataFrame, wanted: str | None, allowed: dict[str, list[str]], default: str) -> DataFrame:
    """Order by a whitelisted name; anything else falls back to the default."""
    return df.orderBy(*nulls_last(*allowed.get(wanted or default, allowed[default])))


def page(df: DataFrame, order: list[str], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """One page under a total order; a page size over ``most`` is cut to it."""
    size = max(1, min(size, most))
    return df.orderBy(*nulls_last(*order)).offset((max(1, number) - 1) * size).limit(size)


def envelope(df: DataFrame, order: list[str], number: int = 1, size: int = 20, most: int = 100) -> dict:
    """Page with its counts: count, total_pages, page, page_size, next, previous, results."""
    size, count = max(1, min(size, most)), df.count()
    pages = max(1, -(-count // size))
    return {
        "count": count,
        "total_pages": pages,
        "page": number,
        "page_size": size,
        "next": number + 1 if number < pages else None,
        "previous": number - 1 if number > 1 else None,
        "results": [r.asDict(recursive=True) for r in page(df, order, number, size, most).collect()],
    }


def keyset(df: DataFrame, key: str, before=None, size: int = 20) -> DataFrame:
    """Newest rows below a key, with has_more on each: one row over the page is looked at."""
    found = df if before is None else df.where(F.col(key) < F.lit(before))
    top = found.orderBy(F.col(key).desc()).limit(size + 1)
    whole = Window.partitionBy()  # at most size + 1 rows
    place = F.row_number().over(Window.partitionBy().orderBy(F.col(key).desc()))
    return top.withColumns({"has_more": F.count("*").over(whole) > size, "__place": place}).where(F.col("__place") <= size).drop("__place")


def tiers(df: DataFrame, conditions: list[Column], order: list[Column], limit: int) -> DataFrame:
    """Rows of the first condition first, then of the next, up to ``limit``: column tier from 0."""
    tier = F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(conditions))):
        tier = F.when(c, k).otherwise(tier)
    return df.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", *order).limit(limit)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key, as column place from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


class CountMemo:
    """Counts of plans, kept for a while: the same plan is counted once."""

    def __init__(self, seconds: float = 60, clock=None):
        import time

        self.seconds, self.clock, self.held = seconds, clock or time.monotonic, {}

    def count(self, df: DataFrame) -> int:
        """The count of ``df``; a plan is known by its hash, and by being the same plan."""
        now = self.clock()
        own = [x for x in self.held.get(df.semanticHash(), []) if now - x[0] <= self.seconds]
        for _, known, n in own:
            if known.sameSemantics(df):
                return n
        n = df.count()
        self.held[df.semanticHash()] = [*own, (now, df, n)]
        return n


def running(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of its key up to and with each row, in order.

    A key may hold most of the rows: they are dealt to ranges of (key, order), summed range by range, and
    only the totals of the ranges, a few a key, are added up in order.  ``order`` must tell the rows of a key
    apart, or those that tie stand in any order.  Nulls come first.
    """
    by = [*keys, *order]
    # stored, so that both passes see the same ranges
    dealt = stored(df.withColumn("__amount", amount).repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")
    so_far = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range", *keys).agg(F.sum("__amount").alias("__total"))
    base = totals.withColumn("__base", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("__range", *keys)]
    inside = dealt.withColumn("__sum", F.sum("__amount").over(so_far))
    joined = inside.alias("d").join(base.alias("b"), same)
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("d.__sum") + F.col("b.__base")).alias(name))


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of one ``value`` in a row: keys, island (from 1), value, n.  Null values make runs of their own kind."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)
    marked = df.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("__new").over(w))
    return marked.groupBy(*keys, "island", value).agg(F.count("*").alias("n"))
