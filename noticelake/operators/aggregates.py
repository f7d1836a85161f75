"""Facets, one-pass statistics and three-valued folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """value, n: non-empty values by falling count, then value."""
    found = df.where((F.col(column) != "") & F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    found = found.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return found if limit is None else found.limit(limit)


def zero_filled(values: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Every legal value with its count, zero where none occurs."""
    return values.join(counts, key, "left").fillna(0, ["n"])


def sum_if(condition: Column, value: Column) -> Column:
    """Null where no row meets the condition."""
    return F.sum(F.when(condition, value))


def kleene_all(value: Column) -> Column:
    """AND over rows: false if any is false, else null if any is null, else true."""
    return F.when(F.bool_or(~value), False).when(F.count_if(value.isNull()) > 0, None).otherwise(F.lit(True))


def kleene_any(value: Column) -> Column:
    return F.when(F.bool_or(value), True).when(F.count_if(value.isNull()) > 0, None).otherwise(F.lit(False))


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    """Rounded share; null where the whole is zero."""
    return F.round(F.try_divide(part, whole), digits)


def readiness(df: DataFrame, keys: list[str], verdict: str, importance: str, mandatory: str, weights: dict[str, int]) -> DataFrame:
    """Weighted score of verdicts (true, false, null): score over what is settled or could still be won.

    earned, open and lost weights; score = earned / all, ceiling = (earned + open) / all; blocked
    if a mandatory verdict is false.
    """
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    w = F.coalesce(F.get(F.array(table[F.col(importance)]), F.lit(0)), F.lit(min(weights.values())))
    v = F.col(verdict)
    found = df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(v, w)), F.lit(0)).alias("earned"),
        F.coalesce(F.sum(F.when(v.isNull(), w)), F.lit(0)).alias("open"),
        F.coalesce(F.sum(F.when(~v, w)), F.lit(0)).alias("lost"),
        F.coalesce(F.bool_or(F.col(mandatory) & ~v), F.lit(False)).alias("blocked"),
    )
    total = F.col("earned") + F.col("open") + F.col("lost")
    return found.withColumns(
        {"score": rate(F.col("earned"), total), "ceiling": rate(F.col("earned") + F.col("open"), total)}
    )


def status(df: DataFrame, keys: list[str], verdict: str, mandatory: str) -> DataFrame:
    """blocked > incomplete > eligible over mandatory rows; unrated where there are none."""
    v, m = F.col(verdict), F.col(mandatory)
    return df.groupBy(*keys).agg(
        F.when(F.count_if(m) == 0, "unrated")
        .when(F.coalesce(F.bool_or(m & ~v), F.lit(False)), "blocked")
        .when(F.count_if(m & v.isNull()) > 0, "incomplete")
        .otherwise("eligible")
        .alias("status"),
        rate(F.count_if(v.isNotNull()), F.count("*")).alias("coverage"),
    )
