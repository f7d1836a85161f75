"""Predicates and scopes as Column builders; a scope maps a DataFrame for ``df.transform``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iexact(column: str, value: str) -> Column:
    """Equal up to case; % and _ stand for themselves."""
    return F.upper(F.col(column)) == F.upper(F.lit(value))


def icontains(column: Column | str, value: str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.contains(F.upper(c), F.upper(F.lit(value)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def search(columns: list[str], text: str) -> Column:
    """Every term between white space must occur in at least one of the columns."""
    return all_of([any_of([F.coalesce(icontains(c, term), F.lit(False)) for c in columns]) for term in text.split()])


def between(column: str, low=None, high=None) -> Column:
    """Inclusive range with open ends; pushed down to the scan as plain comparisons."""
    parts = []
    if low is not None:
        parts.append(F.col(column) >= F.lit(low))
    if high is not None:
        parts.append(F.col(column) <= F.lit(high))
    return all_of(parts)


def named_group(column: str, groups: dict[str, list[str]], name: str) -> Column:
    """Members of a known group; an unknown group matches nothing."""
    return F.col(column).isin(groups[name]) if name in groups else F.lit(False)


def tri_state(df: DataFrame, condition: Column, wanted: bool | None) -> DataFrame:
    """None leaves all rows; otherwise rows where the condition is known and as wanted."""
    if wanted is None:
        return df
    return df.where(condition if wanted else ~condition)


def focus(types: list[str], now, members: list[str]) -> Column:
    """Wanted type, still open, in the region: unknown parts count as no."""
    parts = [F.col("notice_type").isin(types), F.col("deadline") >= F.lit(now), F.col("country").isin(members)]
    return all_of([F.coalesce(p, F.lit(False)) for p in parts])


def out_of_focus(types: list[str], now, members: list[str]) -> Column:
    """The complement, spelled out: a null deadline belongs here."""
    return any_of(
        [
            F.coalesce(~F.col("notice_type").isin(types), F.lit(True)),
            F.col("deadline").isNull() | (F.col("deadline") < F.lit(now)),
            F.coalesce(~F.col("country").isin(members), F.lit(True)),
        ]
    )


def open_at(now) -> Column:
    """Null where there is no deadline."""
    return F.col("deadline") >= F.lit(now)


def nonblank(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def first_nonblank(*columns: str) -> Column:
    return F.coalesce(*[nonblank(F.col(c).cast("string")) for c in columns])


def apply_filters(df: DataFrame, spec: dict[str, tuple[str, str]], given: dict) -> DataFrame:
    """Filters of a listing: ``spec`` maps a parameter to (kind, column), ``given`` has its values.

    Kinds: exact, iexact, icontains, gte, lte, in, null.  Unknown parameters raise; None is no filter.
    """
    kinds = {
        "exact": lambda c, v: F.col(c) == F.lit(v),
        "iexact": iexact,
        "icontains": icontains,
        "gte": lambda c, v: F.col(c) >= F.lit(v),
        "lte": lambda c, v: F.col(c) <= F.lit(v),
        "in": lambda c, v: F.col(c).isin(list(v)),
        "null": lambda c, v: F.col(c).isNull() if v else F.col(c).isNotNull(),
    }
    for name, value in given.items():
        if name not in spec:
            raise KeyError(name)
        if value is not None:
            kind, column = spec[name]
            df = df.where(kinds[kind](column, value))
    return df
