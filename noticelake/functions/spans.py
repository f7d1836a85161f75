"""Places of all matches of a pattern in a text, and cuts at words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,stop:int,text:string>"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, text>> of every match, in order; start counts from 0.  Null: none."""
    t = F.coalesce(text, F.lit(""))
    found, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("gap")))
    state = f"struct<at:int,out:array<{SPAN}>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")).cast(state)

    def step(st: Column, x: Column) -> Column:
        first = st["at"] + x["gap"]
        stop = first + F.length(x["m"])
        return F.struct(stop.alias("at"), F.concat(st["out"], F.array(F.struct(first.alias("start"), stop.alias("stop"), x["m"].alias("text")).cast(SPAN))).alias("out")).cast(state)

    return F.aggregate(pairs, start, step)["out"]


def before(text: Column, at: Column, most: int) -> Column:
    """The ``most`` characters in front of a place."""
    return F.substr(text, F.greatest(at - most, F.lit(0)) + 1, F.least(at, F.lit(most)))


def cut(text: Column, most: int, mark: str, trim: str = "") -> Column:
    """A text of at most ``most`` characters as it is; a longer one up to the last white space before ``most``, then ``mark``.

    Without white space there it is cut in the word, so that something is left.  ``trim``: pattern of what goes at the cut.
    """
    words = F.regexp_extract(text, rf"(?s)^(.{{0,{most - 1}}})\s", 1)
    kept = F.when(F.trim(words) == "", F.substring(text, 1, most - len(mark))).otherwise(words)
    kept = F.regexp_replace(kept, trim, "") if trim else kept
    return F.when(F.length(text) <= most, text).otherwise(F.concat(kept, F.lit(mark)))
