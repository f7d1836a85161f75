"""Batches cut by a budget, flushed in order, each with its row in a ledger; what was flushed is not done again."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEDGER = "range long, batch int, sources int, units long, status string, problem string"


def numbered(candidates: DataFrame, span: Column, units: str, most_units: int, most_sources: int) -> DataFrame:
    """``candidates`` (source, units) with ``range`` and ``batch`` (from 0 in each range).

    A batch is closed by the source that brings it to ``most_units`` units or ``most_sources`` sources, whichever comes
    first; sources without a unit are left out, as there is nothing to wait for.  ``span`` gives the range of a source, which
    bounds what one task walks through; batches don't cross ranges.
    """
    state = "struct<n:int,units:bigint,batch:int,out:array<struct<source:bigint,batch:int>>>"
    rows = candidates.where(F.col(units) > 0).select(span.cast("long").alias("range"), "source", F.col(units).cast("long").alias("u"))
    each = rows.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("source", "u"))).alias("s"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("units"), F.lit(0).alias("batch"), F.array().cast("array<struct<source:bigint,batch:int>>").alias("out")).cast(state)

    def step(st: Column, x: Column) -> Column:
        full = (st["units"] + x["u"] >= most_units) | (st["n"] + 1 >= most_sources)
        return F.struct(
            F.when(full, 0).otherwise(st["n"] + 1).alias("n"),
            F.when(full, F.lit(0).cast("long")).otherwise(st["units"] + x["u"]).alias("units"),
            F.when(full, st["batch"] + 1).otherwise(st["batch"]).alias("batch"),
            F.concat(st["out"], F.array(F.struct(x["source"].alias("source"), st["batch"].alias("batch")))).alias("out"),
        ).cast(state)

    cut = each.select("range", F.inline(F.aggregate("s", start, step)["out"]))
    return candidates.join(cut, "source")


def flush(batches: DataFrame, ledger: DataFrame, write: Callable[[pd.DataFrame], None], stop_on: tuple[type, ...] = ()) -> DataFrame:
    """Flush the batches that ``ledger`` (LEDGER) does not have as done; the rows to add to it.

    ``batches``: range, batch, source, units and what ``write`` needs of a source; ``write`` takes one batch.  A range is one
    task, its batches in order.  A batch that raises is a row with its problem and the next one goes on; after an
    exception of ``stop_on`` (the store is gone) the rest of the range is left for the next run.
    """
    done = ledger.where("status = 'done'").select("range", "batch")
    left = batches.join(done, ["range", "batch"], "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, own in pdf.sort_values(["batch", "source"]).groupby("batch", sort=True):
            row = [int(own["range"].iloc[0]), int(number), len(own), int(own["units"].sum())]
            try:
                write(own)
                out.append((*row, "done", ""))
            except Exception as e:  # told in the ledger
                out.append((*row, "failed", f"{type(e).__name__}: {e}"))
                if isinstance(e, stop_on):
                    break
        return pd.DataFrame(out, columns=["range", "batch", "sources", "units", "status", "problem"])

    return left.groupBy("range").applyInPandas(run, LEDGER)
