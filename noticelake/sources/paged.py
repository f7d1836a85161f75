"""A paged JSON API as a Spark data source: one partition a page.

``fetch(offset, rows)`` returns the page as text and is given by the caller; a page that can't be
read becomes a row with its error, and the others still load.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "offset long, record string, error string"


def read_pages(spark: SparkSession, fetch: Callable[[int, int], str], total: int, rows: int, list_key: str, attempts: int = 3) -> DataFrame:
    """offset, record (JSON), error.  A payload with an ``error`` key counts as failed."""

    def load(it) -> Iterator:
        import pandas as pd

        for pdf in it:
            out = []
            for offset in pdf["offset"]:
                problem = ""
                for _ in range(attempts):
                    try:
                        page = json.loads(fetch(int(offset), rows), strict=False)
                        if "error" in page:
                            raise ValueError(str(page["error"]))
                        out += [(offset, json.dumps(r), None) for r in page.get(list_key, [])]
                        problem = ""
                        break
                    except Exception as e:  # any failure of a page is data
                        problem = f"{type(e).__name__}: {e}"
                if problem:
                    out.append((offset, None, problem))
            yield pd.DataFrame(out, columns=["offset", "record", "error"])

    pages = -(-total // rows)
    offsets = spark.range(0, pages, 1, max(1, min(pages, 200))).select((F.col("id") * rows).alias("offset"))
    return offsets.mapInPandas(load, SCHEMA)
