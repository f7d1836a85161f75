"""What several operators share: the shared folder, stored intermediates, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import let
from ..session import shared_dir, short_batches

__all__ = ["SPACE", "batches", "held_small", "let", "one_space", "ranges", "shared_dir", "short_batches", "stored", "table", "text_key", "utf8", "without", "word_array"]

#: Regular expression of the white space that separates words in the contracts.
SPACE = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table survives the loss of any executor, cuts the lineage, and is what later
    passes scan, so the work above it runs once.  Its shuffle files are of no more use then
    and go at once; the tables go with the application's folder, when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """What tells rows of one doc_id apart: a hash of the text, null as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, held: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` that are not in ``dropped`` (doc_id, text_key), which is broadcast if it is short.

    A row is its doc_id and text: of rows that repeat a doc_id only those go whose text is named, and
    null and empty texts are one.  A null doc_id stays.
    """
    ids = stored(dropped.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "dropped")
    gone = (docs["doc_id"] == ids["__id"]) & (text_key(docs["text"]) == ids["__key"])
    return docs.join(held_small(ids, held), gone, "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_space(text: Column) -> Column:
    """Null as empty; every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def word_array(text: Column) -> Column:
    """Words between white space, unchanged; null or blank text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each pair, without a Python loop."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def held_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a stored table) marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df
