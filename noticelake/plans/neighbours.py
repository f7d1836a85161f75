"""Neighbours of notices, kept in a keyed table and read through.

A row: notice, rank (from 0), neighbour, score, passage (the neighbour's best one), version.  A notice's rows are
replaced together; those of another version count as missing.  A notice without neighbours keeps no row,
so that the next reader asks again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import vectors as V
from ..streaming.buckets import Keyed

SCHEMA = "notice long, rank int, neighbour long, score double, passage long, version int"


def store(spark: SparkSession, path: str, buckets: int = 32) -> Keyed:
    return Keyed(spark, path, "notice", SCHEMA, buckets)


def compute(asked: DataFrame, representatives: DataFrame, passages: DataFrame, version: int, keep: int = 20, same: list[str] = ()) -> DataFrame:
    """Neighbours of the notices of ``asked`` (notice): the best ``keep`` other ones, by the best passage of each.

    ``representatives``: source, vec_id, the passages that stand for a notice (``vectors.representatives``);
    ``passages``: vec_id, notice, award, embedding and the columns of ``same``.  Only passages of awards are neighbours.
    """
    chosen = representatives.join(asked.select(F.col("notice").alias("source")).distinct(), "source", "left_semi")
    q = chosen.select("source", "vec_id").join(passages.select("vec_id", "embedding", *same), "vec_id").select(F.col("source").alias("qid"), F.col("embedding").alias("qvec"), *same)
    met = V.meet(passages.where("award").select("vec_id", "notice", "embedding", *same), q, list(same)).where("notice <> qid")
    scored = met.select("qid", "notice", "vec_id", V.cosine(F.col("embedding"), F.col("qvec")).alias("score"))
    best = scored.groupBy("qid", "notice").agg(F.max("score").alias("score"), F.min_by("vec_id", F.struct(-F.col("score"), "vec_id")).alias("passage"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "notice")) - 1
    kept = best.withColumn("rank", rank).where(F.col("rank") < keep)
    return kept.select(F.col("qid").alias("notice"), "rank", F.col("notice").alias("neighbour"), "score", "passage", F.lit(version).alias("version"))


def refresh(table: Keyed, asked: DataFrame, representatives: DataFrame, passages: DataFrame, version: int, **more) -> list[int]:
    """Compute and keep the neighbours of ``asked``; the buckets that were rewritten."""
    return table.replace(compute(asked, representatives, passages, version, **more), asked)


def read_through(table: Keyed, asked: DataFrame, representatives: DataFrame, passages: DataFrame, version: int, **more) -> DataFrame:
    """Kept neighbours of ``asked`` of this version; those that are missing are computed, once, and kept."""
    asked = asked.select("notice").distinct()
    touched = table.touched(asked)
    current = F.col("version") == version
    missing = asked.join(table.read(touched).where(current).select("notice"), "notice", "left_anti")
    if not missing.isEmpty():
        refresh(table, missing, representatives, passages, version, **more)
    return table.read(touched).where(current).join(asked, "notice", "left_semi")


def forget(table: Keyed, before: int | None = None, condition: Column | None = None) -> list[int]:
    """Rows of versions below ``before``, or that meet ``condition``, go."""
    return table.remove(condition if condition is not None else F.col("version") < before)
