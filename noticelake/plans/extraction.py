"""Layered extraction: the cheap layer first, later layers told what is known, every quote checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T
from ..session import short_batches

ROWS = "doc_id long, key string, value double, quote string, problem string"


def worth_asking(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with a sentence in requirement language that is about no key already known.

    ``known``: doc_id, key.  The language is wider than the marker families on purpose: a question too
    many costs little.  A sentence is about a key if the pattern by which rules read that key finds it.
    """
    keys = known.groupBy("doc_id").agg(F.collect_set("key").alias("__keys"))
    joined = docs.join(keys, "doc_id", "left")
    held = F.coalesce("__keys", F.array().cast("array<string>"))
    about = lambda s: reduce(lambda a, b: a | b, [F.array_contains(held, k) & s.rlike(p) for k, p in K.KEY_TOPICS.items()])
    open_ = F.exists(T.sentences(F.col("text")), lambda s: s.rlike(K.REQUIREMENT_LANGUAGE) & ~about(s))
    return joined.where(F.coalesce(open_, F.lit(False))).select(*docs.columns)


#: Characters up to which a document is read whole; families that a slice needs; slices read of a longer one.
WHOLE, LEAST_FAMILIES, MOST_SLICES = 250_000, 2, 6


def slices(docs: DataFrame, whole: int = WHOLE, least: int = LEAST_FAMILIES, most: int = MOST_SLICES) -> DataFrame:
    """What is read of each document (doc_id, text): doc_id, position, total, score, content.

    A document of up to ``whole`` characters goes as one piece if it has ``least`` marker families.  A longer one
    is cut, and of its slices with enough families the best ``most`` go, in their order; if none has,
    those with any.  Asking a model is what costs, so the bound is the feature.
    """
    short_batches(docs.sparkSession)
    short = docs.where(F.length("text") <= whole).select("doc_id", F.lit(1).alias("position"), F.lit(1).alias("total"), F.col("text").alias("content"))
    cut = T.long_chunks(docs.where(F.length("text") > whole).select("doc_id", "text"))
    scored = short.unionByName(cut).withColumn("score", K.marker_score(F.col("content"), K.MARKERS))
    own = Window.partitionBy("doc_id")
    enough = F.when((F.max("score").over(own) >= least) | (F.col("total") == 1), least).otherwise(1)
    place = F.row_number().over(own.orderBy(F.desc("score"), "position"))
    kept = scored.withColumn("__least", enough).where("score >= __least").withColumn("__place", place).where(F.col("__place") <= most)
    return kept.select("doc_id", "position", "total", "score", "content")


def read_slices(docs: DataFrame, known: DataFrame, model: Callable[[str, list[str]], list[dict]], **bounds) -> DataFrame:
    """Rows of ``model(text, known keys)`` over the slices of each document: doc_id, position, key, value, quote, problem.

    Slices are read in order and the first failure of a document ends its reading; what earlier slices said
    stays.  A known key is dropped even if the model names it, and so is a (key, quote) said before.
    """
    keys = known.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    parts = slices(docs, **bounds).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("parts"))

    def call(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for doc_id, own, held in zip(pdf["doc_id"], pdf["parts"], pdf["keys"], strict=True):
                held, seen = list(held) if held is not None else [], set()
                for part in own:
                    try:
                        rows = model(part["content"], held)
                    except Exception as e:  # one document's failure is its own
                        out.append((doc_id, part["position"], None, None, None, type(e).__name__))
                        break
                    for r in rows:
                        mark = (r.get("key"), r.get("quote"))
                        if mark[0] not in held and mark not in seen:
                            seen.add(mark)
                            out.append((doc_id, part["position"], mark[0], r.get("value"), mark[1], None))
            yield pd.DataFrame(out, columns=["doc_id", "position", "key", "value", "quote", "problem"])

    return parts.join(keys, "doc_id", "left").mapInPandas(call, "doc_id long, position int, key string, value double, quote string, problem string")


def ask(docs: DataFrame, known: DataFrame, model: Callable[[str, list[str]], list[dict]]) -> DataFrame:
    """Rows of an injected ``model(text, known keys)``: doc_id, key, value, quote, problem.

    A call that fails is a row with its problem; other documents go on.
    """
    keys = known.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    asked = docs.select("doc_id", "text").join(keys, "doc_id", "left")

    def call(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for doc_id, text, own in zip(pdf["doc_id"], pdf["text"], pdf["keys"], strict=True):
                try:
                    rows = model(text, list(own) if own is not None else [])
                    out += [(doc_id, r.get("key"), r.get("value"), r.get("quote"), None) for r in rows]
                except Exception as e:  # one document's failure is its own
                    out.append((doc_id, None, None, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["doc_id", "key", "value", "quote", "problem"])

    return asked.mapInPandas(call, ROWS)


def grounded(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with grounding: verified if the canonical quote stands in the canonical text, else not_found."""
    source = docs.select("doc_id", F.lower(T.canonical(F.col("text"))).alias("source"))
    quote = F.lower(T.canonical(F.col("quote")))
    found = (F.coalesce(quote, F.lit("")) != "") & F.contains("source", quote)
    joined = rows.join(source, "doc_id", "left")
    return joined.withColumn("grounding", F.when(F.coalesce(found, F.lit(False)), "verified").otherwise("not_found")).drop("source")


def layered(docs: DataFrame, layers: list[tuple[str, Callable[[str, list[str]], list[dict]]]]) -> DataFrame:
    """Rules, then each named model: doc_id, layer, key, value, quote, grounding, superseded.

    ``docs``: doc_id, text, year.  The first layer to establish a key of a document wins; what later
    layers say about it is kept as superseded.
    """
    rules = T.requirements(docs).select("doc_id", "key", "value", "quote").withColumns({"layer": F.lit("rules"), "depth": F.lit(0)})
    every = rules
    for depth, (name, model) in enumerate(layers, 1):
        said = ask(worth_asking(docs, every), every, model).where("problem IS NULL AND key IS NOT NULL AND trim(quote) <> ''")
        every = every.unionByName(said.select("doc_id", "key", "value", "quote").withColumns({"layer": F.lit(name), "depth": F.lit(depth)}))
    first = every.groupBy("doc_id", "key").agg(F.min("depth").alias("first"))
    marked = every.join(first, ["doc_id", "key"]).withColumn("superseded", F.col("depth") > F.col("first"))
    return grounded(marked, docs).select("doc_id", "layer", "key", "value", "quote", "grounding", "superseded")
