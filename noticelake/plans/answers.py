"""Cited answers over search results; the writer is an injected callable.

``writer(question, passages)`` returns ``{"claims": [{"text", "sources": [n]}]}``; calls to a model,
keys and prompts are the caller's.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import valid_citations
from ..functions.text import compress
from ..operators import vectors as V

CLAIMS = "array<struct<text:string,sources:array<int>>>"


def complete_claims(buffer: str) -> list[dict]:
    """Claims whose closing brace has arrived in a partly received body."""
    at = buffer.find("[", max(buffer.find('"claims"'), 0)) if '"claims"' in buffer else -1
    found, decoder = [], json.JSONDecoder()
    while at >= 0:
        at += 1
        while at < len(buffer) and buffer[at] in " \t\r\n,":
            at += 1
        if buffer[at : at + 1] != "{":
            break
        try:
            claim, end = decoder.raw_decode(buffer, at)
        except ValueError:
            break
        found.append(claim)
        at = end - 1
    return found


def draft(buffer: str) -> str:
    """The text of the claim that is being written, as far as it has arrived."""
    tail = buffer[buffer.rfind('"text"') + 6 :] if '"text"' in buffer else ""
    opened = tail.find('"')
    if opened < 0:
        return ""
    body, i = tail[opened + 1 :], 0
    while i < len(body):
        if body[i] == '"':
            return ""
        i += 2 if body[i] == "\\" else 1
    try:
        return json.loads(f'"{body}"')
    except ValueError:
        return ""


def prompt_lines(hits: DataFrame, most: int = 1200) -> DataFrame:
    """qid, passages: numbered, titled, compressed, with whether the tender is open.

    ``hits``: qid, place, title, open (boolean), text.
    """
    state = F.when(F.col("open"), "open").when(~F.col("open"), "closed").otherwise("unknown")
    line = F.format_string("[%d] %s (%s)\n%s", "place", "title", state, compress(F.col("text"), F.col("title"), most))
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"), F.count("*").cast("int").alias("n"))
    return listed.select("qid", F.transform("l", lambda x: x["line"]).alias("passages"), "n")


def validated(claims: Column, n: Column) -> Column:
    """Claims with their citations in range; empty texts go."""
    checked = F.transform(claims, lambda c: F.struct(F.trim(c["text"]).alias("text"), valid_citations(c["sources"], n).alias("sources")))
    return F.filter(checked, lambda c: F.coalesce(c["text"], F.lit("")) != "")


def answer(questions: DataFrame, hits: DataFrame, writer: Callable[[str, list[str]], dict], limit: int = 8, overfetch: int = 2, scorer=None) -> DataFrame:
    """qid, claims, unsupported, problem: search results selected, reranked, shown to the writer and checked.

    ``questions``: qid, text; ``hits``: qid, doc_id, notice, rank, title, open, text.  ``scorer`` (list of texts -> list of
    floats) decides the order in which the writer sees what was selected; without one it is that of the search.  A writer
    that fails leaves its name in ``problem`` and no claims.
    """
    top = hits.where(F.col("rank") <= limit * overfetch)
    shown = V.select_passages(top.select("qid", "doc_id", "notice", "rank", "text"), limit)
    if scorer is not None:
        read = shown.withColumnRenamed("place", "rank").join(top.select("qid", "doc_id", "text"), ["qid", "doc_id"])
        shown = V.rerank(read, scorer, limit).select("qid", "doc_id", F.col("rank").alias("place"))
    shown = shown.join(top.select("qid", "doc_id", "title", "open", "text"), ["qid", "doc_id"])
    asked = questions.join(prompt_lines(shown), "qid")

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for qid, text, passages, n in zip(pdf["qid"], pdf["text"], pdf["passages"], pdf["n"], strict=True):
                try:
                    out.append((qid, n, json.dumps(writer(text, list(passages)).get("claims", [])), ""))
                except Exception as e:  # the answer says that it failed
                    out.append((qid, n, "[]", type(e).__name__))
            yield pd.DataFrame(out, columns=["qid", "n", "claims", "problem"])

    said = asked.mapInPandas(write, "qid long, n int, claims string, problem string")
    checked = said.select("qid", validated(F.from_json("claims", CLAIMS), F.col("n")).alias("claims"), "problem")
    unsupported = F.size(F.filter("claims", lambda c: F.size(c["sources"]) == 0))
    return checked.select("qid", "claims", unsupported.alias("unsupported"), "problem")


def cacheable(sources: Column) -> Column:
    """Answers that lean on live records are not kept."""
    return ~F.exists(sources, lambda s: s["type"] == "record")
