"""What a reader sees of a document: its pieces, where quotes stand in them, and which source to show.

Quotes are found in a folded form (canonical characters, case, white space), and each folded character
remembers where it came from, so spans are offsets into the text as it is.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let
from ..functions.text import PLAIN
from ..session import short_batches, stored


def pieces_of(text: Column) -> Column:
    """array<struct<piece, start, end>>: paragraphs between blank lines, as offsets into the text; blank ones are none."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)(.+?(?:\n[ \t]*\n\s*|\z))"), F.lit(1))
    state = "struct<at:int,found:array<struct<piece:int,start:int,end:int>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<piece:int,start:int,end:int>>").alias("found")).cast(state)

    def step(s: Column, part: Column) -> Column:
        lead = F.length(F.regexp_extract(part, r"(?s)^(\s*)", 1))
        end = s["at"] + F.length(F.regexp_replace(part, r"\s+\z", ""))
        own = F.struct(F.size(s["found"]).alias("piece"), (s["at"] + lead).alias("start"), end.alias("end"))
        found = F.when(s["at"] + lead < end, F.concat(s["found"], F.array(own))).otherwise(s["found"])
        return F.struct((s["at"] + F.length(part)).alias("at"), found.alias("found")).cast(state)

    return F.aggregate(parts, begin, step)["found"]


class _Folds(dict):
    """Code point -> what it is in the form quotes are compared in; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        own = unicodedata.normalize("NFKC", chr(code)).translate(PLAIN).casefold()
        self[code] = own = "".join(" " if c.isspace() else c for c in own)
        return own


_FOLDS = _Folds()
_SPACES = re.compile("  +")
#: Characters folded at once; offsets are counted only in the blocks where a quote begins or ends.
BLOCK = 1 << 12


class Folded:
    """A text in the form quotes are compared in, which knows the offset that each of its characters came from."""

    def __init__(self, text: str):
        self.source, self.starts, parts, last = text, [], [], " "
        size = 0
        for k in range(0, len(text), BLOCK):
            part = _SPACES.sub(" ", text[k : k + BLOCK].translate(_FOLDS))
            part = part.removeprefix(" ") if last == " " else part
            self.starts.append(size)
            parts.append(part)
            size += len(part)
            last = part[-1] if part else last
        self.text = "".join(parts)

    def offset(self, place: int) -> int:
        """The offset in the source of the folded text's character ``place``."""
        k = bisect_right(self.starts, place) - 1
        at = self.starts[k]
        last = self.text[at - 1] if at else " "
        for i in range(k * BLOCK, len(self.source)):
            for c in _FOLDS[ord(self.source[i])]:
                if c != " " or last != " ":
                    if at == place:
                        return i
                    at, last = at + 1, c
        raise IndexError(place)

    def find(self, quote: str) -> tuple[int, int] | None:
        """(start, end) in the source of the first place where ``quote`` stands; null if nowhere or if it says nothing."""
        wanted = Folded(quote).text.strip(" ")
        k = self.text.find(wanted) if wanted else -1
        return (self.offset(k), self.offset(k + len(wanted) - 1) + 1) if k >= 0 else None


def find(text: str, quote: str) -> tuple[int, int] | None:
    """(start, end) of the first place where ``quote`` stands in ``text``; null if nowhere or if it says nothing."""
    return Folded(text).find(quote)


def locate(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Where quotes stand: doc_id, quote_id, start, end (null where a quote is not found).

    ``docs``: doc_id, text; ``quotes``: doc_id, quote_id, quote.  The first place counts.  A null text or quote is
    not found; a quote of a document that isn't there has no row.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Folded("")
        for pdf in it:
            spans = []
            for t, q in zip(pdf["text"], pdf["quote"], strict=True):
                if held.source != (t or ""):  # quotes of a document mostly follow each other
                    held = Folded(t or "")
                spans.append(held.find(q or "") or (None, None))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quote_id": pdf["quote_id"], "start": pd.array([s[0] for s in spans], "Int32"), "end": pd.array([s[1] for s in spans], "Int32")})

    short_batches(docs.sparkSession)
    joined = quotes.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "quote_id", "quote", "text")
    return joined.mapInPandas(run, "doc_id long, quote_id long, start int, end int")


def highlights(docs: DataFrame, located: DataFrame) -> DataFrame:
    """Spans by piece: doc_id, quote_id, piece, start, end (offsets into the piece); a quote may run over several."""
    each = docs.select("doc_id", F.inline(pieces_of(F.col("text")))).select("doc_id", "piece", F.col("start").alias("a"), F.col("end").alias("b"))
    met = located.where("start IS NOT NULL").join(each, "doc_id").where("start < b AND a < end")
    return met.select("doc_id", "quote_id", "piece", (F.greatest("start", "a") - F.col("a")).alias("start"), (F.least("end", "b") - F.col("a")).alias("end"))


def payload(docs: DataFrame, located: DataFrame) -> DataFrame:
    """One row per document: doc_id, pieces, highlights, missing.

    ``highlights`` are array<struct<quote_id, piece, start, end>> in order of quote and piece, ``missing`` the
    quotes that were not found, for which the reader sees the text alone.
    """
    located = stored(located, "located")  # read once, as finding quotes is what costs
    span = F.when(F.col("start").isNotNull(), F.struct("quote_id", "start", "end"))
    own = located.groupBy("doc_id").agg(F.collect_list(span).alias("spans"), F.array_sort(F.collect_list(F.when(F.col("start").isNull(), F.col("quote_id")))).alias("missing"))

    def laid(pieces: Column, spans: Column) -> Column:
        on = lambda q: F.filter(pieces, lambda p: (q["start"] < p["end"]) & (p["start"] < q["end"]))
        cut = lambda q, p: F.struct(q["quote_id"].alias("quote_id"), p["piece"].alias("piece"), (F.greatest(q["start"], p["start"]) - p["start"]).alias("start"), (F.least(q["end"], p["end"]) - p["start"]).alias("end"))
        return F.array_sort(F.flatten(F.transform(spans, lambda q: F.transform(on(q), lambda p: cut(q, p)))))

    none = "array<struct<quote_id:bigint,piece:int,start:int,end:int>>"
    both = let(pieces_of(F.col("text")), lambda p: F.struct(p.alias("pieces"), laid(p, F.col("spans")).alias("highlights")))
    shown = docs.select("doc_id", "text").join(own, "doc_id", "left").select("doc_id", both.alias("b"), "missing")
    return shown.select("doc_id", "b.pieces", F.coalesce("b.highlights", F.array().cast(none)).alias("highlights"), F.coalesce("missing", F.array().cast("array<bigint>")).alias("missing"))


def best_source(located: DataFrame, sources: DataFrame) -> DataFrame:
    """The source to show of each owner: owner, doc_id, found.

    ``sources``: owner, doc_id, richness.  Most quotes located first, then the richest, then the smallest doc_id.
    """
    counted = located.groupBy("doc_id").agg(F.count("start").alias("found"))
    own = sources.join(counted, "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("found"), F.desc_nulls_last("richness"), "doc_id"))
    return own.withColumn("p", place).where("p = 1").select("owner", "doc_id", "found")
