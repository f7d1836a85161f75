"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

Texts become lower-case words of letters and digits.  A mask picks some positions of a short
span and ignores the others; the hash of the picked words is a seed.  Documents and benchmark
items meet where seeds are equal, each meeting fixes a diagonal (document position minus item
position), and around it the item and the document are compared word by word.

A document is contaminated if some WINDOW words in a row of an item stand in it at the same
distances with at most SUBSTITUTIONS of them replaced.  An item of 10 to 12 words counts as a
whole with one replaced, of 8 or 9 words with none; shorter ones name nothing unless asked for.
The mask finds every such overlap: no choice of that many replaced words touches all places
where it fits (a test tries them all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_small, let, stored, table, text_key

#: Positions that a mask reads.
MASKS = ((0, 1, 3, 6, 7),)
WINDOW, SUBSTITUTIONS = 13, 2
#: Words of an item from which it names something; with fewer its words stand in clean texts by chance.
LEAST = 8
#: Benchmark seeds, words of items, and documents with hits, that are sent to every task; more are joined by shuffle.
SEEDS_HELD, WORDS_HELD, HITS_HELD = 1_000_000, 2_000_000, 20_000


def words(text: Column) -> Column:
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(split, lambda w: w != "")


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(hashed: Column, masks=MASKS) -> Column:
    """array<struct<pos, seed>> of every place where a mask fits."""

    def of(h: Column, number: int, mask: tuple[int, ...]) -> Column:
        places = F.size(h) - max(mask)
        starts = F.when(places > 0, F.sequence(F.lit(0), F.greatest(places, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        picked = lambda i: F.xxhash64(F.lit(number), *[F.get(h, i + o) for o in mask])
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), picked(i).alias("seed")))

    return let(hashed, lambda h: F.concat(*[of(h, k, m) for k, m in enumerate(masks)]))


def allowed(n: Column) -> Column:
    """Words that may differ in the window of an item of n words."""
    return F.when(n >= WINDOW, SUBSTITUTIONS).when(n >= 10, 1).otherwise(0)


def matched(h: Column, b: Column, diagonal: Column, window: Column) -> Column:
    """Most equal words in any ``window`` places of item ``b`` laid on ``h`` at ``diagonal``."""
    here = let(h, lambda words: F.transform(b, lambda x, i: F.when(F.get(words, i + diagonal) == x, 1).otherwise(0)))

    def best(equal: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(equal) - window)
        sums = F.transform(starts, lambda s: F.aggregate(F.slice(equal, s + 1, window), F.lit(0), lambda a, x: a + x))
        return F.array_max(sums)

    return let(here, best)


def decontaminate(docs: DataFrame, benchmark: DataFrame, masks=MASKS, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, contaminated, n_items, first_item, matched.

    n_items counts the items found in the document, first_item is the smallest of them (null:
    none), matched the most equal words in a window (0: none).  Null and empty texts are clean.
    Rows that share a doc_id are judged by their own texts (text_key, a hash of the text); items that
    share an item_id are one item each row.  An empty table on either side: nothing is contaminated.
    Columns other than doc_id, text and item_id, text are not read.  Items of fewer than ``least`` words are left out; with less
    than LEAST, shorter items count where they stand whole, found by a mask of their own length.
    """
    masks = (*masks, *(tuple(range(n)) for n in range(max(1, least), LEAST)))
    items = stored(
        benchmark.select("item_id", hashes(F.col("text")).alias("item")).where(F.size("item") >= least).distinct(), "items"
    )
    marks = stored(items.select("item_id", F.size("item").alias("n"), F.inline(seeds(F.col("item"), masks))).distinct(), "item-seeds")
    marks = marks.select("item_id", "n", F.col("pos").alias("item_pos"), "seed")
    docs = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    row = ["doc_id", "text_key"]
    met = docs.select(*row, F.inline(seeds(hashes(F.col("text")), masks))).join(held_small(marks, SEEDS_HELD), "seed")
    # the words of a text are hashed once, however many diagonals it has, and only those beside an item go on
    places = F.collect_set(F.struct("item_id", "n", (F.col("pos") - F.col("item_pos")).alias("diagonal")))
    hits = stored(met.groupBy(*row).agg(places.alias("hits")), "hits")
    held = docs.join(held_small(hits, HITS_HELD), row).select(*row, hashes(F.col("text")).alias("h"), "hits").select(*row, "h", F.inline("hits"))
    start = F.greatest("diagonal", F.lit(0))
    held = held.select(*row, "item_id", F.slice("h", start + 1, F.col("n")).alias("h"), (F.col("diagonal") - start).alias("diagonal"))
    n = F.size("item")
    window, needed = F.least(n, F.lit(WINDOW)), F.least(n, F.lit(WINDOW)) - allowed(n)
    words_held = items.agg(F.sum(F.size("item"))).first()[0] or 0
    items = F.broadcast(items) if words_held <= WORDS_HELD else items
    laid = held.join(items, "item_id").select(*row, "item_id", needed.alias("needed"), matched(F.col("h"), F.col("item"), F.col("diagonal"), window).alias("matched"))
    leaks = laid.where("matched >= needed").groupBy(*row).agg(
        F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.max("matched").alias("matched")
    )
    return docs.select(*row).join(leaks, row, "left").select(
        *row,
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        "first_item",
        F.coalesce(F.col("matched"), F.lit(0)).alias("matched"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


QUERIES = {"op8_decontamination": op8_decontamination}

#: No seeds here: every pair of equal words is laid on its diagonal.
ORACLES = {
    "op8_decontamination": r"""
WITH dw AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM documents)
), bw AS (
  SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM benchmark) WHERE len(w) >= 8
), met AS (
  SELECT doc_id, item_id, n, bw.pos AS place, dw.pos - bw.pos AS diagonal FROM dw JOIN bw USING (word)
), runs AS (
  SELECT doc_id, item_id, n, place, diagonal FROM met
  QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diagonal) >= 8
), counted AS (
  SELECT doc_id, item_id, n, count(*) OVER (
    PARTITION BY doc_id, item_id, diagonal ORDER BY place RANGE BETWEEN (least(n, 13) - 1) PRECEDING AND CURRENT ROW) AS equal
  FROM runs
), leaks AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item, max(equal) AS matched FROM counted
  WHERE equal >= least(n, 13) - CASE WHEN n >= 13 THEN 2 WHEN n >= 10 THEN 1 ELSE 0 END GROUP BY doc_id
)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, first_item,
       CAST(coalesce(matched, 0) AS INTEGER) AS matched
FROM documents LEFT JOIN leaks USING (doc_id)
"""
}
