"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Equal lines become one entry first; of those that are not blank the later copies go, whatever their
length.  For lines of ``min_chars`` or more, lengths are put in classes of CLASS.  A class gives
THRESHOLD + 1 segments their places, those of the first half counted from the front of a line and the
others from its end.  If two lines are within THRESHOLD edits, some segment of the shorter stands
unchanged in the longer, at most as far from its place as its number (or its number from the end).
So a line is indexed under its own segments and probes, for its own class and, where a partner may
be in the class below, for that one too, only the places that the number of the segment leaves
open.  Most of these keys are the line's own index keys: five rows a line for two edits.

Keys that stand in one line only are dropped by a count before anything is joined.  A key with over
HOT rows is split: two lines that share it and are within THRESHOLD edits are so without it as well,
so what is left of each line is cut into segments again, and both keys together are the new key.
Where keys meet, lines whose letter counts differ by more than the edits allow are no candidates.
Candidates are verified by a banded bit-parallel edit distance: one machine word holds the
2 * THRESHOLD + 1 cells around the diagonal, and a column takes a dozen bit operations.

A line goes if an equal or linked line stands earlier in the corpus, by (doc_id, line number).
That is judged on the input: a chain of links removes all but those without an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_small, let, stored, table, text_key

THRESHOLD, MIN_CHARS = 2, 30
#: Lengths of a class; rows of a key beyond which it is split.
CLASS, HOT = 8, 500
#: Fixed value: characters whose counts are compared before lines are.
LETTERS = "etaoinsrhldcum ."
#: Bits of a count.
COUNT = 4
#: Keys, ids, pairs or lines up to which such a table is sent to every task.
HELD = 400_000


def segment_rows(line: Column, n: Column, threshold: int, both_ways: bool = True) -> Column:
    """array<struct<key, mark, at, size>> of a line of n characters.

    A row stands for the segment at ``at`` (from 0); its mark is n where the line is found by it, and -n
    where it only looks.  ``both_ways``: every line that looks is found as well.  Then, at two edits, a
    middle segment need not be looked for one place further left: it would be found from the other side.
    """
    parts, rest = threshold + 1, n % CLASS

    def of(base: Column, own: bool) -> Column:
        size, rows = F.floor(base / parts).cast("int"), []
        for number in range(parts):
            from_end = 2 * number > threshold
            reach = threshold - number if from_end else number
            start = n - size * (parts - number) if from_end else size * number
            for shift in range(0 if both_ways and threshold == 2 else -reach, reach + 1):
                at = start + shift
                key = F.xxhash64(base, F.lit(number), F.substr(line, at + 1, size))
                rows.append(F.struct(key.alias("key"), (n if own and not shift else -n).alias("mark"), at.alias("at"), size.alias("size")))
        return F.array(*rows)

    below = F.when((rest < threshold) & (n >= CLASS), of(n - rest - CLASS, False))
    return F.concat(of(n - rest, True), F.coalesce(below, F.array().cast("array<struct<key:bigint,mark:int,at:int,size:int>>")))


def banded_distance(longer: Column, shorter: Column, band: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most ``band``; exact up to ``band``."""
    width = 2 * band + 1
    full = (1 << width) - 1
    state = "struct<at:int,up:bigint,down:bigint,d:int>"
    bit = lambda v: F.lit(v).cast("long")
    start = F.struct(
        F.lit(0).alias("at"), bit(full & ~((1 << band + 1) - 1)).alias("up"), bit(0).alias("down"), F.lit(0).alias("d")
    ).cast(state)
    both = lambda a, b: a.bitwiseOR(b)
    cut = lambda a: a.bitwiseAND(bit(full))
    inverse = lambda a: cut(F.bitwise_not(a))

    def distance(p: Column, s: Column) -> Column:
        def column(st: Column, c: Column) -> Column:
            equal = bit(0)
            for k in range(width):
                equal = equal + F.when(F.get(p, st["at"] + (k - band)) == c, bit(1 << k)).otherwise(bit(0))
            # the band moves one row down: what was cell k + 1 is cell k now
            moved = F.struct(
                equal.alias("eq"),
                both(F.shiftright(st["up"], 1), bit(1 << 2 * band)).alias("up"),
                F.shiftright(st["down"], 1).alias("down"),
            )
            return let(moved, lambda m: diagonal(st, m))

        def diagonal(st: Column, m: Column) -> Column:
            carried = (m["eq"].bitwiseAND(m["up"]) + m["up"]).bitwiseXOR(m["up"])
            zero = cut(both(both(carried, m["eq"]), m["down"]))
            return let(zero, lambda z: across(st, m, z))

        def across(st: Column, m: Column, z: Column) -> Column:
            right = cut(both(F.shiftleft(both(m["down"], inverse(both(z, m["up"]))), 1), bit(1)))
            left = cut(F.shiftleft(z.bitwiseAND(m["up"]), 1))
            sides = F.struct(right.alias("right"), left.alias("left"))
            return let(
                sides,
                lambda h: F.struct(
                    (st["at"] + 1).alias("at"),
                    both(h["left"], inverse(both(z, h["right"]))).alias("up"),
                    z.bitwiseAND(h["right"]).alias("down"),
                    (st["d"] + 1 - F.shiftright(z, band).bitwiseAND(bit(1))).cast("int").alias("d"),
                ),
            )

        end = F.aggregate(s, start, lambda st, c: column(st, c).cast(state))
        rest = F.element_at(F.array(*[bit(((1 << k) - 1) << band + 1) for k in range(band + 1)]), F.size(p) - F.size(s) + 1)
        return let(
            end,
            lambda e: e["d"] + F.bit_count(e["up"].bitwiseAND(rest)) - F.bit_count(e["down"].bitwiseAND(rest)),
        )

    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    pair = F.struct(chars(longer).alias("p"), chars(shorter).alias("s"))
    return let(pair, lambda x: distance(x["p"], x["s"]))


def signature(line: Column) -> Column:
    """Counts of the LETTERS of a line, each modulo 2**COUNT, side by side."""
    total = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        count = F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
        total = total.bitwiseOR(F.shiftleft((count % (1 << COUNT)).cast("long"), COUNT * k))
    return total


def letters_apart(a: Column, b: Column) -> Column:
    """Sum over LETTERS of how far the counts differ, around the circle: at most two an edit."""
    total, top = F.lit(0), (1 << COUNT) - 1
    for k in range(len(LETTERS)):
        d = F.abs(F.shiftright(a, COUNT * k).bitwiseAND(top) - F.shiftright(b, COUNT * k).bitwiseAND(top))
        total = total + F.least(d, F.lit(top + 1) - d)
    return total


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no (from 0), line.  Null text is one empty line, like empty text."""
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def position(doc_id: Column, line_no: Column) -> Column:
    """Place of a line in the corpus as one number, so that the earliest is found by hash aggregation."""
    return doc_id.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + line_no.cast("decimal(10,0)")


def judged(line: Column, min_chars: int, every: bool) -> Column:
    """Whether a line's equals go: at ``min_chars`` or more, or ``every`` line that is not blank."""
    long = F.length(line) >= min_chars
    return long | line.rlike(r"[^\x20\x09-\x0D]") if every else long


def entries(lines: DataFrame, min_chars: int = MIN_CHARS, every: bool = True) -> DataFrame:
    """Distinct lines that are ``judged``: id, line, n, position of the first, copies."""
    grouped = lines.where(judged(F.col("line"), min_chars, every)).groupBy("line").agg(
        F.min(position(F.col("doc_id"), F.col("line_no"))).alias("first"), F.count("*").alias("copies")
    )
    return grouped.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("n"), "first", "copies")


def edit_links(distinct: DataFrame, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """All pairs of ``distinct`` (a stored table) within ``threshold`` edits: a, b (ids), a not shorter."""
    n = F.col("n")
    rows = distinct.select("id", F.inline(segment_rows(F.col("line"), n, threshold)))
    ends = rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("x"), F.max("id").alias("y"), F.max("mark").alias("found"))
    met = stored(ends.where("x <> y AND found > 0").select("key", (F.col("rows") > hot).alias("hot")), "line-keys")
    rows = stored(rows.join(held_small(met, HELD), "key"), "line-rows")
    named = stored(rows.select("id").distinct(), "line-ids")
    texts = stored(distinct.select("id", "line", "n").join(held_small(named, HELD), "id").withColumn("letters", signature(F.col("line"))), "line-texts")
    known = rows.join(texts, "id")
    # what is left of a line without the segment that so many share
    left = F.concat(F.substr("line", F.lit(1), F.col("at")), F.substr("line", F.col("at") + F.col("size") + 1, n))
    split = known.where("hot").select("id", "letters", "key", F.col("mark").alias("outer"), left.alias("line"), (n - F.col("size")).alias("n"))
    inner = F.inline(segment_rows(F.col("line"), n, threshold, both_ways=False)).alias("inner", "mark", "at", "size")
    split = split.select("id", "letters", "outer", "key", inner).select(
        F.xxhash64("key", "inner").alias("key"), "id", F.when(F.col("outer") > 0, F.col("mark")).otherwise(-F.abs("mark")).alias("mark"), "letters"
    )
    keyed = stored(known.where("NOT hot").select("key", "id", "mark", "letters").union(split), "line-keyed")
    probes = keyed.select("key", F.col("id").alias("a"), F.abs("mark").alias("m"), F.col("letters").alias("letters_a"))
    index = keyed.where("mark > 0").select("key", F.col("id").alias("b"), F.col("mark").alias("l"), F.col("letters").alias("letters_b"))
    near = letters_apart(F.col("letters_a"), F.col("letters_b")) <= 2 * threshold
    pairs = probes.join(index, "key").where((F.col("a") != F.col("b")) & (F.col("m") - F.col("l")).between(0, threshold) & near)
    longer = F.col("m") > F.col("l")  # pairs of one length may have been met from either side
    pairs = pairs.select(F.when(longer, F.col("a")).otherwise(F.least("a", "b")).alias("a"), F.when(longer, F.col("b")).otherwise(F.greatest("a", "b")).alias("b"))
    pairs = stored(pairs.distinct(), "line-pairs")
    one = texts.select(F.col("id").alias("a"), F.col("line").alias("long"))
    two = texts.select(F.col("id").alias("b"), F.col("line").alias("short"))
    # one distance a pair: a new partitioning, which is not coalesced, keeps the work even
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held_small(pairs, HELD).join(one, "a").join(two, "b").repartition(tasks, "a", "b")
    return dealt.where(banded_distance(F.col("long"), F.col("short"), threshold) <= threshold).select("a", "b")


def removals(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, every: bool = True) -> DataFrame:
    """One row per document: doc_id, text_key, n_lines, n_removed, removed (line numbers from 0, ascending).

    Later copies of equal lines go unless they are blank; within a document too.  ``min_chars``, CLASS at
    least, holds for the edit join; without ``every`` for equal lines as well.  A document is its doc_id and
    text: rows that repeat both are one document's lines twice and lose the same ones, rows of one doc_id with
    different texts are judged each for itself, and equal lines at the same place of theirs stay in all.  A document
    without doc_id loses nothing and is earlier than none.  Null text is one empty line.  Empty table: no rows.
    """
    if min_chars < CLASS:
        raise ValueError(f"segments need lines of {CLASS} characters or more")
    lines = line_table(docs)
    distinct = stored(entries(lines, min_chars, every), "lines")
    links = stored(edit_links(distinct.where(F.col("n") >= min_chars), threshold), "line-links")
    firsts = distinct.select("id", "first")
    ways = links.union(links.select("b", "a"))  # for each line, what it links to
    ways = F.broadcast(ways) if links.count() <= HELD // 2 else ways
    linked = stored(ways.join(firsts, F.col("b") == F.col("id")).groupBy("a").agg(F.min("first").alias("earliest")), "line-linked")
    marks = lambda: (F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))
    known = distinct.join(held_small(linked, HELD), F.col("id") == F.col("a"), "left").select(
        "line", F.least("first", F.coalesce("earliest", "first")).alias("earliest"), (F.col("earliest") < F.col("first")).alias("moved"), "copies"
    )
    known = held_small(stored(known.where("copies > 1 OR moved").select(*marks(), "earliest"), "line-known"), HELD)
    seen = lines.select("doc_id", "text_key", "line_no", *marks(), judged(F.col("line"), min_chars, every).alias("judged"))
    gone = F.col("judged") & (F.col("earliest") < position(F.col("doc_id"), F.col("line_no")))
    number = F.when(F.coalesce(gone, F.lit(False)), F.col("line_no"))
    return seen.join(known, ["h", "h2"], "left").groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_lines"), F.count(number).alias("n_removed"), F.array_sort(F.collect_list(number)).alias("removed")
    )


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines of ``removals`` taken out of text; other columns as they are, null texts too.

    Each row loses the lines of its own text: rows that repeat a doc_id keep apart, and rows without one stay whole.
    """
    found = removals(docs, threshold, min_chars).where("n_removed > 0")
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("removed").alias("__removed"))
    kept = F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(found["__removed"], i))
    joined = docs.join(found, (docs["doc_id"] == found["__id"]) & (text_key(docs["text"]) == found["__key"]), "left")
    text = F.when(found["__id"].isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of equal lines that are not blank, and lines within two edits of an earlier one of 30 characters or more."""
    found = removals(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


def op10_line_dedup_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; the name is that of the first query that had no floor for equal lines."""
    return op10_line_dedup(spark, sf_dir)


QUERIES = {"op10_line_dedup": op10_line_dedup, "op10_line_dedup_short": op10_line_dedup_short}
#: The distance here counts bytes, so characters beyond ASCII are mapped to single ones first.
#: Two edits change the count of a letter by two at most, which spares most pairs the distance.
ORACLES = {
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS line_no
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), d AS (
  SELECT line, length(line) AS n, min((doc_id, line_no)) AS first,
         translate(line, 'äöüßáéíóúñèêàçâîôûïëùœÄÖÜÁÉÍÓÚÑÈÊÀÇ', '0123456789#$%&@^~|=+*!;:<>?/(){}[') AS code,
         [length(replace(line, x, '')) FOR x IN ['e', 'n', 't', 'a', 'o', 'i', 'r', ' ']] AS r
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') OR length(line) >= 30 GROUP BY line
), p AS (
  SELECT a.line, min(b.first) AS earliest FROM d a, (VALUES (-2), (-1), (0), (1), (2)) v(k), d b
  WHERE a.n >= 30 AND b.n >= 30 AND b.n = a.n + k AND a.line <> b.line AND
    CASE WHEN abs(a.r[1] - b.r[1]) > 4 OR abs(a.r[2] - b.r[2]) > 4 OR abs(a.r[3] - b.r[3]) > 4 OR abs(a.r[4] - b.r[4]) > 4
           OR abs(a.r[5] - b.r[5]) > 4 OR abs(a.r[6] - b.r[6]) > 4 OR abs(a.r[7] - b.r[7]) > 4 OR abs(a.r[8] - b.r[8]) > 4
         THEN false ELSE levenshtein(a.code, b.code) <= 2 END
  GROUP BY a.line
), e AS (
  SELECT d.line, CASE WHEN p.earliest < d.first THEN p.earliest ELSE d.first END AS earliest FROM d LEFT JOIN p USING (line)
), o AS (
  SELECT doc_id, line_no, coalesce(e.earliest < (doc_id, line_no), false) AS gone FROM l LEFT JOIN e USING (line)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (WHERE gone), '') AS removed
FROM o GROUP BY doc_id
"""
}
ORACLES["op10_line_dedup_short"] = ORACLES["op10_line_dedup"]
