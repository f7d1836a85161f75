"""Full text over a stored positional index: web-style queries, phrases, exclusion, rank.

The index is written once: a row for each term of a document with all its places, sorted by stem, in folders by a
hash of the term's stem, and, where it is asked for, a table of stems with the number of documents that have them.  A search reads
the folders of the stems that are asked for, and nothing of the texts, and brings what it has read of a document
together once; items, choices and exclusions are decided there, so that no row goes on for an item or a query that
a document does not match.  No stem is left out for being common; a query on common words only reads more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import reference_codes
from ..session import shared_dir, short_batches, stored
from .vectors import meet, rounded, words

#: Folders of an index; stems that are named in the filter of a scan; rows of a batch that goes back to Spark; queries that one pass over the texts counts for.
BUCKETS, NAMED, OUT, QUERIES_AT_ONCE = 32, 2_000, 1 << 13, 4_096
#: Letters in a row, or digits in a row.
TOKEN = r"(\p{L}+|\p{N}+)"
#: How fast more places of a term stop to count.
SATURATION = 1.2


def tokens(text: Column) -> Column:
    """Lower-case terms of a text in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def stem(term: Column) -> Column:
    """Plural endings off words of four letters or more."""
    ends = lambda *endings: reduce(or_, (F.endswith(term, F.lit(x)) for x in endings))
    ies = ends("ies") & ~ends("eies", "aies")
    es = ends("es") & ~ends("aes", "ees", "oes")
    s = ~ends("us", "ss", "es")
    cut = F.when(ies, F.concat(F.substr(term, F.lit(1), F.length(term) - 3), F.lit("y"))).when(es | s, F.substr(term, F.lit(1), F.length(term) - 1)).otherwise(term)
    return F.when(ends("s") & (F.length(term) > 3), cut).otherwise(term)


def bucket_of(stemmed: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(stemmed), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """A stored index: ``postings`` (bucket, stem, term, doc_id, places), ``stems`` (stem, docs), ``documents`` (doc_id)."""

    path: str
    postings: DataFrame
    documents: DataFrame
    size: int

    @cached_property
    def stems(self) -> DataFrame:
        """How many documents have a stem; written when it is first asked for."""
        each = self.postings.select("stem", "doc_id").distinct().groupBy("stem").agg(F.count("*").alias("docs"))
        each.write.mode("overwrite").parquet(f"{self.path}/stems")
        return self.postings.sparkSession.read.schema("stem string, docs long").parquet(f"{self.path}/stems")

    def of(self, asked: DataFrame) -> DataFrame:
        """Postings of the stems of ``asked`` (stem): only their folders are read, and of those the row groups that may hold one."""
        wanted = asked.select("stem").distinct()
        found = [r["bucket"] for r in wanted.select(bucket_of(F.col("stem")).alias("bucket")).distinct().collect()]  # BUCKETS at most
        rows = self.postings.where(F.col("bucket").isin(found)) if found else self.postings.where("false")
        named = [r["stem"] for r in wanted.limit(NAMED + 1).collect()]
        return rows.where(F.col("stem").isin(named)) if 0 < len(named) <= NAMED else rows


@dataclass
class Texts:
    """Documents (doc_id, text) without a stored index, for words that are asked for once: one pass over the texts, and no shuffle of them."""

    documents: DataFrame


def _posted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, terms in order -> doc_id, term, places: a row for each term of a text."""
    for b in it:
        length = pc.list_value_length(b[1]).to_numpy(zero_copy_only=False)
        own = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
        terms = pc.list_flatten(b[1]).dictionary_encode()
        code = terms.indices.to_numpy(zero_copy_only=False)
        key = own * max(len(terms.dictionary), 1) + code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
        at = order[first]
        out = pa.RecordBatch.from_arrays([b[0].take(pa.array(own[at])), terms.dictionary.take(pa.array(code[at])), places], names=["doc_id", "term", "places"])
        for k in range(0, out.num_rows, OUT):
            yield out.slice(k, OUT)


def build(docs: DataFrame, path: str) -> Index:
    """Write the index of ``docs`` (doc_id, text) to ``path``, without a shuffle.  Texts of rows that share a doc_id are one document's."""
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", tokens(F.col("text")).alias("terms")).mapInArrow(_posted, f"doc_id {kind}, term string, places array<int>")
    rows = rows.withColumn("stem", stem(F.col("term"))).withColumn("bucket", bucket_of(F.col("stem")))
    rows = rows.select("stem", "term", "doc_id", "places", "bucket").sortWithinPartitions("bucket", "stem", "doc_id")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    docs.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/documents")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Index:
    postings = spark.read.schema("stem string, term string, doc_id long, places array<int>, bucket int").parquet(f"{path}/postings")
    documents = spark.read.parquet(f"{path}/documents")
    return Index(path, postings, documents, documents.count())


_BUILT: dict[tuple[str, str], Index] = {}


def index_of(docs: DataFrame) -> Index:
    """The index of ``docs`` (a scan of files), built once for as long as the files stay as they are."""
    spark = docs.sparkSession
    state = hashlib.sha256()
    for name in sorted(docs.inputFiles()):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
        state.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    key = (spark.sparkContext.applicationId, state.hexdigest())
    if key not in _BUILT:
        _BUILT[key] = build(docs.select("doc_id", "text"), f"{shared_dir(spark)}/fulltext-{state.hexdigest()[:32]}")
    return _BUILT[key]


def asked_terms(queries: DataFrame) -> DataFrame:
    """What web-style ``queries`` (qid, text) ask for, a row for each word: qid, choice, item, without, words, k, stem.

    ``"two words"`` is a phrase, ``-word`` or ``-"a phrase"`` excludes, ``or`` parts choices of which one has to hold;
    everything else has to be there.  A quotation mark that is never closed is ignored.  ``words`` is the
    number of words of the item and ``k`` the place of the word in it.
    """
    part = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(-?\"[^\"]*\"|[^\s\"]+)"), F.lit(1))
    items = queries.select("qid", F.posexplode(part).alias("item", "raw"))
    either = F.lower("raw") == "or"
    order = Window.partitionBy("qid").orderBy("item")
    items = items.withColumn("choice", F.sum(F.when(either, 1).otherwise(0)).over(order)).where(~either)
    words = items.select("qid", "choice", "item", F.col("raw").startswith("-").alias("without"), tokens(F.col("raw")).alias("w"))
    return words.select("qid", "choice", "item", "without", F.size("w").alias("words"), F.posexplode("w").alias("k", "term")).withColumn("stem", stem(F.col("term")))


@dataclass
class Asked:
    """The stated list of queries: codes of stems, items as tuples of codes, and by choice its qid and the items that it wants and excludes."""

    codes: dict[str, int] = field(default_factory=dict)
    items: dict[tuple[int, ...], int] = field(default_factory=dict)
    qids: list = field(default_factory=list)
    wanted: list[list[int]] = field(default_factory=list)
    excluded: list[list[int]] = field(default_factory=list)


def listed(asked: DataFrame) -> Asked:
    """``asked`` as asked_terms() gives it; it goes to every task, as the queries are a stated list."""
    out, items = Asked(), {}
    for r in asked.where("qid IS NOT NULL").collect():
        items.setdefault((r["qid"], r["choice"]), {}).setdefault((r["item"], r["without"]), {})[r["k"]] = r["stem"]
    for (qid, _), own in sorted(items.items()):
        sides: tuple[list[int], list[int]] = ([], [])
        for (_, without), stems in sorted(own.items()):
            item = tuple(out.codes.setdefault(stems[k], len(out.codes)) for k in range(len(stems)))
            sides[without].append(out.items.setdefault(item, len(out.items)))
        out.qids.append(qid)
        out.wanted.append(sides[0])
        out.excluded.append(sides[1])
    return out


def counted(held: pa.Array, asked: Asked) -> np.ndarray:
    """How often each item stands in each document; ``held``: by document the list of its asked stems (stem: code, places)."""
    length = pc.list_value_length(held).to_numpy(zero_copy_only=False)
    rows = pc.list_flatten(held)
    code, places = pc.struct_field(rows, "stem").to_numpy(zero_copy_only=False).astype(np.int64), pc.struct_field(rows, "places")
    size = pc.list_value_length(places).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(length), dtype=np.int64), length)
    flat = pc.list_flatten(places).to_numpy(zero_copy_only=False).astype(np.int64)
    # places of all documents on one line, so far apart that no item reaches from one to the next
    apart = int(flat.max(initial=0)) + max(map(len, asked.items), default=0) + 1
    line = len(length) * apart
    at = np.sort(np.repeat(code * line + own * apart, size) + flat)
    ends = np.searchsorted(at, np.arange(len(asked.codes) + 1) * line)
    times = np.zeros((len(length), len(asked.items)), np.int32)
    for item, column in asked.items.items():
        starts = at[ends[item[0]] : ends[item[0] + 1]] - item[0] * line
        for k, c in enumerate(item[1:], 1):
            if len(starts):
                starts = np.intersect1d(starts, at[ends[c] : ends[c + 1]] - c * line - k, assume_unique=True)
        if len(starts):
            times[:, column] = np.bincount(starts // apart, minlength=len(length))
    return times


def _frequencies(asked: Asked):
    """item, docs: documents of a task that have an item."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros(len(asked.items), np.int64)
        for b in it:
            docs += (counted(b[1], asked) > 0).sum(0)
        item = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(docs[item])], names=["item", "docs"])

    return run


def _matches(asked: Asked):
    """asked (the number of a choice), doc_id, times of the items wanted; without times where a choice that wants none is excluded."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            times = counted(b[1], asked)
            there = times > 0
            for n, (wanted, excluded) in enumerate(zip(asked.wanted, asked.excluded, strict=True)):
                gone = there[:, excluded].any(1)
                at = np.flatnonzero(there[:, wanted].all(1) & ~gone if wanted else gone)
                if len(at):
                    ends = pa.array(np.arange(len(at) + 1) * len(wanted), pa.int32())
                    found = pa.ListArray.from_arrays(ends, pa.array(times[np.ix_(at, wanted)].ravel())) if wanted else pa.nulls(len(at), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), b[0].take(pa.array(at)), found], names=["asked", "doc_id", "times"])

    return run


def search(queries: DataFrame, index: Index, k: int = 20) -> DataFrame:
    """Documents that match web-style ``queries`` (qid, text): qid, doc_id, score, rank (1 to ``k``).

    A document matches if one choice has all its items and none of those excluded; a choice of excluded items alone
    matches what is left.  A phrase is found where its words stand side by side.  The score adds up, over the items
    found, how often they stand there (saturating) times how rare they are; ties go by doc_id.  An empty
    query matches nothing.
    """
    spark = queries.sparkSession
    short_batches(spark)
    terms = asked_terms(queries)
    asked = listed(terms)
    codes = spark.createDataFrame(list(asked.codes.items()), "stem string, code int")
    rows = index.of(terms).join(F.broadcast(codes), "stem").select(F.col("code").alias("stem"), "doc_id", "places")
    # all that was read of a document meets in one task; a word's places are one value, however many queries ask for it
    places = F.array_distinct(F.flatten(F.collect_list("places")))
    held = rows.repartition("doc_id").groupBy("stem", "doc_id").agg(places.alias("places")).groupBy("doc_id").agg(F.collect_list(F.struct("stem", "places")).alias("held"))
    kind = queries.schema["qid"].dataType.simpleString()
    choices = spark.createDataFrame(list(zip(range(len(asked.qids)), asked.qids, asked.wanted, strict=True)), f"asked int, qid {kind}, wanted array<int>")
    docs = held.mapInArrow(_frequencies(asked), "item int, docs long").groupBy("item").agg(F.sum("docs").alias("docs"))
    # how rare the items of a choice are, in their order
    rare = choices.select("asked", F.posexplode("wanted").alias("nth", "item")).join(docs, "item")
    rare = rare.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("nth", F.log1p(F.lit(index.size) / F.col("docs")).alias("rare")))).alias("rare"))
    found = held.mapInArrow(_matches(asked), "asked int, doc_id long, times array<int>")
    weight = F.aggregate(F.zip_with("times", "rare", lambda t, r: t / (t + SATURATION) * r["rare"]), F.lit(0.0), lambda s, x: s + x)
    scored = found.join(F.broadcast(rare), "asked").select("asked", "doc_id", F.round(weight, 6).alias("score"))
    if any(not w for w in asked.wanted):
        left = choices.where(F.size("wanted") == 0).select("asked")
        bare = index.documents.join(F.broadcast(left), F.lit(True)).join(found.where("times IS NULL"), ["asked", "doc_id"], "left_anti")
        scored = scored.union(bare.select("asked", "doc_id", F.lit(0.0).alias("score")))
    ranked = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    # what is among a query's best is among the best of one of its choices
    best = ranked(scored, "asked").join(F.broadcast(choices.select("asked", "qid")), "asked")
    return ranked(best.groupBy("qid", "doc_id").agg(F.max("score").alias("score")), "qid")


def overlaps(asked: DataFrame, index: Index) -> DataFrame:
    """Shared words of ``asked`` (qid, n, term; each once) and documents: qid, doc_id, shared, n."""
    terms = asked.withColumn("stem", stem(F.col("term")))
    hits = index.of(terms).select("term", "doc_id").join(F.broadcast(terms.select("qid", "n", "term")), "term").distinct()
    return hits.groupBy("qid", "doc_id").agg(F.count("*").alias("shared"), F.min("n").alias("n"))


def _best_of_task(terms: pa.Array, askers: np.ndarray, ends: np.ndarray, n: np.ndarray, k: int, names: list[str]):
    """doc_id, terms (distinct) -> number of a query, doc_id, score: the best ``k`` documents of a task for each query.

    Term ``i`` of ``terms`` is asked for by ``askers[ends[i] : ends[i + 1]]``; ``n``: words of each query.
    """
    askers_of = np.diff(ends)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids, score = np.zeros(0, np.int64), None, np.zeros(0)
        for b in it:
            own = np.repeat(np.arange(b.num_rows), pc.list_value_length(b[1]).to_numpy(zero_copy_only=False))
            term = pc.fill_null(pc.index_in(pc.list_flatten(b[1]), value_set=terms), -1).to_numpy(zero_copy_only=False)
            own, term = own[term >= 0], term[term >= 0]
            times = askers_of[term]
            query = askers[np.repeat(ends[term], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            shared = np.bincount(np.repeat(own, times) * len(n) + query, minlength=b.num_rows * len(n))
            at = np.flatnonzero(shared)
            found = b[0].take(pa.array(at // len(n)))
            asked, score = np.append(asked, at % len(n)), np.append(score, shared[at] / n[at % len(n)])
            ids = found if ids is None else pa.concat_arrays([ids, found])
            # a null doc_id comes first among equals, as Spark orders it
            order = np.lexsort((pc.rank(ids, null_placement="at_start").to_numpy(), -rounded(score), asked))
            asked, score, ids = asked[order], score[order], ids.take(pa.array(order))
            kept = np.flatnonzero(np.arange(len(asked)) - np.searchsorted(asked, asked) < k)
            asked, score, ids = asked[kept], score[kept], ids.take(pa.array(kept))
        for x in range(0, len(asked), OUT):
            part = slice(x, x + OUT)
            yield pa.RecordBatch.from_arrays([pa.array(asked[part], pa.int32()), ids.slice(x, OUT), pa.array(rounded(score[part]))], names=names)

    return run


def _best_of_texts(asked: DataFrame, texts: Texts, k: int) -> DataFrame:
    """As lexical(), of ``asked`` (qid, w: the distinct words): each task counts the shared words of its documents in one pass, and passes on its best only."""
    spark = asked.sparkSession
    short_batches(spark)
    docs = texts.documents.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("terms"))
    # texts of rows that share a doc_id are one document's
    several = stored(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again")), "texts-again")
    if not several.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        met = docs.join(several, same, "left_semi").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
        docs = docs.join(several, same, "left_anti").union(met)
    fields = [docs.schema["doc_id"].dataType.simpleString(), asked.schema["qid"].dataType.simpleString()]
    parts, own = [], {}
    for r in asked.collect():  # the stated list of queries
        own.setdefault(r["qid"], []).append(r["w"])
    qids = list(own)
    for first in range(0, len(qids), QUERIES_AT_ONCE):
        some = qids[first : first + QUERIES_AT_ONCE]
        by_term: dict[str, list[int]] = {}
        for q, qid in enumerate(some):
            for term in (t for w in own[qid] for t in w):
                by_term.setdefault(term, []).append(q)
        ends = np.cumsum([0, *map(len, by_term.values())])
        askers = np.fromiter((q for each in by_term.values() for q in each), np.int64)
        n = np.array([min(map(len, own[qid])) for qid in some])
        run = _best_of_task(pa.array(by_term, pa.string()), askers, ends, n, k, ["asked", "doc_id", "score"])
        named = spark.createDataFrame(list(enumerate(some)), f"asked int, qid {fields[1]}")
        parts.append(docs.mapInArrow(run, f"asked int, doc_id {fields[0]}, score double").join(F.broadcast(named), "asked").select("qid", "doc_id", "score"))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], f"qid {fields[1]}, doc_id {fields[0]}, score double")


def lexical(queries: DataFrame, index: Index | Texts, k: int) -> DataFrame:
    """Documents by the share of a query's words that they have: qid, doc_id, score, rank (1 to ``k``).

    ``queries``: qid, text.  Words are those of three letters or more, as they are written.
    """
    asked = queries.select("qid", words(F.col("text")).alias("w"))
    if isinstance(index, Texts):
        scored = _best_of_texts(asked, index, k)
    else:
        hits = overlaps(asked.select("qid", F.size("w").alias("n"), F.explode("w").alias("term")), index)
        scored = hits.select("qid", "doc_id", F.round(F.col("shared") / F.col("n"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def probe(queries: DataFrame, labels: DataFrame, most_codes: int = 3, most: int = 5) -> DataFrame:
    """Rows whose label holds a code of the query, in any case: qid, id, code, rank (1 to ``most``).

    ``queries``: qid, text; ``labels``: id and the short columns that carry references, nulls allowed.  Codes are hyphenated and
    have a digit; the first ``most_codes`` of a query count.  A query without a code asks nothing.  An id is
    listed once, under the first code that it has; ties go by id.
    """
    asked = queries.select("qid", F.posexplode(reference_codes(F.col("text"), most_codes)).alias("nth", "code"))
    names = [c for c in labels.columns if c != "id"]
    text = F.lower(F.concat_ws("\n", *names))
    met = meet(labels.select("id", text.alias("label")), asked).where(F.contains("label", F.lower("code")))
    first = met.groupBy("qid", "id").agg(F.min(F.struct("nth", "code")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("x.nth", "id"))
    return first.select("qid", "id", F.col("x.code").alias("code"), rank.alias("rank")).where(F.col("rank") <= most)
