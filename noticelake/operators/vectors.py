"""Exact cosine search, passage overlap, rank fusion and near-duplicate suppression.

Scores are rounded to six places, as sums of floats depend on their order; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

#: Query rows up to which the query side is broadcast; beyond it both sides meet in blocks.
QUERIES_HELD = 20_000
#: Points or queries of one cell of a search, at most; queries of one cell while these make few blocks; cells that a shorter list is still dealt to, and points of one of those; queries that a cell multiplies at once.
CELL_POINTS, CELL_QUERIES, CELLS, LEAST_POINTS, AT_ONCE = 32_768, 8_192, 8, 2_048, 128
#: Share of a product that reaches the threshold up to which its rows are cut by sorting what reaches it.
SPARSE = 1 / 32


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors: their dot product in double."""
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), 6)


def meet(points: DataFrame, queries: DataFrame, same: list[str] = ()) -> DataFrame:
    """Every point beside every query of the stated list that agrees with it in ``same``.

    Up to QUERIES_HELD queries go to every task.  More are dealt to blocks of that size, each point is sent
    to every block, and both meet by an equi join on the block.
    """
    n = queries.count()
    if n <= QUERIES_HELD:
        q = F.broadcast(queries)
        return points.join(q, list(same)) if same else points.join(q, F.lit(True))
    blocks = -(-n // QUERIES_HELD)
    dealt = queries.withColumn("__block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    sent = points.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return sent.join(dealt, ["__block", *same]).drop("__block")


def matrix(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors in double by their width: the places where they stood, and a row for each."""
    width = vectors.map(len, na_action="ignore")
    places = {int(w): np.flatnonzero(width == w) for w in width.dropna().unique()}
    return {w: (at, np.stack(vectors.iloc[at].to_numpy()).astype("float64")) for w, at in places.items()}


def rounded(scores: np.ndarray) -> np.ndarray:
    """As Spark rounds: half up on the shortest decimal form."""
    scores = np.asarray(scores, "float64")
    with np.errstate(all="ignore"):
        millionths = np.abs(scores) * 1e6
        out = np.copysign(np.floor(millionths + 0.5) / 1e6, scores)
        # close to a half, or so large that a product is inexact, the decimal form decides
        hard = ~((np.abs(millionths - np.floor(millionths) - 0.5) > 1e-4) & (millionths < 1e9))
    value, place = np.unique(scores[hard], return_inverse=True)
    half_up = [float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if np.isfinite(x) else x for x in value]
    out[hard] = np.asarray(half_up, "float64")[place]
    return out


def best_of_cell(q: pd.DataFrame, p: pd.DataFrame, k: int, threshold: float | None, apart: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Places in ``q`` and ``p``, scores, and whether there is one, of the best ``k`` points of each query; ``p`` is in order of its ids.

    A product of matrices names all points that may be among them, which are then scored term by term in the order of
    the vector, so that scores do not depend on how a library adds up.
    """
    left, right = matrix(q["v"]), matrix(p["v"])
    owners = pd.factorize(pd.concat([q["owner"], p["owner"]]))[0] if apart else None
    for first in range(0, len(q), AT_ONCE):
        n = min(AT_ONCE, len(q) - first)
        near = np.full((n, len(p)), -np.inf)
        for w, (at, rows) in left.items():
            own = (at >= first) & (at < first + n)
            if w in right and own.any():
                with np.errstate(all="ignore"):
                    product = rows[own] @ right[w][1].T
                if n == own.sum() and len(p) == len(right[w][0]):
                    near = product
                else:
                    near[np.ix_(at[own] - first, right[w][0])] = product
        near[np.isnan(near)] = np.inf
        # rounding moves a score by half a millionth at most
        may = near >= (-np.inf if threshold is None else threshold - 2e-6)
        if dense := k < len(p) and np.count_nonzero(may) > SPARSE * may.size:
            if apart:
                near[owners[first : first + n, None] == owners[None, len(q) :]] = -np.inf
            may &= near >= np.partition(near, len(p) - k, axis=1)[:, len(p) - k, None] - 2e-6
        row, col = np.nonzero(may)
        if apart:
            other = owners[first + row] != owners[len(q) + col]
            row, col = row[other], col[other]
        if not dense and k < len(p):
            high = near[row, col]
            order = np.lexsort((-high, row))
            last = order[np.arange(len(row)) - np.searchsorted(row, row) == k - 1]
            least = np.full(n, -np.inf)
            least[row[last]] = high[last]
            kept = high >= least[row] - 2e-6
            row, col = row[kept], col[kept]
        score = np.full(len(row), np.nan)
        known = np.zeros(len(row), bool)
        for w, (at, rows) in left.items():
            if w not in right:
                continue
            to_left, to_right = np.full(len(q), -1), np.full(len(p), -1)
            to_left[at], to_right[right[w][0]] = np.arange(len(at)), np.arange(len(right[w][0]))
            x, y = to_left[row + first], to_right[col]
            here = np.flatnonzero((x >= 0) & (y >= 0))
            total = np.zeros(len(here))
            with np.errstate(all="ignore"):
                for d in range(w):
                    total += rows[x[here], d] * right[w][1][y[here], d]
            score[here], known[here] = total, True
        score = rounded(score)
        if threshold is not None:
            kept = known & ((score >= threshold) | np.isnan(score))
            row, col, score, known = row[kept], col[kept], score[kept], known[kept]
        high = np.where(known, np.where(np.isnan(score), np.inf, score), -np.inf)
        order = np.lexsort((col, ~known, -high, ~(known & np.isnan(score)), row))
        row, col, score, known = row[order], col[order], score[order], known[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        take = place < k
        yield row[take] + first, col[take], score[take], known[take]


def nearest(queries: DataFrame, points: DataFrame, k: int, threshold: float | None = None, apart: bool = False) -> DataFrame:
    """At least the best ``k`` points of each query, by score and then by vec_id: qid, vec_id, score, and the point's ``owner`` if ``apart``.

    ``queries``: qid, qvec; ``points``: vec_id, embedding; both with ``owner`` if ``apart``, where a query's own points
    and rows without an owner take no part.  Both sides are dealt to cells of a part of the queries and a part of the
    points, and every query meets every point in one of them; a cell passes on its best only.  A vector that is null or holds a null, and one of another
    width, has a null score, which comes last and meets no threshold.
    """
    more = ["owner"] if apart else []
    whole = lambda v: F.when(~F.exists(v, lambda x: x.isNull()), F.col(v)).alias("v")
    q, p = queries.select("qid", whole("qvec"), *more), points.select("vec_id", whole("embedding"), *more)
    for name in more:
        q, p = q.where(F.col(name).isNotNull()), p.where(F.col(name).isNotNull())
    if threshold is not None:
        q, p = q.where("v IS NOT NULL"), p.where("v IS NOT NULL")
    n, m = q.count(), p.count()
    blocks = max(1, -(-n // CELL_POINTS), min(CELLS, -(-n // CELL_QUERIES)))
    chunks = max(1, -(-m // CELL_POINTS), min(CELLS, -(-m // LEAST_POINTS)))
    part = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = q.withColumn("block", part("qid", blocks)).withColumn("chunk", every(chunks))
    p = p.withColumn("chunk", part("vec_id", chunks)).withColumn("block", every(blocks))
    fields = [q.schema["qid"], p.schema["vec_id"], StructField("score", DoubleType()), *[p.schema[c] for c in more]]

    def meet_in_cell(asked: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("vec_id")
        parts = []
        if len(asked) and len(own):
            for row, col, score, known in best_of_cell(asked.to_pandas(), own.to_pandas(), k, threshold, apart):
                found = [asked["qid"].take(pa.array(row)), own["vec_id"].take(pa.array(col)), pa.array(score, mask=~known), *[own[c].take(pa.array(col)) for c in more]]
                parts.append(pa.table(dict(zip(names, found, strict=True))))
        return pa.concat_tables(parts) if parts else empty

    names = [f.name for f in fields]
    empty = pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in fields})
    return q.groupBy("block", "chunk").cogroup(p.groupBy("block", "chunk")).applyInArrow(meet_in_cell, StructType(fields))


def top_k(queries: DataFrame, points: DataFrame, k: int, threshold: float | None = None, same: list[str] = ()) -> DataFrame:
    """Best ``k`` points of each query: qid, vec_id, score, rank from 1.

    ``queries``: qid, qvec and the columns of ``same``; ``points``: vec_id, embedding and those.
    The query set is a stated list held against all points.  Filters belong on ``points``, before
    the search.
    """
    if same:
        scored = meet(points, queries, list(same)).select("qid", "vec_id", cosine(F.col("embedding"), F.col("qvec")).alias("score"))
        scored = scored.where(F.col("score") >= threshold) if threshold is not None else scored
    else:
        scored = nearest(queries, points, k, threshold)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def words(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of letters, at least ``least`` long."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(\p{{L}}{{{least},}})"), F.lit(1)))


def overlap(query: Column, passage: Column) -> Column:
    """Share of the query's words that the passage has."""
    return F.round(F.size(F.array_intersect(query, passage)) / F.greatest(F.size(query), F.lit(1)), 6)


def fuse(arms: list[tuple[str, DataFrame]], k: int = 60, limit: int = 20) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, id, rank): qid, id, score, rank_<arm>, retrieval, place.

    A list that lacks a row adds nothing.  Ties go to the row that an earlier arm ranks better.
    """
    every = None
    for i, (name, df) in enumerate(arms):
        one = df.select("qid", "id", "rank", F.lit(i).alias("arm"), F.lit(name).alias("name"))
        every = one if every is None else every.union(one)
    found = every.groupBy("qid", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"),
        F.min(F.struct("arm", "rank")).alias("first"),
        F.when(F.count("*") > 1, "hybrid").otherwise(F.min("name")).alias("retrieval"),
        *[F.max(F.when(F.col("name") == name, F.col("rank"))).alias(f"rank_{name}") for name, _ in arms],
    )
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first", "id"))
    return found.withColumn("place", place).where(F.col("place") <= limit).drop("first")


def select_passages(hits: DataFrame, limit: int, per_notice: int = 3, similar: float = 0.9, least_words: int = 8) -> DataFrame:
    """Passages worth showing, in rank order: qid, doc_id, place.

    ``hits``: qid, doc_id, notice, rank, text.  A passage whose words are those of one already
    kept goes, and so does a notice's fourth.  What is kept depends on what was kept before, so a
    query's list, which is short, is walked in order.
    """
    prepared = hits.select("qid", "doc_id", "notice", "rank", words(F.col("text")).alias("w"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, seen, count = [], [], {}
        for row in pdf.sort_values("rank").itertuples():
            if len(kept) >= limit:
                break
            own = set(row.w)
            if count.get(row.notice, 0) >= per_notice:
                continue
            if len(own) >= least_words and any(len(own & s) >= similar * len(own | s) for s in seen):
                continue
            kept.append((row.qid, row.doc_id, len(kept) + 1))
            seen.append(own)
            count[row.notice] = count.get(row.notice, 0) + 1
        return pd.DataFrame(kept, columns=["qid", "doc_id", "place"])

    return prepared.groupBy("qid").applyInPandas(walk, "qid long, doc_id long, place long")


def duplicates(points: DataFrame, others: DataFrame, similar: float, most: int) -> DataFrame:
    """How many other owners have a point as similar: vec_id, duplicates (at most ``most``).

    ``points`` (vec_id, owner, embedding) is the stated query side, ``others`` the same for all.
    The best ``most`` hits are taken first, then their distinct owners counted.
    """
    q = points.select(F.col("vec_id").alias("qid"), "owner", F.col("embedding").alias("qvec"))
    hits = nearest(q, others, most, similar, apart=True)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    counted = hits.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("qid").agg(F.countDistinct("owner").alias("duplicates"))
    return points.select("vec_id").join(counted, F.col("vec_id") == F.col("qid"), "left").select("vec_id", F.coalesce("duplicates", F.lit(0)).alias("duplicates"))


def due_for_neighbours(notices: DataFrame, before: Column, budget: int) -> DataFrame:
    """Notices whose neighbours are computed next: id, tier.

    ``notices``: id, fresh (just indexed), open, computed_at.  All fresh ones (tier 0), then of the open ones
    without neighbours or with some from before ``before`` the oldest ``budget``, missing ones first.
    """
    fresh = notices.where("fresh").select("id", F.lit(0).alias("tier"))
    stale = notices.where(~F.col("fresh") & F.col("open") & (F.col("computed_at").isNull() | (F.col("computed_at") < before)))
    return fresh.union(stale.orderBy(F.asc_nulls_first("computed_at"), "id").limit(budget).select("id", F.lit(1).alias("tier")))


#: Words of a title that say nothing of its topic, and duplicates from which a passage is boilerplate.
TITLE_STOPWORDS = (
    "the of and for in to a an on at by with procurement supply services service works work contract "
    "project consulting consultancy consultant tender bid bids notice award lot no phase part"
).split()
BOILERPLATE = 8


def topicality(title: Column, content: Column) -> Column:
    """How many telling words of a title a passage has."""
    wanted = F.array_except(words(title), F.array(*map(F.lit, TITLE_STOPWORDS)))
    return F.size(F.array_intersect(wanted, words(content)))


def representatives(passages: DataFrame, count: int = 1) -> DataFrame:
    """The ``count`` most telling passages of each source: source, vec_id, topicality, duplicates, place (from 1).

    ``passages``: source, vec_id, duplicates, and topicality or the title and content that give it.  Boilerplate counts
    only in a source of nothing else.  Title words held come first, then fewer duplicates, then the smaller vec_id.
    """
    telling = F.col("topicality") if "topicality" in passages.columns else topicality(F.col("title"), F.col("content")).alias("topicality")
    scored = passages.select("source", "vec_id", telling, "duplicates", (F.col("duplicates") >= BOILERPLATE).alias("common"))
    least = scored.groupBy("source").agg(F.min("common").alias("only"))
    pool = scored.join(least, "source").where("common = only")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("topicality"), "duplicates", "vec_id"))
    return pool.select("source", "vec_id", "topicality", "duplicates", place.alias("place")).where(F.col("place") <= count)


def rerank(hits: DataFrame, scorer=None, top: int = 10) -> DataFrame:
    """Order (qid, doc_id, rank, text) by an injected scorer of text batches; any failure leaves the order.

    ``scorer``: list of texts -> list of floats.
    """
    if scorer is None:
        return hits.where(F.col("rank") <= top)

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            try:
                pdf["score"] = [float(x) for x in scorer(pdf["text"].tolist())]
            except Exception:  # a scorer that fails must not lose the search
                pdf["score"] = -pdf["rank"].astype(float)
            yield pdf[["qid", "doc_id", "rank", "text", "score"]]

    scored = hits.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), "text").mapInPandas(score, "qid long, doc_id long, rank long, text string, score double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank"))
    return scored.withColumn("rank", place).where(F.col("rank") <= top).select("qid", "doc_id", "rank", "text")


def embed(passages: DataFrame, embedder, width: int, batch: int = 100, most_chars: int = 2000, attempts: int = 3) -> DataFrame:
    """vec_id, embedding, problem of passages (vec_id, text) by an injected ``embedder(texts) -> vectors``.

    Batched, cut to ``most_chars``, tried again, and checked for their width; a batch that keeps
    failing has null vectors and its problem.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k in range(0, len(pdf), batch):
                ids, texts = pdf["vec_id"].iloc[k : k + batch].tolist(), [(t or "")[:most_chars] for t in pdf["text"].iloc[k : k + batch]]
                problem, found = "", None
                for _ in range(attempts):
                    try:
                        found = [[float(x) for x in v] for v in embedder(texts)]
                        if any(len(v) != width for v in found):
                            raise ValueError(f"width is not {width}")
                        problem = ""
                        break
                    except Exception as e:  # data, not a failed job
                        problem, found = f"{type(e).__name__}: {e}", None
                out += [(i, found[j] if found else None, problem) for j, i in enumerate(ids)]
            yield pd.DataFrame(out, columns=["vec_id", "embedding", "problem"])

    return passages.select("vec_id", "text").mapInPandas(run, "vec_id long, embedding array<float>, problem string")
