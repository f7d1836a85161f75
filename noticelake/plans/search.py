"""Search as a plan: which arms run, how they are joined, and what the answer says about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fulltext as FT
from ..operators import vectors as V


def search(queries: DataFrame, points: DataFrame | None, index: FT.Index | FT.Texts, k: int = 20, threshold: float = 0.5) -> DataFrame:
    """qid, id, score, place, retrieval, degraded_reason.

    ``queries``: qid, text, qvec; ``index``: the stored one, or the texts.  With ``points`` both arms run and are fused; without them the
    lexical arm answers alone and the reason says so.  Nothing raises for a missing arm.
    """
    lexical = FT.lexical(queries.select("qid", "text"), index, k).select("qid", F.col("doc_id").alias("id"), "score", "rank")
    if points is None:
        return lexical.select("qid", "id", "score", F.col("rank").alias("place"), F.lit("lexical").alias("retrieval"), F.lit("vector_store_unavailable").alias("degraded_reason"))
    dense = V.top_k(queries.select("qid", "qvec"), points, k, threshold).select("qid", F.col("vec_id").alias("id"), "score", "rank")
    fused = V.fuse([("dense", dense), ("lexical", lexical)], limit=k)
    return fused.select("qid", "id", "score", "place", "retrieval", F.lit("").alias("degraded_reason"))


def cached(questions: DataFrame, store: DataFrame, now, ttl_seconds: int, version: int, similar: float = 0.92) -> DataFrame:
    """Answers from a semantic cache: qid, answer_id, how (exact, similar or null).

    ``questions``: qid, key, scope, qvec; ``store``: answer_id, key, scope, embedding, stored_at,
    version.  An exact key wins, else the most similar question of the same scope.
    """
    live = store.where((F.col("version") == version) & (F.col("stored_at") >= F.lit(now) - F.make_dt_interval(secs=F.lit(ttl_seconds))))
    exact = questions.join(live.select("key", "scope", "answer_id"), ["key", "scope"]).groupBy("qid").agg(F.min("answer_id").alias("exact"))
    near = V.top_k(questions.select("qid", "scope", "qvec"), live.select(F.col("answer_id").alias("vec_id"), "scope", "embedding"), 1, similar, ["scope"])
    found = questions.select("qid").join(exact, "qid", "left").join(near.select("qid", F.col("vec_id").alias("near")), "qid", "left")
    return found.select("qid", F.coalesce("exact", "near").alias("answer_id"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "similar").alias("how"))
