"""Quality scores from supervised subword embeddings.

A text's features are its words, the character n-grams of each word between borders, and its
pairs of neighbouring words, all hashed into one table of vectors.  Their average, through a
softmax layer, gives the probabilities of the labels.  Vectors and layer are learned together
by stochastic gradient descent in numpy.

Training reads a bounded sample of labelled documents (SAMPLE, drawn by a hash of doc_id), so
it runs in one task of bounded size and sends a model of BUCKETS x WIDTH floats.  Scoring reads
every document's whole text; a word's own features are summed once for a worker.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, short_batches, table
from .langmix import held_out

BUCKETS, WIDTH, GRAMS = 1 << 17, 12, (2, 3, 4)
#: Labelled documents that training reads at most, about; passes over them; first step size.
SAMPLE, EPOCHS, RATE, SEED = 6_000, 8, 0.5, 7
#: Words whose sums a worker keeps, and characters of text scored at once.
WORDS_KEPT, GROUP_CHARS = 300_000, 1 << 20
CUT = 0.7

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class _Words(dict):
    """word -> its place; new words get the next place and are remembered as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's own features (itself and its n-grams), word after word, and how many."""
    joined = " " + " ".join(words) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1  # the border before each word
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    parts, counts = [whole % np.uint64(BUCKETS)], [np.ones(len(words), np.int64)]
    for n in GRAMS:
        mixed = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for k in range(n):
            mixed = (mixed * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]) & np.uint64(0xFFFFFFFFFF)
        bucket = (mixed * np.uint64(0x9E3779B1) >> np.uint64(12)) % np.uint64(BUCKETS)
        fits = np.maximum(size + 2 - n + 1, 0)
        parts.append(bucket[ranges(begin, fits)])
        counts.append(fits)
    owner = np.concatenate([np.repeat(np.arange(len(words)), c) for c in counts])
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order].astype(np.int64), sum(counts)


def pair_features(hashed: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from the words' hashes; a word twice over is one feature for all words."""
    mixed = hashed[:-1] * np.uint64(0x85EBCA6B) + hashed[1:] * np.uint64(0xC2B2AE35) + np.uint64(1)
    return np.where(hashed[:-1] == hashed[1:], 0, (mixed >> np.uint64(7)).astype(np.int64) % BUCKETS)


def text_words(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def fit(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (BUCKETS x WIDTH) and layer (WIDTH + 1, the last for the constant) for two labels."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = np.zeros((2, WIDTH + 1), np.float32)
    examples = []
    for text in texts:
        words = text_words(text)
        if words:
            every = np.concatenate([word_features(words)[0], pair_features(_hashes(words))])
            found, counts = np.unique(every, return_counts=True)
            examples.append((found.astype(np.int32), (counts / counts.sum()).astype(np.float32)))
        else:
            examples.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)).tolist():
            rate = RATE * (1 - done / steps)
            done += 1
            at, weight = examples[i]
            x = np.append(weight @ vectors[at], np.float32(1))
            z = layer @ x
            p = np.exp(z - z.max())
            error = (p / p.sum()).astype(np.float32)
            error[labels[i]] -= 1
            back = error @ layer[:, :-1]
            layer -= rate * np.outer(error, x)
            # a bucket's weight is a small share of the text: steps are scaled to the features
            vectors[at] -= (rate * np.float32(len(at) ** 0.5)) * weight[:, None] * back
    return vectors, layer[1] - layer[0]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1), in one bounded task.

    Null labels are left out.  Of the rows of one doc_id the least text is learned from, so that the sample's bound holds
    however often an id is used.  No labelled row: a model that gives every text one half.
    """
    spark = docs.sparkSession
    known = labels.where("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    size = known.count()
    if not size:
        return np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(WIDTH + 1, np.float32)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = docs.select("doc_id", "text").join(known.where(draw < min(1.0, sample / size)), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def learn(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["doc_id", "text"], kind="stable")
        vectors, layer = fit(held["text"].tolist(), held["label"].astype(int).tolist())
        return pd.DataFrame({"vectors": [vectors.astype("<f4").tobytes()], "layer": [layer.astype("<f4").tobytes()]})

    found = chosen.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(learn, "vectors binary, layer binary").collect()
    if not found:
        return np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(WIDTH + 1, np.float32)
    return np.frombuffer(found[0]["vectors"], "<f4").reshape(BUCKETS, WIDTH), np.frombuffer(found[0]["layer"], "<f4")


class Scorer:
    """A worker's view of the model, with the sums of words it has met."""

    def __init__(self, vectors: np.ndarray, layer: np.ndarray):
        # the layer is linear: each bucket's vector counts by its product with the layer alone
        self.weight, self.constant = (vectors @ layer[:-1]).astype(np.float64), float(layer[-1])
        self._clear()

    def _clear(self) -> None:
        self.places = _Words()
        self.sums, self.counts, self.hashed = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def _learn(self) -> None:
        if new := self.places.new:
            flat, sizes = word_features(new)
            self.sums = np.concatenate([self.sums, np.add.reduceat(self.weight[flat], np.cumsum(sizes) - sizes)])
            self.counts = np.concatenate([self.counts, sizes])
            self.hashed = np.concatenate([self.hashed, _hashes(new)])
            self.places.new = []

    def scores(self, texts: list[str | None]) -> Iterator[float]:
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str | None]) -> list[float]:
        if len(self.places) > WORDS_KEPT:
            self._clear()
        words = [text_words(t) for t in texts]
        at = [np.fromiter(map(self.places.__getitem__, w), np.int64, len(w)) for w in words]
        self._learn()
        found = []
        for own in at:
            total, n = 0.0, 1
            if len(own):
                total = self.sums[own].sum() + self.weight[pair_features(self.hashed[own])].sum()
                n = self.counts[own].sum() + len(own) - 1
            found.append(float(1 / (1 + np.exp(-np.clip(total / n + self.constant, -500, 500)))))
        return found


_SCORERS: dict[str, Scorer] = {}


def _scores(held, key: str):
    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(*held.value)
        for b in it:
            found = pa.array(list(scorer.scores(b[1].to_pylist())), pa.float64())
            yield pa.RecordBatch.from_arrays([b[0], found], names=["doc_id", "score"])

    return score


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (probability of label 1).

    Reads doc_id and text only.  Null, empty and blank texts have no feature and get the
    constant's probability.
    """
    spark = docs.sparkSession
    short_batches(spark)
    held = spark.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scores(held, uuid.uuid4().hex), "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(4, 2), F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~out).select("doc_id", F.col("quality").alias("label"))
    model = train(docs.where(~out), labels)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
