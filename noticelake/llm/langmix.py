"""Language identification as mixture inference.

Training counts hashed character trigrams of words for every language; the model is one table
of log probabilities, buckets by languages.  A document is a mixture: each of its words was
drawn from one language, and a word's likelihood under a language is the product over its
trigrams.  Expectation-maximisation finds the proportions.  The set of languages is chosen by
penalised likelihood: starting from the best single language, the one with the steepest rise
of the likelihood joins as long as the gain exceeds PENALTY * log(words) for its proportion.

All of a text is read: words are counted in a worker's batch, so a word costs one lookup and
a document's work follows its distinct words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, short_batches, table

BUCKETS = 1 << 16
#: Labelled documents that training reads for each language, about.
SAMPLE = 20_000
SMOOTHING, PENALTY, ROUNDS, SETTLED = 0.5, 0.5, 30, 1e-3
#: Words whose likelihoods a worker keeps, and characters of text judged at once.
WORDS_KEPT, GROUP_CHARS = 300_000, 1 << 20

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if the text has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each word between its borders, one word after another, and how many each has."""
    line = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mixed = (line[:-2] * np.uint64(0x1F1F1F) + line[1:-1]) * np.uint64(0x2F0B4C7) + line[2:]
    bucket = ((mixed * np.uint64(0x9E3779B1)) % np.uint64(1 << 32)) >> np.uint64(16)
    return bucket[line[1:-1] != 32].astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


class _Words(dict):
    """word -> its place; new words get the next place and are remembered as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language of a task's training texts."""
    held: dict[str, np.ndarray] = {}
    for b in it:
        for lang, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
            own = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            if words := words_of(text):
                own += np.bincount(trigrams(words)[0], minlength=BUCKETS)
    for lang, own in held.items():
        at = np.flatnonzero(own)
        found = {"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": own[at]}
        yield pa.RecordBatch.from_pydict(found, schema=_COUNTS)


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (buckets x languages) from ``labelled`` (doc_id, text, lang).

    Where a language has more than ``sample`` documents, those are read whose hash of doc_id lies
    under the share that leaves about that many.  Every language with a label is learned, however rare.
    Only counts reach the driver: at most BUCKETS a language, so the model grows with the number of
    languages and not with the rows.
    """
    spark = labelled.sparkSession
    short_batches(spark)
    known = labelled.where("lang IS NOT NULL")
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    shares = F.broadcast(
        spark.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in sizes], "lang string, share double")
    )
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = known.join(shares, "lang").where(draw < F.col("share")).select("lang", "text")
    counted = chosen.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    langs = sorted(r["lang"] for r in sizes)
    counts = np.zeros((BUCKETS, len(langs)))
    column = {x: i for i, x in enumerate(langs)}
    where = np.array([column[x] for x in found["lang"].to_pylist()], np.int64)
    counts[found["bucket"].to_numpy().astype(np.int64), where] = found["n"].to_numpy()
    spread = counts + SMOOTHING * (1e-3 + counts.sum(1, keepdims=True) / max(1.0, counts.sum()))
    return langs, np.log(spread / spread.sum(0)).astype(np.float32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def infer(likelihood: np.ndarray, counts: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (documents x languages) for many documents at once; zero outside a document's set.

    ``likelihood``: log likelihood of every distinct word of every document in each language,
    document after document; ``counts``: how often it stands there; ``sizes``: distinct words
    of each document, one at least.

    The likelihood is concave in the proportions, so a language can raise it by no more than
    its slope there (a word's likelihood over that under the mixture, summed, less the words).
    Languages whose slope is below the penalty are out at once; of the others the steepest is
    tried first, and joins if EM shows that it gains more than the penalty.
    """
    starts = np.cumsum(sizes) - sizes
    top = likelihood.max(1)
    p = np.exp(likelihood - top[:, None])
    total = _sums(counts, starts)
    cost = penalty * np.log(total + 1)
    single = _sums(counts[:, None] * likelihood, starts)
    best = single.argmax(1)
    share = np.zeros(single.shape)
    share[np.arange(len(best)), best] = 1
    value, refused = single.max(1), np.zeros(single.shape, bool)
    live = np.arange(len(sizes))
    while len(live):
        rows = ranges(starts[live], sizes[live])
        own, n = p[rows], counts[rows]
        at = np.repeat(np.arange(len(live)), sizes[live])
        first = np.cumsum(sizes[live]) - sizes[live]
        mixed = np.maximum((own * share[live][at]).sum(1), 1e-300)
        slope = _sums(np.minimum(own / mixed[:, None], 1e12) * n[:, None], first) - total[live, None]
        slope[(share[live] > 0) | refused[live]] = -np.inf
        steepest = slope.argmax(1)
        open_ = slope[np.arange(len(live)), steepest] > cost[live]
        live, steepest = live[open_], steepest[open_]
        if not len(live):
            break
        rows = ranges(starts[live], sizes[live])
        tried, gained = _mixture(p[rows], counts[rows], sizes[live], share[live], steepest)
        gained += _sums(counts[rows] * top[rows], np.cumsum(sizes[live]) - sizes[live])
        joins = gained - value[live] > cost[live]
        refused[live[~joins], steepest[~joins]] = True
        share[live[joins]], value[live[joins]] = tried[joins], gained[joins]
    return share


def _mixture(p, counts, sizes, share, added) -> tuple[np.ndarray, np.ndarray]:
    """EM from ``share`` with one language ``added`` to each document: proportions, log likelihood."""
    share = share.copy()
    members = (share > 0).sum(1)
    share *= (members / (members + 1))[:, None]
    share[np.arange(len(added)), added] = 1 / (members + 1)
    starts = np.cumsum(sizes) - sizes
    total, value = _sums(counts, starts), np.zeros(len(sizes))
    live = np.arange(len(sizes))
    for turn in range(ROUNDS + 1):
        rows = ranges(starts[live], sizes[live])
        at = np.repeat(np.arange(len(live)), sizes[live])
        first = np.cumsum(sizes[live]) - sizes[live]
        joint = p[rows] * share[live][at]
        each = np.maximum(joint.sum(1), 1e-300)
        value[live] = _sums(counts[rows] * np.log(each), first)
        if turn == ROUNDS:
            break
        new = _sums(joint * (counts[rows] / each)[:, None], first) / total[live, None]
        moved = np.abs(new - share[live]).max(1)
        share[live] = new
        live = live[moved >= SETTLED]
        if not len(live):
            break
    return share, value


class Model:
    """A worker's view of the trained table, with the likelihoods of words it has met."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        self._clear()

    def _clear(self) -> None:
        self.places, self.values = _Words(), np.zeros((0, len(self.langs)), np.float32)

    def _learn(self) -> None:
        if new := self.places.new:
            flat, sizes = trigrams(new)
            self.values = np.concatenate([self.values, _sums(self.table[flat], np.cumsum(sizes) - sizes)])
            self.places.new = []

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Main language and its proportion; ``und`` and 0 for null or a text without a letter."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.places) > WORDS_KEPT:
            self._clear()
        words = [words_of(t) for t in texts] if self.langs else [[] for _ in texts]
        found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        full = [i for i, w in enumerate(words) if w]
        if not full:
            return found
        at = [np.fromiter(map(self.places.__getitem__, words[i]), np.int64, len(words[i])) for i in full]
        self._learn()
        wide = len(self.places)
        keys = np.concatenate([a + k * wide for k, a in enumerate(at)])
        distinct, counts = np.unique(keys, return_counts=True)
        sizes = np.bincount(distinct // wide, minlength=len(full))
        share = infer(self.values[distinct % wide].astype(np.float64), counts.astype(np.float64), sizes)
        for i, own in zip(full, share, strict=True):
            k = int(own.argmax())
            found[i] = (self.langs[k], float(min(1.0, own[k])))
        return found


_MODELS: dict[str, Model] = {}


def _model(held, key: str) -> Model:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*held.value)
    return _MODELS[key]


def _predict(held, key: str):
    def predict(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held, key)
        for b in it:
            found = list(model.predict(b[1].to_pylist()))
            langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b[0], langs, scores], names=["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (share of the main language).

    Reads doc_id and text only.  Null texts and texts without a letter, and all texts where
    nothing was learned: ``und`` and 0.  The model is a broadcast of BUCKETS floats a language.
    """
    spark = docs.sparkSession
    short_batches(spark)
    held = spark.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(
        _predict(held, uuid.uuid4().hex),
        "doc_id long, lang_pred string, score double",
    )


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` with a language, all columns as they are; ``und`` rows go.  No shuffle."""
    spark = docs.sparkSession
    short_batches(spark)
    held, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            langs = _model(held, key).predict(b.column("text").to_pylist())
            yield b.filter(pa.array([x[0] != "und" for x in langs], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(parts: int, remainder: int):
    """Whether crc32 of doc_id as text leaves ``remainder`` modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(5, 0), F.lit(False))
    model = train(docs.where(~out).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
