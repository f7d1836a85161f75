"""A hidden Markov language model over whole texts.

A text is a chain of hidden states; a state emits a word's class and the class the word.  The most
frequent training words are classes of their own, all other words, unseen ones too, share a class with the
words of the same ending, so the table of emissions has a fixed size while the counts of words
follow the corpus:

    P(word | state) = P(class | state) * (c + 0.1) / (C + 0.1 * (V + 1))

with c the word's count, C and V the tokens and distinct words of its class.  One class in V + 1 parts
is kept for words that training has not seen.

Counts of all words are taken over all training texts and stay a distributed table.  The words with the
highest counts, HELD at most, go to every task; the others meet the table by a join.  Baum-Welch
runs over the stored class sequences: every task adds up the expected counts of its texts, Spark
adds up the tasks, and the driver sees CLASSES rows a round.  The first rounds take a part of the training texts
each, and every text is in one of the parts; the last ones take all.

Likelihoods come from the scaled forward recursion over the whole sequence.  All texts of a group go
through it in step, longest first, so that a step is one matrix product.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, short_batches, stored, table, utf8
from .langmix import held_out

STATES = 8
#: Words with a class of their own, and classes of endings; the last class is the end of a text.
OWN, ENDINGS = 24_000, 8_000
CLASSES = OWN + ENDINGS + 1
END = CLASSES - 1
#: Words whose counts every task holds.
HELD = 250_000
#: Texts of a part at least, rounds that give the start, of a part each, and rounds over all texts.
START_TEXTS, START_ROUNDS, ROUNDS = 2_000, 15, 3
#: Added to every count of a word; tokens, and share of its own, that a state is given after all texts.
ADDED, PRIOR, SHARED = 0.1, 5_000, 0.02
#: Chance that a state stays before anything is learned.
STAY = 0.98
#: Steps between two scalings, tokens of a group, tokens a worker gathers before it groups them.
SCALED, GROUP, GATHERED = 12, 1 << 18, 1 << 21
#: Words a worker counts before it hands them on, and characters cut to words at once.
COUNTED, PIECE = 200_000, 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words with A-Z in lower case, a bounded piece of the text at a time."""
    at = 0
    while at < len(text):
        stop = at + PIECE
        if stop < len(text):
            found = _BLANK.search(text, stop)
            stop = found.end() if found else len(text)
        yield text[at:stop].lower().split()
        at = stop


def ending(word: bytes) -> int:
    """The class of a word that has none of its own; the end of a text is the empty word."""
    return OWN + zlib.crc32(word[-3:]) % ENDINGS if word else END


# --- counts -----------------------------------------------------------------------------------

_WORDS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()
    for b in it:
        for text in utf8(b[0]):
            for words in words_of(text):
                held.update(words)
            held[b""] += 1
            if len(held) > COUNTED:
                yield from batches(iter(held.items()), _WORDS, 1 << 15)
                held.clear()
    yield from batches(iter(held.items()), _WORDS, 1 << 15)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes), c of the single column of ``texts``; the end of a text is the empty word."""
    found = texts.mapInArrow(_count, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """What every task holds of the counts: at most HELD words, and totals by class."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def __post_init__(self):
        own = min(OWN, len(self.words))
        self.classes = np.fromiter((i if i < own and w else ending(w) for i, w in enumerate(self.words)), np.int64, len(self.words))


def vocabulary(counts: DataFrame, held: int = HELD) -> Vocabulary:
    """The totals and the most frequent words of ``counts`` (a stored table).

    Words are taken by steps of their count, as many whole steps as fit, so that the number that
    reaches the driver is known before they are read.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        if total + n > held:
            break
        least, total = at, total + n
    # the end of a text is held in any case
    found = counts.where((step >= (least if least is not None else 1 << 20)) | (F.length("word") == 0)).toArrow()
    words, c = found["word"].to_pylist() or [b""], found["c"].to_numpy() if found.num_rows else np.zeros(1, np.int64)
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    words, c = [words[i] for i in order], c[order]
    own = [w for w in words[:OWN] if w]
    alone = counts.sparkSession.createDataFrame([(bytearray(w),) for w in own], "word binary")
    shared = counts.join(F.broadcast(alone), "word", "left_anti")
    of = F.when(F.length("word") == 0, END).otherwise(F.crc32(F.substring("word", -3, 3)) % ENDINGS + OWN)
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in shared.groupBy(of.cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens[r["k"]], distinct[r["k"]] = r["c"], r["v"]
    for i, w in enumerate(words[:OWN]):
        if w:
            tokens[i], distinct[i] = c[i], 1
    return Vocabulary(words, c, int(tokens.sum()), int(distinct.sum()), tokens, distinct)


# --- class sequences --------------------------------------------------------------------------

_CODED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("in_training", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("known", pa.int64()),
        ("base", pa.float64()),
        ("inner", pa.float64()),
        ("classes", pa.binary()),
        ("rare", pa.list_(pa.binary())),
        ("times", pa.list_(pa.int64())),
    ]
)


class _Places(dict):
    """Held word -> its place; other words -> the places after those, by ending."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.n = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.n + ending(word)


class Coder:
    """Texts to class sequences with what is known of their words' counts."""

    def __init__(self, v: Vocabulary):
        self.places, self.held = _Places(v.words), len(v.words)
        self.classes = np.concatenate([v.classes, np.arange(CLASSES)])
        self.known = np.concatenate([v.counts > 0, np.zeros(CLASSES, bool)])
        added = np.concatenate([np.log10(v.counts + ADDED), np.zeros(CLASSES)])
        self.base = added - np.log10(v.tokens + ADDED * (v.distinct + 1))
        # a word with a class of its own, and the end of a text, cost nothing beside their class
        alone = (self.classes < OWN) | (self.classes == END)
        within = np.log10(v.class_tokens + ADDED * (v.class_words + 1))
        self.inner = np.where(alone, 0.0, added - within[self.classes])

    def code(self, text: bytes) -> tuple[int, int, float, float, bytes, list[bytes], list[int]]:
        rare: Counter[bytes] = Counter()
        n = known = 0
        base = inner = 0.0
        out = []
        for words in [*words_of(text), [b""]]:
            at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
            base += float(self.base[at].sum())
            inner += float(self.inner[at].sum())
            out.append(self.classes[at].astype("<u2").tobytes())
            other = np.flatnonzero(at >= self.held)
            rare.update([words[i] for i in other.tolist()])
            n += len(words)
            known += int(self.known[at].sum())
        return n, known, base, inner, b"".join(out), list(rare), list(rare.values())


_CODERS: dict[str, Coder] = {}


def _encode(held, key: str):
    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = Coder(held.value)
        coder = _CODERS[key]

        def rows():
            for b in it:
                for row, doc_id, inside, text in zip(*(x.to_pylist() for x in b.columns[:3]), utf8(b[3]), strict=True):
                    yield row, doc_id, inside, *coder.code(text)

        return batches(rows(), _CODED, 128)

    return encode


def encode(texts: DataFrame, v: Vocabulary) -> DataFrame:
    """``texts`` (row, doc_id, in_training, text) as class sequences.

    row, doc_id, in_training, n_tokens, known, base, inner, classes, rare, times.  ``known``, ``base`` and
    ``inner`` leave out what depends on the counts of ``rare``, the words that are not held.
    """
    held = texts.sparkSession.sparkContext.broadcast(v)
    schema = "row long, doc_id long, in_training boolean, n_tokens long, known long, base double, inner double, classes binary, rare array<binary>, times array<long>"
    return texts.mapInArrow(_encode(held, uuid.uuid4().hex), schema)


# --- the recursions ---------------------------------------------------------------------------


@dataclass
class Chain:
    """Start (states), moves (states x states) and emissions (classes x states)."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


class Group:
    """Class sequences side by side, longest first: step t of all of them is one run of rows."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        steps = int(sizes[0])
        self.live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), "right")
        self.first = np.concatenate([[0], np.cumsum(self.live)])
        self.last = self.first[sizes - 1] + np.arange(len(sizes))
        self.classes = np.empty(int(sizes.sum()), np.int64)
        for j, k in enumerate(self.order.tolist()):
            self.classes[self.first[: sizes[j]] + j] = sequences[k]

    def forward(self, chain: Chain) -> np.ndarray:
        """Natural log likelihoods in the order of the sequences; keeps what ``backward`` needs."""
        first, live = self.first.tolist(), self.live.tolist()
        self.seen = chain.emits[self.classes]
        self.alpha = alpha = np.empty_like(self.seen)
        logs = np.zeros(len(self.order))
        self.scales = {}
        np.multiply(self.seen[: first[1]], chain.start, out=alpha[: first[1]])
        for t in range(1, len(live)):
            lo, n = first[t], live[t]
            now = alpha[lo : lo + n]
            np.matmul(alpha[first[t - 1] : first[t - 1] + n], chain.moves, out=now)
            now *= self.seen[lo : lo + n]
            if t % SCALED == 0:
                s = now.sum(1)
                now /= s[:, None]
                logs[:n] += np.log(s)
                self.scales[t] = s
        self.ends = alpha[self.last].sum(1)
        out = np.empty(len(logs))
        out[self.order] = logs + np.log(self.ends)
        return out

    def backward(self, chain: Chain, counts: np.ndarray, moves: np.ndarray, start: np.ndarray) -> None:
        """Adds the expected counts after ``forward``: of classes by state, of moves, of first states."""
        first, live = self.first.tolist(), self.live.tolist()
        alpha, back = self.alpha, np.ascontiguousarray(chain.moves.T)
        beta, pairs = np.zeros((0, chain.start.size)), np.zeros_like(moves)
        for t in range(len(live) - 1, -1, -1):
            lo, n = first[t], live[t]
            now = np.empty((n, chain.start.size))
            more = len(beta)
            now[more:] = (1 / self.ends[more:n])[:, None]
            if more:
                after = self.seen[lo + n : lo + n + more]
                after *= beta
                if t + 1 in self.scales:
                    after /= self.scales[t + 1][:, None]
                pairs += alpha[lo : lo + more].T @ after
                np.matmul(after, back, out=now[:more])
            alpha[lo : lo + n] *= now
            beta = now
        moves += pairs * chain.moves
        start += alpha[: live[0]].sum(0)
        for k in range(chain.start.size):
            counts[:, k] += np.bincount(self.classes, alpha[:, k], len(counts))


def _grouped(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of sequences of like lengths, GROUP tokens together or one longer sequence."""
    order = np.argsort([len(s) for s in sequences], kind="stable")
    own, size = [], 0
    for k in order.tolist():
        if own and size + len(sequences[k]) > GROUP:
            yield own
            own, size = [], 0
        own.append(k)
        size += len(sequences[k])
    if own:
        yield own


def _gathered(it: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Batches until GATHERED tokens are there, with their class sequences."""
    held, size = [], 0
    for b in it:
        held.append(b)
        size += b.column(column).nbytes // 2
        if size >= GATHERED:
            yield _sequences(held, column)
            held, size = [], 0
    if held:
        yield _sequences(held, column)


def _sequences(held: list[pa.RecordBatch], column: str) -> tuple[pa.Table, list[np.ndarray]]:
    rows = pa.Table.from_batches(held)
    return rows, [np.frombuffer(x, "<u2") for x in rows[column].to_pylist()]


# --- Baum-Welch -------------------------------------------------------------------------------


def _expected(held):
    def expected(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = held.value
        k = chain.start.size
        counts, moves, start, value = np.zeros((CLASSES, k)), np.zeros((k, k)), np.zeros(k), 0.0
        for _, found in _gathered(it, "classes"):
            for own in _grouped(found):
                group = Group([found[i] for i in own])
                value += float(group.forward(chain).sum())
                group.backward(chain, counts, moves, start)
        if value:
            at = np.flatnonzero(counts.any(1))
            slots = np.concatenate([at, CLASSES + np.arange(k + 2)]).astype(np.int32)
            values = np.concatenate([counts[at], moves, start[None], np.full((1, k), value)])
            yield pa.RecordBatch.from_arrays([pa.array(slots), *(pa.array(x) for x in values.T)], ["slot", *(f"v{i}" for i in range(k))])

    return expected


def baum_welch(coded: DataFrame, chain: Chain, shared: np.ndarray) -> tuple[Chain, float]:
    """One round over all of ``coded`` (classes): the new chain, and the log likelihood under the old one."""
    k = chain.start.size
    held = coded.sparkSession.sparkContext.broadcast(chain)
    names = [f"v{i}" for i in range(k)]
    added = coded.select("classes").mapInArrow(_expected(held), "slot int, " + ", ".join(f"{x} double" for x in names))
    found = added.groupBy("slot").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    sums = np.zeros((CLASSES + k + 2, k))
    sums[found["slot"].to_numpy()] = np.stack([found[x].to_numpy() for x in names], 1)
    counts, moves, start = sums[:CLASSES], sums[CLASSES : CLASSES + k] + 1 / k, sums[CLASSES + k] + 1 / k
    # every state is given some tokens that follow all texts, so that no class is impossible anywhere
    emits = counts + (PRIOR + SHARED * counts.sum(0)) * shared[:, None]
    held.unpersist()
    return Chain(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0)), float(sums[-1, 0])


def first_chain(shared: np.ndarray, states: int = STATES) -> Chain:
    """States that tell classes apart by chance and rarely move, so that whole texts differ before single words do."""
    chance = np.exp(np.random.default_rng(7).normal(0, 0.5, (CLASSES, states)))
    emits = shared[:, None] * chance
    moves = np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states)
    return Chain(np.full(states, 1 / states), moves, emits / emits.sum(0))


def train(coded: DataFrame, v: Vocabulary, states: int = STATES, start_texts: int = START_TEXTS) -> Chain:
    """Baum-Welch over ``coded`` (row, classes; from a stored table): START_ROUNDS on its parts in turn, ROUNDS on all.

    There are as many parts as hold ``start_texts`` texts or more, START_ROUNDS at most, so that all of them have their turn.
    """
    shared = (v.class_tokens + ADDED) / (v.tokens + ADDED * CLASSES)
    chain, n = first_chain(shared, states), coded.count()
    if not n:
        return chain
    parts = max(1, min(START_ROUNDS, n // start_texts))
    part = F.pmod(F.xxhash64("row"), F.lit(parts))
    for turn in range(START_ROUNDS):
        chain, _ = baum_welch(coded.where(part == turn % parts), chain, shared)
    for _ in range(ROUNDS):
        chain, _ = baum_welch(coded, chain, shared)
    return chain


# --- scores -----------------------------------------------------------------------------------


def _likelihoods(held):
    def likelihoods(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = held.value
        for rows, found in _gathered(it, "classes"):
            out = np.zeros(len(found))
            for own in _grouped(found):
                out[own] = Group([found[i] for i in own]).forward(chain)
            yield from rows.select(_NARROW).append_column("chain", pa.array(out / np.log(10))).combine_chunks().to_batches()

    return likelihoods


_NARROW = ["row", "doc_id", "in_training", "n_tokens", "known", "base", "inner"]


def likelihoods(coded: DataFrame, chain: Chain) -> DataFrame:
    """The narrow columns of ``coded`` and ``chain``: log10 likelihood of the class sequence."""
    held = coded.sparkSession.sparkContext.broadcast(chain)
    schema = "row long, doc_id long, in_training boolean, n_tokens long, known long, base double, inner double, chain double"
    return coded.select(*_NARROW, "classes").mapInArrow(_likelihoods(held), schema)


def score_texts(docs: DataFrame, training: Column, states: int = STATES, held: int = HELD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, in_training, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` is a condition on a row; where it is null the row is not learned from.  Scores are log10
    probabilities of the whole text and its end; ``score`` is the model's, ``base_score`` that of words drawn
    one by one.  Null, empty and blank texts are the end alone.  Repeated rows are scored, and learned from,
    each for itself.  Without a training text base_score is 0 and every token unknown.  Empty table: no
    rows.  Other columns of ``docs`` are not read, whatever their names.
    """
    short_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("in_training"), "text")
    counts = stored(word_counts(rows.where("in_training").select("text")), "hmm-words")
    v = vocabulary(counts, held)
    coded = stored(encode(rows.select(F.monotonically_increasing_id().alias("row"), *rows.columns), v), "hmm-coded")
    chain = train(coded.where("in_training").select("row", "classes"), v, states)
    rare = coded.select("row", F.inline(F.arrays_zip("rare", "times"))).join(counts, F.col("rare") == F.col("word"), "left")
    added = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + ADDED)
    rare = rare.groupBy("row").agg(F.sum(added).alias("added"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("seen"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return likelihoods(coded, chain).join(rare, "row", "left").select(
        "doc_id",
        "in_training",
        "n_tokens",
        (F.col("known") + zero("seen")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("added")).alias("base_score"),
        (F.col("chain") + F.col("inner") + zero("added")).alias("score"),
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32 of the id leaves a remainder of 10, scores them all."""
    out = F.coalesce(held_out(10, 0), F.lit(False))
    found = score_texts(table(spark, sf_dir, "documents"), ~out)
    return found.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op11_lm_scoring": op11_lm_scoring}
ORACLES: dict[str, str] = {}
