"""The hidden Markov model against plain recursions, brute force over paths, and held-out likelihood."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import hmm, queries


@pytest.fixture()
def few_rounds(monkeypatch):
    """The rounds change no count and no base score."""
    monkeypatch.setattr(hmm, "START_ROUNDS", 1)
    monkeypatch.setattr(hmm, "ROUNDS", 1)


def _chain(states: int, seed: int) -> hmm.Chain:
    r = np.random.default_rng(seed)
    emits = r.random((hmm.CLASSES, states))
    moves, start = r.random((states, states)), r.random(states)
    return hmm.Chain(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def _paths(chain: hmm.Chain, seen):
    """Every path of states with its probability."""
    for path in itertools.product(range(len(chain.start)), repeat=len(seen)):
        p = chain.start[path[0]] * chain.emits[seen[0], path[0]]
        for t in range(1, len(seen)):
            p *= chain.moves[path[t - 1], path[t]] * chain.emits[seen[t], path[t]]
        yield path, p


def test_recursions_equal_sums_over_all_paths():
    chain = _chain(3, 1)
    sequences = [np.array(x) for x in ([4, 9, 4, 7], [2], [9, 9], [1, 2, 3, 4, 5], [7, 7, 7])]
    group = hmm.Group(sequences)
    found = group.forward(chain)
    counts, moves, start = np.zeros((hmm.CLASSES, 3)), np.zeros((3, 3)), np.zeros(3)
    group.backward(chain, counts, moves, start)
    c2, m2, s2 = np.zeros_like(counts), np.zeros_like(moves), np.zeros_like(start)
    for k, seen in enumerate(sequences):
        total = sum(p for _, p in _paths(chain, seen))
        assert math.isclose(found[k], math.log(total), rel_tol=1e-12)
        for path, p in _paths(chain, seen):
            s2[path[0]] += p / total
            for t, x in enumerate(seen):
                c2[x, path[t]] += p / total
                if t:
                    m2[path[t - 1], path[t]] += p / total
    assert np.allclose(counts, c2) and np.allclose(moves, m2) and np.allclose(start, s2)


def test_long_sequences_are_scaled():
    chain, r = _chain(4, 2), np.random.default_rng(3)
    sequences = [r.integers(0, hmm.CLASSES, n) for n in (1, 5_000, 12, 13, 4_999, 200)]
    found = hmm.Group(sequences).forward(chain)
    for k, seen in enumerate(sequences):
        a, log = chain.start * chain.emits[seen[0]], 0.0
        for x in seen[1:]:
            log, a = log + math.log(a.sum()), a / a.sum()
            a = (a @ chain.moves) * chain.emits[x]
        assert math.isclose(found[k], log + math.log(a.sum()), rel_tol=1e-11)


def test_words_and_endings(spark):
    text = ("Ab\tÀB\x0bc\x1cd  E\r\n" * 300_000).encode()
    assert [w for ws in hmm.words_of(text) for w in ws] == [w for w in re.split(rb"[\x20\x09-\x0D]+", text.lower()) if w]
    words = [b"a", b"ab", b"abc", b"abcd", "été".encode(), b"\xff\xfe"]
    rows = spark.createDataFrame([(bytearray(w),) for w in words], "w binary")
    found = rows.select(F.crc32(F.substring("w", -3, 3)).alias("c")).collect()
    assert [r["c"] % hmm.ENDINGS + hmm.OWN for r in found] == [hmm.ending(w) for w in words]


def _plain_base(docs, inside):
    tokens = {k: [w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [""] for k, t in docs}
    c = Counter(w for k, t in docs if inside(k) for w in tokens[k])
    n, v = sum(c.values()), len(c)
    return {k: (len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) for k, x in tokens.items()}


@pytest.mark.parametrize("held", [hmm.HELD, 300])
def test_base_scores_and_gain_on_held_out_texts(spark, sf, documents, held, monkeypatch):
    if held < hmm.HELD:
        monkeypatch.setattr(hmm, "START_ROUNDS", 1)
        monkeypatch.setattr(hmm, "ROUNDS", 1)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inside = lambda k: zlib.crc32(str(k).encode()) % 10 != 0
    rows = hmm.score_texts(docs, ~hmm.held_out(10, 0), held=held).collect()
    expected = _plain_base(documents, inside)
    assert len(rows) == len(documents)
    for r in rows:
        n, known, total, base = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["in_training"]) == (n, known, total, inside(r["doc_id"]))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    if held < hmm.HELD:
        return  # one round only
    out = [r for r in rows if not r["in_training"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_the_number_of_held_words_changes_no_score_but_by_classes(spark, few_rounds):
    docs = spark.createDataFrame([(i, f"one two {'three' if i % 2 else 'four'} w{i % 7}") for i in range(40)], "doc_id long, text string")
    a = {r["doc_id"]: r["base_score"] for r in hmm.score_texts(docs, F.lit(True), held=1).collect()}
    b = {r["doc_id"]: r["base_score"] for r in hmm.score_texts(docs, F.lit(True)).collect()}
    assert all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)


def test_the_model_is_a_distribution(spark):
    """Over texts of one word: known words, and one unseen word for every class of endings, sum to the chance of one word and the end."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a a b", "b c", "c", "", "a d e"])], "doc_id long, text string")
    counts = Counter("a a b b c c a d e".split()) | {"": 5}
    ct, cv = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    words = sorted(counts, key=lambda w: (-counts[w], w))
    own = {w: i for i, w in enumerate(words) if w and i < 3}
    for w in words:
        k = own.get(w, hmm.ending(w.encode()))
        ct[k] += counts[w]
        cv[k] += 1
    v = hmm.vocabulary(hmm.stored(hmm.word_counts(docs.select("text")), "w"))
    assert v.tokens == sum(counts.values()) and v.distinct == len(counts)
    coder, chain = hmm.Coder(v), _chain(2, 5)
    total = 0.0
    for w in [x for x in counts if x]:
        _, _, _, inner, classes, rare, _ = coder.code(w.encode())
        seen = np.frombuffer(classes, "<u2")
        assert not rare
        total += 10**inner * math.exp(hmm.Group([seen]).forward(chain)[0])
    for k in range(hmm.OWN, hmm.END):  # what each class keeps for unseen words
        left = 0.1 / (v.class_tokens[k] + 0.1 * (v.class_words[k] + 1))
        total += left * math.exp(hmm.Group([np.array([k, hmm.END])]).forward(chain)[0])
    used = [i for i in range(hmm.OWN) if v.class_words[i]] + list(range(hmm.OWN, hmm.END))
    chance = sum(math.exp(hmm.Group([np.array([k, hmm.END])]).forward(chain)[0]) for k in used)
    assert math.isclose(total, chance, rel_tol=1e-9)


def test_odd_rows(spark, odd, none, few_rounds):
    assert hmm.score_texts(none, F.lit(True)).count() == 0
    rows = hmm.score_texts(odd, F.col("doc_id") != 7).orderBy("doc_id").collect()
    assert len(rows) == odd.count()
    assert all(r["n_tokens"] == 1 and r["n_known"] == 1 for r in rows[:3])
    assert rows[4]["score"] == pytest.approx(rows[5]["score"]) and all(math.isfinite(r["score"]) for r in rows)
    unlearned = hmm.score_texts(odd, F.lit(None).cast("boolean")).collect()
    assert all(r["base_score"] == pytest.approx(0) and r["n_known"] == 0 and r["train_tokens"] == 0 and not r["in_training"] for r in unlearned)
    clash = odd.select("doc_id", "text", F.lit(1).alias("row"), F.lit("x").alias("classes"), F.lit(2).alias("in_training"), F.lit(3).alias("rare"))
    assert hmm.score_texts(clash, F.lit(True)).count() == odd.count()
    nulls = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert hmm.score_texts(nulls, hmm.held_out(10, 0)).count() == 2


def test_query(spark, sf, few_rounds):
    found = queries()["op11_lm_scoring"](spark, sf)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert dict(found.dtypes)["n_known"] == dict(found.dtypes)["train_tokens"] == "bigint"


def test_every_training_text_is_in_the_start(spark, monkeypatch):
    rows = [(i, bytearray(np.full(3, i, "<u2").tobytes())) for i in range(100)]
    coded = spark.createDataFrame(rows, "row long, classes binary")
    v = hmm.Vocabulary([b""], np.array([1]), 1, 1, np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES))
    seen = []
    monkeypatch.setattr(hmm, "ROUNDS", 0)
    monkeypatch.setattr(hmm, "baum_welch", lambda data, chain, shared: (seen.append({r["row"] for r in data.select("row").collect()}), (chain, 0.0))[1])
    hmm.train(coded, v, start_texts=10)
    assert len(seen) == hmm.START_ROUNDS and set().union(*seen) == set(range(100)) and max(map(len, seen)) < 100
