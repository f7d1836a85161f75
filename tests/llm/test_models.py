import zlib

import numpy as np
import pytest

from noticelake.llm import langmix, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def languages(spark):
    return langmix.op4_language(spark, SF).collect()


def test_language_of_held_out_documents(spark, languages):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in languages)
    out = [r for r in languages if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in out]) >= 0.98
    assert all(0 <= r.score <= 1 for r in languages) and len(languages) == len(lang)


def test_mixtures_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langmix.train(docs.select("doc_id", "text", "lang"))
    own = {r.lang: r.text for r in docs.where("n_chars BETWEEN 1500 AND 2500").collect()}
    mixed = own["en"][:700] + " " + own["de"][:1400]
    rows = [(1, None), (2, ""), (3, "12 345 !? ½²"), (4, mixed), (5, own["fr"]), (6, "x" * 50_000), (4, mixed)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "1 as score")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langmix.identify(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "de" and 0.5 < got[4][1] < 0.8
    assert got[5][0] == "fr" and got[5][1] > 0.9
    kept = langmix.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 4, 5, 6]
    nothing = langmix.train(docs.select("doc_id", "text", "lang").limit(0))
    assert {r.lang_pred for r in langmix.identify(df, nothing).collect()} == {"und"}


def test_many_documents_at_once_equal_one_by_one():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 30, 40)
    likelihood = rng.normal(-20, 4, (sizes.sum(), 5))
    counts = rng.integers(1, 6, sizes.sum()).astype(float)
    every = langmix.infer(likelihood, counts, sizes)
    at = 0
    for k, n in enumerate(sizes):
        one = langmix.infer(likelihood[at : at + n], counts[at : at + n], np.array([n]))
        assert np.allclose(one[0], every[k], atol=1e-6)
        at += n
    assert np.allclose(every.sum(1), 1)


def test_em_finds_planted_proportions():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(60, 0.5), 4).T + 1e-6  # words x languages
    draw = 0.3 * p[:, 0] + 0.7 * p[:, 2]
    counts = rng.multinomial(4000, draw / draw.sum()).astype(float)
    share = langmix.infer(np.log(p), counts, np.array([60]))[0]
    assert abs(share[0] - 0.3) < 0.03 and abs(share[2] - 0.7) < 0.03 and share[1] == share[3] == 0


def test_quality_of_held_out_documents(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.op5_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.doc_id in label]
    good, bad = [r.score for r in out if label[r.doc_id]], [r.score for r in out if not label[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95


def test_quality_of_odd_texts(spark, odd, none):
    docs = spark.createDataFrame([(i, "good clean text here" if i % 2 else "*** !!! ***") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as label")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(v for k, v in got.items() if k % 2) > 0.7 > 0.3 > max(v for k, v in got.items() if not k % 2)
    assert quality.score(odd, model).count() == 10 and quality.score(none, model).count() == 0
    blank = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, blank).collect()} == {0.5}


def loops(p, counts, penalty=langmix.PENALTY):
    """The mixture of one document in plain loops: words x languages of likelihoods, and how often each word stands there."""
    languages, total = range(len(p[0])), sum(counts)
    value_of = lambda share: sum(n * np.log(sum(a * b for a, b in zip(row, share, strict=True))) for row, n in zip(p, counts, strict=True))
    single = [value_of([float(i == k) for i in languages]) for k in languages]
    best = max(languages, key=lambda k: single[k])
    share, value, cost, refused = [float(i == best) for i in languages], single[best], penalty * np.log(total + 1), set()
    while True:
        slope = {}
        for k in languages:
            if share[k] == 0 and k not in refused:
                slope[k] = sum(n * row[k] / sum(a * b for a, b in zip(row, share, strict=True)) for row, n in zip(p, counts, strict=True)) - total
        steep = max(slope, key=slope.get, default=None)
        if steep is None or slope[steep] <= cost:
            return share
        m = sum(x > 0 for x in share)
        tried = [x * m / (m + 1) for x in share]
        tried[steep] = 1 / (m + 1)
        for turn in range(langmix.ROUNDS + 1):
            gained = value_of(tried)
            if turn == langmix.ROUNDS:
                break
            new = [0.0] * len(tried)
            for row, n in zip(p, counts, strict=True):
                mixed = sum(a * b for a, b in zip(row, tried, strict=True))
                for k in languages:
                    new[k] += n * row[k] * tried[k] / mixed / total
            moved = max(abs(a - b) for a, b in zip(new, tried, strict=True))
            tried = new
            if moved < langmix.SETTLED:
                break
        if gained - value > cost:
            share, value = tried, gained
        else:
            refused.add(steep)


def test_mixtures_against_plain_loops(spark):
    """op4 once more as loops: training counts, likelihoods of words, the mixture, its main language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in docs.where("n_chars < 700").orderBy("doc_id").limit(60).collect()]
    mixed = [(10_000 + i, f"{a.text} {b.text}", None) for i, (a, b) in enumerate(zip(rows[:12], rows[12:24], strict=True))]
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows] + mixed, "doc_id long, text string, lang string")
    langs, table = langmix.train(df)
    counts = {x: {} for x in langs}
    for r in rows:
        for w in langmix.words_of(r.text):
            for b in langmix.trigrams([w])[0].tolist():
                counts[r.lang][b] = counts[r.lang].get(b, 0) + 1
    every, size = {}, sum(sum(c.values()) for c in counts.values())
    for c in counts.values():
        for b, n in c.items():
            every[b] = every.get(b, 0) + n
    spread = {x: {b: c.get(b, 0) + langmix.SMOOTHING * (1e-3 + n / size) for b, n in every.items()} for x, c in counts.items()}
    unseen = langmix.SMOOTHING * 1e-3
    sums = {x: sum(s.values()) + unseen * (langmix.BUCKETS - len(every)) for x, s in spread.items()}
    word = lambda w: [sum(np.log(spread[x].get(b, unseen) / sums[x]) for b in langmix.trigrams([w])[0].tolist()) for x in langs]
    found = {r.doc_id: (r.lang_pred, r.score) for r in langmix.identify(df, (langs, table)).collect()}
    several = 0
    for i, text, _ in [(r.doc_id, r.text, r.lang) for r in rows] + mixed:
        held = {}
        for w in langmix.words_of(text):
            held[w] = held.get(w, 0) + 1
        if not held:
            assert found[i] == ("und", 0.0)
            continue
        logs = np.array([word(w) for w in held])
        share = loops(np.exp(logs - logs.max(1, keepdims=True)).tolist(), list(held.values()))
        # a word's best likelihood is a constant of the document, so the choice is the same without it
        k = max(range(len(langs)), key=lambda x: share[x])
        several += sum(x > 0 for x in share) > 1
        assert found[i][0] == langs[k] and abs(found[i][1] - share[k]) < 5e-3, (i, found[i], share)
    assert several >= 3


def test_quality_against_plain_loops():
    """op5 once more as loops over one feature at a time: the fit and the scores."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["good", "clean", "text", "spam", "***", "!!!", "é"], rng.integers(0, 9))) for _ in range(24)]
    labels = [int("spam" not in t) for t in texts]
    vectors, layer = quality.fit(texts, labels)
    draw = np.random.default_rng(quality.SEED)
    width = quality.WIDTH
    start = draw.uniform(-1 / width, 1 / width, (quality.BUCKETS, width)).astype(np.float32)
    v, z = {}, [[0.0] * (width + 1), [0.0] * (width + 1)]

    def features(text):
        words = text.split()
        own = {}
        for w in words:
            for b in quality.word_features([w])[0].tolist():
                own[b] = own.get(b, 0) + 1
        for a, b in zip(words, words[1:], strict=False):
            (bucket,) = quality.pair_features(quality._hashes([a, b])).tolist()
            own[bucket] = own.get(bucket, 0) + 1
        n = sum(own.values())
        return {b: c / n for b, c in own.items()}

    held, done = [features(t) for t in texts], 0
    for _ in range(quality.EPOCHS):
        for i in draw.permutation(len(texts)).tolist():
            rate = quality.RATE * (1 - done / (quality.EPOCHS * len(texts)))
            done += 1
            x = [sum(w * v.setdefault(b, start[b].astype(float).tolist())[k] for b, w in held[i].items()) for k in range(width)] + [1.0]
            e = [np.exp(sum(a * b for a, b in zip(row, x, strict=True))) for row in z]
            error = [y / sum(e) - (k == labels[i]) for k, y in enumerate(e)]
            back = [error[0] * z[0][k] + error[1] * z[1][k] for k in range(width)]
            for c in range(2):
                z[c] = [a - rate * error[c] * b for a, b in zip(z[c], x, strict=True)]
            for b, w in held[i].items():
                step = rate * len(held[i]) ** 0.5 * w
                v[b] = [a - step * g for a, g in zip(v[b], back, strict=True)]
    got = list(quality.Scorer(vectors, layer).scores(texts))
    for t, own, score in zip(texts, held, got, strict=True):
        x = [sum(w * v[b][k] for b, w in own.items()) for k in range(width)] + [1.0]
        want = 1 / (1 + np.exp(-sum((a - b) * c for a, b, c in zip(z[1], z[0], x, strict=True))))
        assert abs(score - want) < 2e-3, (t, score, want)


def test_an_id_that_repeats_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"word{i}") for i in range(50)] + [(2, "good"), (3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (None, 1)], "doc_id long, label int")
    once = spark.createDataFrame([(1, "word0"), (2, "good"), (3, None)], "doc_id long, text string")
    a, b = quality.train(docs, labels), quality.train(once, labels)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
