import hashlib
import random
import re

from noticelake.llm import substrings as S


def brute(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_whole_table(spark, sf, documents):
    assert found(S.op1_substring_dedup(spark, sf)) == brute(documents)


def planted(seed):
    rng = random.Random(seed)
    letters = [chr(97 + i) for i in range(6)]
    base = [[rng.choice(letters) for _ in range(rng.randint(10, 60))] for _ in range(8)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            text += b[a : a + rng.randint(5, 40)] + [rng.choice(letters) for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(text)))
    return rows


def test_overlapping_passages_of_few_words(spark):
    rows = planted(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(S.remove_repeats(df)) == brute(rows)


def test_windows_of_hot_anchors_go_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    rows = planted(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(S.remove_repeats(df)) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    long = " ".join(f"w{i}" for i in range(30))
    more = rows + [(20, long), (20, long), (21, long.replace(" ", "\n\t")), (-5, long)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    assert found(S.remove_repeats(df)) == brute(more)
    kept = {r.doc_id: r.kept for r in S.remove_repeats(df).collect()}
    assert kept[20] == "" and kept[-5] == long
    assert found(S.remove_repeats(none)) == []


def longest(text, end, references):
    """Length of the longest match that ends at word ``end``, and the references that have it."""
    for n in range(end + 1, 0, -1):
        part = text[end + 1 - n : end + 1]
        if any(part == t[k : k + n] for t in references for k in range(len(t) - n + 1)):
            return n
    return 0


def test_matching_statistics_of_sequences_that_were_not_added():
    rng = random.Random(9)
    draw = lambda letters: [rng.choice(letters) for _ in range(rng.randint(1, 25))]
    references, foreign = [draw("ab") for _ in range(12)], [draw("abc") for _ in range(20)]
    a = S.Automaton()
    for owner, s in enumerate(references):
        a.add(s, owner)
    for s in references + foreign:
        for width in (1, 3, 6):
            found = a.statistics(s, width)
            want = [longest(s, k, references) for k in range(len(s))]
            assert [min(n, width) for n, _ in found] == [min(n, width) for n in want]
            for k, (_, first) in enumerate(found):
                part = s[k + 1 - width : k + 1]
                owners = [o for o, t in enumerate(references) if any(t[i : i + width] == part for i in range(len(t) - width + 1))]
                assert first == (min(owners) if want[k] >= width else None)


def test_firsts_of_segments_as_they_come():
    rng = random.Random(4)
    segments = sorted((rng.randint(0, 9), [rng.choice("ab") for _ in range(rng.randint(3, 9))]) for _ in range(40))
    for (_, s), runs in zip(segments, S.firsts(segments, 3), strict=True):
        got = [first for a, b, first in runs for _ in range(a, b)]
        assert got == [min(o for o, t in segments if any(t[k : k + 3] == s[i : i + 3] for k in range(len(t) - 2))) for i in range(len(s) - 2)]
        assert all(x[2] != y[2] for x, y in zip(runs, runs[1:], strict=False))


def test_word_hashes_follow_the_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "BYTES", 64)
    rng = random.Random(3)
    texts = [None, "", " ", "a", " a\tb ", "x" * 9000 + " " + "x" * 4095 + "y" + "x" * 4904, "é à é", *(" \n ".join(rng.choice(["ab", "ba", "a b", "", "c" * 70]) for _ in range(40)) for _ in range(20))]
    hashes, sizes = S.word_hashes(pa.array(texts)[1:])
    words = [(t or "").encode().split() for t in texts[1:]]
    assert sizes.tolist() == [len(w) for w in words]
    flat = [w for x in words for w in x]
    assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist(), strict=True)))
