import re
from itertools import combinations

from noticelake.llm import contamination as C


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        d, found = words(text), set()
        for item_id, item in items:
            b = words(item)
            n = len(b)
            if n < 8:
                continue
            w, k = min(n, 13), 2 if n >= 13 else 1 if n >= 10 else 0
            for g in range(-n, len(d)):
                eq = [0 <= i + g < len(d) and d[i + g] == x for i, x in enumerate(b)]
                if any(sum(eq[s : s + w]) >= w - k for s in range(n - w + 1)):
                    found.add(item_id)
                    break
        out[doc_id] = (bool(found), len(found), min(found) if found else None)
    return out


def test_mask_finds_every_overlap():
    for n, k in ((13, 2), (12, 1), (11, 1), (10, 1), (9, 0), (8, 0)):
        places = [{o + p for p in m} for m in C.MASKS for o in range(n - max(m))]
        assert all(any(not p & set(c) for p in places) for c in combinations(range(n), k))


def test_against_brute_force(spark, documents):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "a b c d e f g h i j"), (3, "p q r s t u v w"), (4, "x y z"), (5, None), (6, "")]
    base = items[0][1].split()
    docs = [(100, " ".join(base)), (101, " ".join("zz" if i in (2, 9) else w for i, w in enumerate(base))), (102, " ".join("zz" if i in (1, 5, 9, 12) else w for i, w in enumerate(base)))]
    docs += [(103, "Tail: two, THREE four-five six seven eight nine ten eleven twelve thirteen fourteen!"), (104, "a b c d E f zz h i j"), (105, "a b zz d e f zz h i j"), (106, "p q r s t u v w"), (107, "p q r s t u v"), (108, None), (109, ""), (110, "one " * 50)]
    docs += documents[:60]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_items, r.first_item) for r in C.decontaminate(df, bench).collect()}
    assert got == brute(docs, items)
    assert got[101][0] and not got[102][0] and got[103][0] and got[104][0] and not got[105][0]


def test_empty_sides_and_repeats(spark, odd, none):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    assert C.decontaminate(none, bench).collect() == []
    got = C.decontaminate(odd, bench.limit(0)).collect()
    assert len(got) == 10 and not any(r.contaminated for r in got)


def test_short_items_where_they_are_asked_for(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "One two"), (3, "a b c d e f g"), (4, "")], "item_id long, text string")
    rows = [(1, "x alpha Beta, gamma y"), (2, "alpha gamma beta one"), (3, "so one two"), (4, "z a b c d e f g"), (5, None), (6, "a b c d x f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda **k: {r.doc_id: r.first_item for r in C.decontaminate(docs, bench, **k).collect() if r.contaminated}
    assert found() == {} and found(least=3) == {1: 1, 4: 3} and found(least=2) == {1: 1, 3: 2, 4: 3}
