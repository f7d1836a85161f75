import random

from pyspark.sql import functions as F

from noticelake.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            kind = rng.randint(0, 2)
            if kind == 0:
                b.insert(k, rng.choice("abé"))
            elif b and k < len(b):
                b[k : k + 1] = [] if kind == 1 else [rng.choice("abé")]
        a, b = sorted((a, "".join(b)), key=len, reverse=True)
        pairs.append((a, b))
    for band in (1, 2, 3):
        near = [(a, b) for a, b in pairs if len(a) - len(b) <= band]
        df = spark.createDataFrame(near, "a string, b string")
        for r in df.select("a", "b", L.banded_distance(F.col("a"), F.col("b"), band).alias("d")).collect():
            d = distance(r.a, r.b)
            assert (r.d == d) if d <= band else r.d > band, (band, r)


def brute(docs, threshold, least):
    every = [(i, n, line) for i, t in docs for n, line in enumerate((t or "").split("\n"))]
    first = {}
    for i, n, line in sorted(every, key=lambda x: x[:2]):
        first.setdefault(line, (i, n))
    long = [x for x in first if len(x) >= least]
    early = {x: min(first[y] for y in long if abs(len(x) - len(y)) <= threshold and distance(x, y) <= threshold) for x in long}
    out = {}
    for i, n, line in every:
        own = out.setdefault(i, [0, []])
        own[0] += 1
        if line.strip(" \t\n\v\f\r") and early.get(line, first[line]) < (i, n):
            own[1].append(n)
    return {i: (n, sorted(r)) for i, (n, r) in out.items()}


def found(df):
    return {r.doc_id: (r.n_lines, list(r.removed)) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(8, 16))) for _ in range(25)]
    docs = []
    for i in range(40):
        own = []
        for _ in range(6):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice([[], [rng.choice("abcde")], [s[k], "x"]])
            own.append("".join(s))
        docs.append((i, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, base[0] + "\n" + base[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold, least in ((2, 8), (1, 8), (2, 10), (3, 12)):
        assert found(L.removals(df, threshold, least)) == brute(docs, threshold, least)


def test_split_keys_against_brute_force(spark):
    """Families that share most of a line, with each key split by what is left."""
    rng = random.Random(6)
    stems = ["the same words begin each of these lines", "and others end here, as they all do"]
    lines = set()
    for _ in range(260):
        middle = "".join(rng.choice("01") for _ in range(rng.randint(5, 7)))
        s = list(rng.choice([stems[0] + middle, middle + stems[1], stems[0][:20] + middle + stems[1][-17:], middle * 3]))
        if rng.random() < 0.3:
            s[rng.randrange(len(s))] = rng.choice(["", "x", "yz"])
        lines.add("".join(s)[:60])
    kept = sorted(x for x in lines if len(x) >= 8)
    df = spark.createDataFrame([(k, x, len(x)) for k, x in enumerate(kept)], "id long, line string, n int")
    for threshold in (1, 2, 3):
        want = {(a, b) for a in range(len(kept)) for b in range(len(kept)) if a != b and 0 <= len(kept[a]) - len(kept[b]) <= threshold}
        want = {(a, b) for a, b in want if distance(kept[a], kept[b]) <= threshold and (len(kept[a]) > len(kept[b]) or a < b)}
        for hot in (500, 2):
            assert {(r.a, r.b) for r in L.edit_links(df, threshold, hot).collect()} == want, (threshold, hot)
        assert len(want) > 50


def test_texts_and_empty_table(spark, odd, none):
    line = "a line of thirty characters or more, certainly"
    df = spark.createDataFrame([(1, f"{line}\nshort", 5), (2, f"x\n{line}!\nshort", 6)], "doc_id long, text string, removed int")
    got = {r.doc_id: (r.text, r.removed) for r in L.dedup_lines(df).collect()}
    assert got == {1: (f"{line}\nshort", 5), 2: ("x", 6)}
    assert found(L.removals(none)) == {}
    assert {r.doc_id: r.n_lines for r in L.removals(odd).collect()}[5] == 2


def test_equal_lines_of_every_length(spark, sf):
    import duckdb

    line = "a line of thirty characters or more, certainly"
    docs = [(1, f"{line}\nshort\n\n \nshort"), (2, f"x\n{line}!\nshort\nshorT\n\n "), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(L.removals(df, every=True)) == {1: (5, [4]), 2: (6, [1, 2]), 3: (1, [])}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(L.ORACLES["op10_line_dedup"]).fetchall()
    got = L.op10_line_dedup(spark, sf).select("doc_id", "n_lines", "n_removed", "removed").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r[2] for r in want) > sum(len(r.removed) for r in L.removals(spark.read.parquet(f"{sf}/documents.parquet"), every=False).collect())


def test_lines_without_segments_are_refused(none):
    import pytest

    with pytest.raises(ValueError):
        L.removals(none, min_chars=7)


def test_each_row_keeps_the_lines_that_are_its_own(spark):
    rows = [(5, "alpha\nbravo", "x"), (5, "bravo\ncharlie", "x"), (None, "alpha\ndelta", "y"), (None, None, None), (9, "delta\nalpha\n\necho", "z"), (9, "delta\nalpha\n\necho", "z"), (10, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string")
    found = sorted((tuple(r) for r in L.dedup_lines(docs).collect()), key=str)
    expected = [(5, "alpha", "x"), (5, "bravo\ncharlie", "x"), (None, "alpha\ndelta", "y"), (None, None, None), (9, "delta\n\necho", "z"), (9, "delta\n\necho", "z"), (10, None, "n")]
    assert found == sorted(expected, key=str)
