"""Plans that spread hot keys, blocks of long query lists, and what is left when the training-data folder is gone."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noticelake import session
from noticelake.operators import ordering as O
from noticelake.operators import vectors as V
from noticelake.queries.rollups import listing

REPO = Path(__file__).parents[2]


def test_running_sums_of_hot_and_null_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, id long, n int").repartition(7)
    got = {(r.source, r.id): (r.total, r.place) for r in O.running(O.running(df, ["source"], ["id"], F.col("n"), "total"), ["source"], ["id"], F.lit(1), "place").collect()}
    sums, want = {}, {}
    for source, i, n in sorted(rows, key=lambda r: r[1]):
        total, place = sums.get(source, (0, 0))
        sums[source] = want[source, i] = (total + n, place + 1)
    assert got == want
    assert O.running(df.limit(0), ["source"], ["id"], F.col("n"), "total").collect() == []


def test_long_query_lists_meet_in_blocks(spark, monkeypatch):
    points = spark.createDataFrame([(i, i % 3, [1.0, float(i)]) for i in range(20)], "vec_id long, label int, embedding array<float>")
    queries = spark.createDataFrame([(i, i % 3, [1.0, 0.5]) for i in range(9)], "qid long, label int, qvec array<float>")
    every, same = sorted(map(tuple, V.top_k(queries.drop("label"), points, 4).collect())), sorted(map(tuple, V.top_k(queries, points, 4, same=["label"]).collect()))
    assert len(every) == 36
    monkeypatch.setattr(V, "QUERIES_HELD", 2)
    blocked = V.top_k(queries.drop("label"), points, 4)
    assert "Cartesian" not in blocked._jdf.queryExecution().toString() and "NestedLoop" not in blocked._jdf.queryExecution().toString()
    assert sorted(map(tuple, blocked.collect())) == every
    assert sorted(map(tuple, V.top_k(queries, points, 4, same=["label"]).collect())) == same


def test_a_join_that_no_order_needs_is_not_planned(spark):
    orders = spark.createDataFrame([(1, 1), (2, 5)], "o_orderkey long, o_custkey long")
    customers = spark.createDataFrame([(1, 3.0)], "c_custkey long, c_acctbal double")
    assert "Join" not in listing(orders, customers, "key")._jdf.queryExecution().toString()
    assert [r.o_orderkey for r in listing(orders, customers, "balance").collect()] == [1, 2]


def test_the_shared_folder_names_its_file_system(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_FOLDERS", {})
    before = spark.conf.get("spark.checkpoint.dir")
    try:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path))
    except Exception:  # a setting of the context can't be changed in a running session
        assert session.shared_dir(spark).startswith("file:/") and before.startswith("file:")
    else:
        assert session.shared_dir(spark).startswith("file:/")
        spark.conf.set("spark.checkpoint.dir", before)


@pytest.mark.parametrize("broken", [False, True])
def test_entry_without_the_training_data_folder(tmp_path, broken):
    """Without it the other queries stand; with a fault inside it, the fault is seen."""
    (tmp_path / "noticelake").mkdir()
    for p in (REPO / "noticelake").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "noticelake" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(REPO / "__spark_entry__.py")
    if broken:
        (tmp_path / "noticelake" / "llm").mkdir()
        (tmp_path / "noticelake" / "llm" / "__init__.py").write_text("import a_module_that_is_not_there\n")
        (tmp_path / "corpus_pipeline.py").write_text("from noticelake import llm\n")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    found = subprocess.run([sys.executable, "-B", "-c", code], capture_output=True, text=True, cwd=tmp_path)
    if broken:
        assert found.returncode and "a_module_that_is_not_there" in found.stderr
    else:
        n, some = found.stdout.split()[-2:]
        assert int(n) > 150 and some == "False", found.stderr
