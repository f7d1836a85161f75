"""Truth tables of requirement trees."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from noticelake.functions import expressions as X
from noticelake.operators import aggregates as A

RECORDS = "array<map<string,string>>"


def verdict(spark, node, scalars=None, collections=None):
    df = spark.createDataFrame([(scalars or {}, collections or {})], f"scalars map<string,string>, collections map<string,{RECORDS}>")
    return df.select(X.compile_node(node).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "declared, op, value, want",
    [
        ("10,000,000", ">=", 10_000_000, True),
        ("5", ">=", 10, False),
        (None, ">=", 10, None),
        ("true", "==", True, True),
        ("true", ">=", 1, None),
        ("1", "==", True, None),
        ("gold", "==", "gold", True),
        ("gold", "!=", "silver", True),
        ("gold", ">=", "silver", None),
        ("gold", "<", 3, None),
        ("1e400x", ">", 3, None),
    ],
)
def test_scalar(spark, declared, op, value, want):
    scalars = {} if declared is None else {"k": declared}
    assert verdict(spark, {"kind": "scalar", "key": "k", "op": op, "value": value}, scalars) is want


@pytest.mark.parametrize(
    "records, want",
    [
        (None, None),
        ([], False),
        ([{"usd": "10"}, {"usd": "20"}], True),
        ([{"usd": "10"}], False),
        ([{"usd": "10"}, {"name": "x"}], None),
        ([{"usd": "1"}, {"usd": "2"}], False),
        ([{"usd": "10"}, {"usd": "20"}, {"name": "x"}], True),
    ],
)
def test_count(spark, records, want):
    node = {"kind": "count", "entity": "contracts", "op": ">=", "value": 2, "where": [{"field": "usd", "op": ">=", "value": 5}]}
    assert verdict(spark, node, collections={} if records is None else {"contracts": records}) is want


def test_a_met_upper_bound_stays_met(spark):
    node = {"kind": "count", "entity": "claims", "op": "<=", "value": 1, "where": [{"field": "lost", "op": "==", "value": True}]}
    assert verdict(spark, node, collections={"claims": [{"lost": "true"}, {"year": "2020"}]}) is True


def test_three_valued_logic(spark):
    leaf = {True: {"kind": "scalar", "key": "k", "op": "==", "value": 1}, False: {"kind": "scalar", "key": "k", "op": "==", "value": 2}, None: {"kind": "scalar", "key": "none", "op": "==", "value": 1}}
    rank = {False: 0, None: 1, True: 2}
    for a, b in itertools.product(leaf, leaf):
        both = {"kind": "all", "children": [leaf[a], leaf[b]]}
        either = {"kind": "any", "children": [leaf[a], leaf[b]]}
        assert verdict(spark, both, {"k": "1"}) is min((a, b), key=rank.get)
        assert verdict(spark, either, {"k": "1"}) is max((a, b), key=rank.get)
    for a in leaf:
        assert verdict(spark, {"kind": "not", "child": leaf[a]}, {"k": "1"}) is (None if a is None else not a)


def test_folds_over_rows(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, True), (4, None)], "k int, v boolean")
    got = {r.k: (r.a, r.o) for r in df.groupBy("k").agg(A.kleene_all(F.col("v")).alias("a"), A.kleene_any(F.col("v")).alias("o")).collect()}
    assert got == {1: (None, True), 2: (False, None), 3: (True, True), 4: (None, None)}


@pytest.mark.parametrize(
    "node",
    [{"kind": "sum"}, {"kind": "all", "children": []}, {"kind": "not"}, {"kind": "scalar", "key": "k", "op": "~", "value": 1}, {"kind": "scalar", "op": "==", "value": 1}, "x"],
)
def test_malformed_trees(spark, node):
    with pytest.raises(X.ExpressionError):
        X.parse(json.dumps(node))


def test_joint_venture_modes(spark):
    schema = f"bid int, lead boolean, scalars map<string,string>, collections map<string,{RECORDS}>"
    rows = [(1, True, {"t": "3", "name": "a"}, {"c": [{"y": "1"}]}), (1, False, {"t": "4"}, {"c": [{"y": "2"}]}), (2, True, {"t": "9"}, {}), (2, False, {}, {})]
    df = spark.createDataFrame(rows, schema)
    node = {"kind": "scalar", "key": "t", "op": ">=", "value": 4}
    got = {m: {r.bid: r.verdict for r in X.evaluate(df, "bid", "lead", node, m).collect()} for m in X.MODES}
    assert got == {"single": {1: False, 2: True}, "jv_combined": {1: True, 2: True}, "jv_each": {1: False, 2: None}, "jv_at_least_one": {1: True, 2: True}}
    at_once = X.evaluate_all(df.withColumn("n", F.when(F.col("lead"), 0).otherwise(1)), "bid", "n", node).collect()
    assert {m: {r.bid: r[m] for r in at_once} for m in X.MODES} == got
    joined = {r.bid: r for r in X.combine(df, "bid").collect()}
    assert set(joined[1].scalars) == {"t"} and len(joined[1].collections["c"]) == 2


def test_score_is_weighted(spark):
    rows = [("a", "high", True, True), ("a", "low", False, False), ("b", "high", None, True), ("b", "medium", True, False), ("c", "odd", False, True)]
    df = spark.createDataFrame(rows, "k string, i string, v boolean, m boolean")
    got = {r.k: r for r in A.readiness(df, ["k"], "v", "i", "m", {"high": 5, "medium": 3, "low": 1}).collect()}
    assert (got["a"].score, got["a"].ceiling, got["a"].blocked) == (0.833, 0.833, False)
    assert (got["b"].score, got["b"].ceiling) == (0.375, 1.0)
    assert got["c"].blocked is True


def test_words_and_missing_inputs():
    node = {"kind": "all", "children": [{"kind": "scalar", "key": "t", "op": ">=", "value": 12000000, "unit": "USD"}, {"kind": "count", "entity": "c", "op": ">=", "value": 2, "where": [{"field": "y", "op": ">=", "value": 2020}]}]}
    assert X.describe(node) == "(t >= 12 000 000 USD and count of c >= 2 where y >= 2020)"
    assert X.missing_inputs(node) == [("scalar", "t"), ("collection", "c"), ("field", "c.y")]
