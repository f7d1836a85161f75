"""Requirement trees compiled to Columns: true, false, and null for unknown.

A tree is a dict: ``scalar`` (key, op, value), ``count`` (entity, op, value, where), ``exists``
(entity, where), ``all`` and ``any`` (children), ``not`` (child).  SQL's AND, OR and NOT are the
three-valued ones, so inner nodes compile to them.

The profile has two columns: ``scalars`` map<string,string>, and ``collections``
map<string,array<map<string,string>>>, where an entity that is absent differs from an empty one.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
MODES = ("single", "jv_combined", "jv_each", "jv_at_least_one")


class ExpressionError(ValueError):
    """A tree that can't be compiled."""


def number(value: Column) -> Column:
    """A declared string as a number: thousands separators dropped, null if it is none."""
    return F.trim(F.replace(value, F.lit(","), F.lit(""))).try_cast("decimal(38,10)")


def compare(op: str, left: Column, right) -> Column:
    """Declared value against a required one: numbers if both are, else equality of like kinds."""
    if op not in OPERATORS:
        raise ExpressionError(f"unknown comparator {op!r}")
    if right is None:
        return F.lit(None).cast("boolean")
    test = OPERATORS[op]
    is_bool = F.lower(left).isin("true", "false")
    if isinstance(right, bool):
        return F.when(is_bool, test(F.lower(left) == "true", F.lit(right))) if op in ("==", "!=") else F.lit(None).cast("boolean")
    wanted = str(right).replace(",", "").strip()
    try:
        float(wanted)
        numeric = True
    except ValueError:
        numeric = False
    same = F.when(~is_bool, test(left, F.lit(str(right)))) if op in ("==", "!=") else F.lit(None).cast("boolean")
    if not numeric:
        return same
    n = number(left)
    return F.when(n.isNotNull(), test(n, F.lit(wanted).cast("decimal(38,10)"))).otherwise(same)


def _every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compile_node(node: dict, scalars: str = "scalars", collections: str = "collections") -> Column:
    """A Column over the profile columns; raises ExpressionError for a malformed tree."""
    if not isinstance(node, dict):
        raise ExpressionError("expected an object")
    kind = node.get("kind")
    below = lambda x: compile_node(x, scalars, collections)
    if kind == "scalar":
        if not node.get("key"):
            raise ExpressionError("scalar needs a key")
        return compare(node.get("op", ""), F.col(scalars)[node["key"]], node.get("value"))
    if kind in ("count", "exists"):
        if not node.get("entity"):
            raise ExpressionError(f"{kind} needs an entity")
        op, n = (node.get("op", ""), int(node.get("value", 1))) if kind == "count" else (">=", 1)
        if op not in OPERATORS:
            raise ExpressionError(f"unknown comparator {op!r}")
        where = node.get("where") or []
        records = F.col(collections)[node["entity"]]
        # each record once: true, false, or null where a field is missing
        verdicts = F.transform(records, lambda r: _every([compare(w["op"], r[w["field"]], w.get("value")) for w in where]))
        return F.when(
            F.map_contains_key(F.col(collections), node["entity"]),
            F.get(F.transform(F.array(verdicts), lambda v: _counted(op, n, v)), F.lit(0)),
        )
    if kind == "not":
        if node.get("child") is None:
            raise ExpressionError("'not' needs a child")
        return ~below(node["child"])
    if kind in ("all", "any"):
        children = node.get("children") or []
        if not children:
            raise ExpressionError(f"{kind!r} needs at least one child")
        parts = [below(c) for c in children]
        return reduce((lambda a, b: a & b) if kind == "all" else (lambda a, b: a | b), parts)
    raise ExpressionError(f"unknown node kind {kind!r}")


def _counted(op: str, n: int, verdicts: Column) -> Column:
    """A count that falls short is unknown while some records lack data; a met one stands."""
    met = OPERATORS[op](F.size(F.filter(verdicts, lambda v: v)), F.lit(n))
    return F.when(met, True).when(F.exists(verdicts, lambda v: v.isNull()), None).otherwise(F.lit(False))


def parse(text: str) -> dict:
    """A stored tree; compiled once to check it."""
    try:
        node = json.loads(text)
    except ValueError as e:
        raise ExpressionError(str(e)) from e
    compile_node(node)
    return node


def describe(node: dict) -> str:
    """A tree in words."""

    def value(v) -> str:
        if isinstance(v, bool):
            return "yes" if v else "no"
        if isinstance(v, int | float) and abs(v) >= 10_000:
            return f"{v:,.0f}".replace(",", " ")
        return str(v)

    kind = node["kind"]
    if kind == "scalar":
        return f"{node.get('label') or node['key']} {node['op']} {value(node['value'])}" + (f" {node['unit']}" if node.get("unit") else "")
    if kind in ("count", "exists"):
        head = f"count of {node['entity']} {node['op']} {value(node.get('value', 1))}" if kind == "count" else f"some {node['entity']}"
        tests = " and ".join(f"{w['field']} {w['op']} {value(w['value'])}" for w in node.get("where") or [])
        return head + (f" where {tests}" if tests else "")
    if kind == "not":
        return f"not ({describe(node['child'])})"
    return "(" + (" and " if kind == "all" else " or ").join(describe(c) for c in node["children"]) + ")"


def missing_inputs(node: dict) -> list[tuple[str, str]]:
    """What could settle an unknown: (scalar|collection|field, name), in order of appearance."""
    kind, found = node["kind"], []
    if kind == "scalar":
        found = [("scalar", node["key"])]
    elif kind in ("count", "exists"):
        found = [("collection", node["entity"])] + [("field", f"{node['entity']}.{w['field']}") for w in node.get("where") or []]
    else:
        for child in node.get("children") or [node["child"]]:
            found += missing_inputs(child)
    return list(dict.fromkeys(found))


def explain(node: dict, scalars: str = "scalars", collections: str = "collections") -> Column:
    """array<string>: a line for each node of the tree with its verdict, indented by depth."""

    def lines(n: dict, depth: int) -> list[Column]:
        verdict = compile_node(n, scalars, collections)
        word = F.when(verdict, "SATISFIED").when(~verdict, "FAILED").otherwise("UNKNOWN")
        below = [n["child"]] if n["kind"] == "not" else n.get("children", [])
        text = {"all": "all of", "any": "any of", "not": "not"}.get(n["kind"]) or describe(n)
        return [F.concat(F.lit("  " * depth + "["), word, F.lit(f"] {text}")), *[x for c in below for x in lines(c, depth + 1)]]

    return F.array(*lines(node, 0))


def absent(node: dict, scalars: str = "scalars", collections: str = "collections") -> Column:
    """array<string>: the inputs of a tree that a profile lacks, in order of appearance: key, entity, or entity.field.

    A field counts where some record of its entity lacks it.
    """
    missing = []
    for kind, name in missing_inputs(node):
        if kind == "scalar":
            test = F.col(scalars)[name].isNull()
        elif kind == "collection":
            test = ~F.map_contains_key(F.col(collections), name)
        else:
            entity, field = name.split(".", 1)
            values = F.transform(F.col(collections)[entity], lambda r: r[field])  # noqa: B023
            test = F.coalesce(F.exists(values, lambda v: v.isNull()), F.lit(False))
        missing.append(F.when(test, F.lit(name)))
    return F.filter(F.array(*missing), lambda x: x.isNotNull())


def used(node: dict) -> tuple[set[str], set[str]]:
    """Scalars and entities that a tree names."""
    names = missing_inputs(node)
    return {n for k, n in names if k == "scalar"}, {n for k, n in names if k == "collection"}


def combine(members: DataFrame, bid: str) -> DataFrame:
    """A joint venture's profile: numeric scalars add up, others go, collections join."""
    flat = members.select(bid, F.explode("scalars").alias("k", "v")).withColumn("n", number(F.col("v"))).where("n IS NOT NULL")
    sums = flat.groupBy(bid, "k").agg(F.sum("n").alias("n")).groupBy(bid)
    scalars = sums.agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("n").cast("string")))).alias("scalars"))
    lists = members.select(bid, F.explode("collections").alias("k", "v")).groupBy(bid, "k").agg(F.flatten(F.collect_list("v")).alias("v"))
    collections = lists.groupBy(bid).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("collections"))
    empty_s, empty_c = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,array<map<string,string>>>")
    found = members.select(bid).distinct().join(scalars, bid, "left").join(collections, bid, "left")
    return found.select(bid, F.coalesce("scalars", empty_s).alias("scalars"), F.coalesce("collections", empty_c).alias("collections"))


def evaluate(members: DataFrame, bid: str, lead: str, node: dict, mode: str) -> DataFrame:
    """Verdict of each bid of ``members`` (one row a member; ``lead`` marks the first) in a mode."""
    from ..operators.aggregates import kleene_all, kleene_any

    if mode not in MODES:
        raise ExpressionError(f"unknown mode {mode!r}")
    if mode == "jv_combined":
        # only what the tree names is gathered
        keys, entities = (sorted(x) for x in used(node))
        named = members.select(
            bid, F.map_filter("scalars", lambda k, v: k.isin(*keys) if keys else F.lit(False)).alias("scalars"),
            F.map_filter("collections", lambda k, v: k.isin(*entities) if entities else F.lit(False)).alias("collections"),
        )
        return combine(named, bid).select(bid, compile_node(node).alias("verdict"))
    each = members.select(bid, lead, compile_node(node).alias("v"))
    if mode == "single":
        return each.where(lead).select(bid, F.col("v").alias("verdict"))
    fold = kleene_all if mode == "jv_each" else kleene_any
    return each.groupBy(bid).agg(fold(F.col("v")).alias("verdict"))


def evaluate_all(members: DataFrame, bid: str, order: str, node: dict) -> DataFrame:
    """Verdicts of each bid in every mode from one aggregation: bid and a column for each of MODES.

    The member with the least ``order`` leads.  Of the scalars only those that the tree names are added up; members'
    records meet in one row only for entities that it names.
    """
    from ..operators.aggregates import kleene_all, kleene_any

    keys, entities = (sorted(x) for x in used(node))
    each = members.select(bid, order, "scalars", "collections", compile_node(node).alias("v"))
    held = lambda names, columns: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*columns)), lambda k, v: v.isNotNull())
    sums = [F.sum(number(F.try_element_at("scalars", F.lit(k)))).cast("string").alias(f"s{i}") for i, k in enumerate(keys)]
    records = lambda e: F.try_element_at("collections", F.lit(e))
    lists = [F.when(F.count(records(e)) > 0, F.flatten(F.collect_list(records(e)))).alias(f"c{i}") for i, e in enumerate(entities)]
    found = each.groupBy(bid).agg(F.min_by("v", order).alias("first"), kleene_all(F.col("v")).alias("all"), kleene_any(F.col("v")).alias("any"), *sums, *lists)
    empty = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,array<map<string,string>>>")
    scalars = held(keys, [F.col(f"s{i}") for i in range(len(keys))]) if keys else empty[0]
    collections = held(entities, [F.col(f"c{i}") for i in range(len(entities))]) if entities else empty[1]
    joint = found.select(bid, "first", "all", "any", scalars.alias("scalars"), collections.alias("collections"))
    by = {"single": F.col("first"), "jv_combined": compile_node(node), "jv_each": F.col("all")}
    return joint.select(bid, *(by.get(m, F.col("any")).alias(m) for m in MODES))
