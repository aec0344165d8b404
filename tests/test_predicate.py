"""Filters against a small evaluator that looks at one map at a time."""

import itertools
import operator

import pytest
from pyspark.sql import functions as F

from heddle.functions.predicate import FilterError, apply_filter, column_place, from_conditions, from_memory_filters, from_pairs, from_tags, metadata_filter, parse

from .conftest import rows

# every field takes each of its values with each of the other's: absent, blank, words, numbers in several spellings
WEIGHTS = [None, "", "heavy", "3", "-0.5", "4e2", "+7.25", ".5", "Infinity", "-inf", "NaN", " 3", "1_0"]
COLOURS = [None, "", "red", "Red", "blue", "TRUE", "true", "True"]
SHELF = [{k: v for k, v in (("weight", w), ("colour", c)) if v is not None} for w, c in itertools.product(WEIGHTS, COLOURS)]


def number(text):
    if text != text.strip() or "_" in text:
        return None
    try:
        value = float(text)
    except ValueError:
        return None
    return None if value != value else value


RANGES = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def spelled(value):
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def holds(item, tree):
    """The rules, one map at a time: missing fields fail every test but the negated ones."""
    verdicts = []
    for key, wanted in tree.items():
        if key == "$and":
            verdicts.append(all([holds(item, t) for t in wanted]))
        elif key == "$or":
            verdicts.append(any([holds(item, t) for t in wanted]))
        elif key == "$not":
            verdicts.append(not holds(item, wanted))
        else:
            for op, operand in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
                have = item.get(key)
                if op == "$exists":
                    verdicts.append((have is not None) == operand)
                elif op in ("$eq", "$ne"):
                    verdicts.append((have == spelled(operand)) == (op == "$eq"))
                elif op in ("$in", "$nin"):
                    verdicts.append((have in [spelled(o) for o in operand]) == (op == "$in"))
                elif have is None:
                    verdicts.append(False)
                else:
                    a, b = number(have), number(spelled(operand))
                    a, b = (a, b) if a is not None and b is not None else (have, spelled(operand))
                    verdicts.append(RANGES[op](a, b))
    return all(verdicts)


TREES = [
    {"colour": "red"},
    {"colour": ""},
    {"colour": None},
    {"weight": 3},
    {"weight": {"$ne": "heavy"}},
    {"colour": {"$in": ["blue", "", "green"]}},
    {"colour": {"$nin": ["blue", "red"]}},
    {"weight": {"$exists": True}},
    {"weight": {"$exists": False}, "colour": True},
    {"weight": {"$gt": 3}},
    {"weight": {"$gte": "3", "$lte": 400}},
    {"weight": {"$lt": 0}},
    {"weight": {"$lte": "heavy"}},
    {"colour": {"$gte": "blue", "$lt": "true"}},
    {"weight": {"$gt": "inf"}},
    {"weight": {"$gte": "Infinity"}},
    {"weight": {"$lt": "nan"}},
    {"colour": False},
    {"$not": {"colour": "red", "weight": {"$exists": True}}},
    {"$and": [{"colour": {"$ne": "red"}}, {"$or": [{"weight": {"$gt": 1}}, {"weight": ""}]}]},
    {"$or": [{"$not": {"colour": {"$exists": True}}}, {"$and": [{"colour": "blue"}, {"weight": {"$lt": 5}}]}], "weight": {"$ne": "3"}},
]


@pytest.fixture(scope="module")
def shelf(spark):
    return spark.createDataFrame([(i, m) for i, m in enumerate(SHELF)] + [(-1, None)], "document_id int, metadata map<string,string>")


@pytest.mark.parametrize("tree", TREES, ids=str)
def test_matches_the_evaluator(shelf, tree):
    kept = {r[0] for r in shelf.filter("document_id >= 0").filter(metadata_filter(F.col("metadata"), tree)).collect()}
    assert kept == {i for i, item in enumerate(SHELF) if holds(item, tree)}


def test_matches_the_evaluator_on_columns(spark):
    """The same rules where the fields are columns, a whole-numbered one among them."""
    data = list(itertools.product([None, "", "red", "7"], [None, 3, -2, 400]))
    table = spark.createDataFrame([(i, c, w) for i, (c, w) in enumerate(data)], "document_id int, colour string, weight bigint")
    trees = [{"weight": {op: v}} for op in RANGES for v in (3, "2.5", -2, "x", "inf")] + [{"weight": "3"}, {"weight": "3.0"}, {"weight": {"$in": [3, "400", "z"]}}, {"weight": {"$nin": [3]}}, {"colour": {"$ne": "red"}}, {"colour": 7}]
    for tree in trees:
        places = {c: column_place(table, c) for c in ("colour", "weight")}
        kept = {r[0] for r in table.filter(metadata_filter(F.lit(None).cast("map<string,string>"), tree, columns=places)).collect()}
        items = [{k: str(v) for k, v in (("colour", c), ("weight", w)) if v is not None} for c, w in data]
        assert kept == {i for i, item in enumerate(items) if holds(item, tree)}, tree


def test_column_tests_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", "red", 5)], "document_id string, colour string, weight bigint").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    kept = apply_filter(table, {"colour": "red", "weight": {"$gte": 4.5}}, columns={"colour": "colour", "weight": "weight"})
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "colour" in pushed and "GreaterThanOrEqual(weight,5)" in pushed and kept.count() == 1


def test_other_dialects(shelf):
    kept = lambda tree: {r[0] for r in shelf.filter("document_id >= 0").filter(metadata_filter(F.col("metadata"), tree)).collect()}
    brute = lambda test: {i for i, item in enumerate(SHELF) if test(item.get("colour"), item.get("weight"))}
    blank = {"key": "weight", "operator": "is_empty", "value": None}
    red = {"key": "colour", "operator": "==", "value": "red"}
    assert kept(from_conditions([blank, red])) == brute(lambda c, w: w in (None, "") and c == "red")
    assert kept(from_conditions([blank, red], "not")) == brute(lambda c, w: not (w in (None, "") or c == "red"))
    nested = from_conditions([red, {"conditions": [blank, {"key": "colour", "operator": "in", "value": ["blue"]}], "combine": "and"}], "or")
    assert kept(nested) == brute(lambda c, w: c == "red" or (w in (None, "") and c == "blue"))
    assert kept(from_memory_filters({"OR": [{"colour": ["red", "blue"]}, {"weight": {"gt": 300}}], "NOT": [{"colour": "*"}]})) == brute(lambda c, w: c is None and w in ("4e2", "Infinity", "heavy", "NaN"))
    assert kept(from_tags(["colour", "weight"], "and", "")) == brute(lambda c, w: c is not None and w is not None)
    assert kept(from_pairs({"colour": ["red", "blue"]}, {"weight": "3"})) == brute(lambda c, w: c in ("red", "blue") and w == "3")
    for bad in (lambda: from_conditions([]), lambda: from_conditions([{"key": "a", "operator": "~", "value": 1}]), lambda: from_conditions([red], "xor"), lambda: from_pairs({})):
        with pytest.raises(FilterError):
            bad()


def test_spelling_of_booleans(shelf):
    for style, want in (("sdk", "true"), ("engine", "True")):
        kept = {r[0] for r in shelf.filter(metadata_filter(F.col("metadata"), {"colour": True}, style)).collect()}
        assert kept == {i for i, item in enumerate(SHELF) if item.get("colour") == want}


def test_null_metadata_is_empty(shelf):
    hit = shelf.filter(metadata_filter(F.col("metadata"), {"colour": {"$ne": "red", "$exists": False}, "$not": {"weight": "3"}}))
    assert -1 in {r[0] for r in hit.collect()}


MALFORMED = {
    "empty object": {},
    "list for an object": ["colour"],
    "operator for a field": {"$near": 5},
    "operator unknown": {"weight": {"$near": 5}},
    "field without condition": {"weight": {}},
    "blank field": {"   ": "red"},
    "object as value": {"weight": {"$gt": {"than": 3}}},
    "list as value": {"colour": ["red"]},
    "list for equality": {"colour": {"$ne": ["red"]}},
    "membership in a text": {"colour": {"$nin": "red"}},
    "membership in nothing": {"colour": {"$in": []}},
    "presence by number": {"colour": {"$exists": 1}},
    "union of nothing": {"$or": []},
    "union without list": {"$or": {"colour": "red"}},
    "negated list": {"$not": [{"colour": "red"}]},
    "bad part deep inside": {"$and": [{"colour": "red"}, {"$not": {"$or": [{"weight": {"$in": [[]]}}]}}]},
}


@pytest.mark.parametrize("tree", MALFORMED.values(), ids=MALFORMED.keys())
def test_malformed(tree):
    with pytest.raises(FilterError):
        parse(tree)


def test_depth_is_bounded():
    nest = lambda tree, levels: nest({"$not": tree}, levels - 1) if levels else tree
    parse(nest({"colour": "red"}, 32))
    with pytest.raises(FilterError):
        parse(nest({"colour": "red"}, 33))


def test_envelope(spark):
    table = spark.createDataFrame([(c, {"kind": k}) for c, k in zip("pqrs", ["x", "y", "x", "y"])], "document_id string, metadata map<string,string>")
    ids = lambda spec: {r[0] for r in apply_filter(table, spec).collect()}
    assert ids({"document_ids": ["p", "q", "nobody"], "metadata": {"kind": "x"}}) == {"p"}
    assert ids({"document_ids": ["s", "s"]}) == {"s"} and len(ids(None)) == 4
    assert ids({"document_ids": ["q"] + [f"n{i}" for i in range(2000)]}) == {"q"}
    assert ids({"document_ids": spark.createDataFrame([("r",), ("r",), (None,)], "document_id string")}) == {"r"}
    for bad in ([], [""], "p", None):
        with pytest.raises(FilterError):
            apply_filter(table, {"document_ids": bad})


def test_reserved_prefix(spark):
    row = spark.createDataFrame([({"kind": "x", "property:kind": "y"},)], "metadata map<string,string>")
    assert rows(row.filter(metadata_filter(F.col("metadata"), {"kind": "x"}, key_prefix="property:"))) == []
    assert row.filter(metadata_filter(F.col("metadata"), {"kind": "y"}, key_prefix="property:")).count() == 1
