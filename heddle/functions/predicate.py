"""Metadata filters: a JSON tree of conditions compiled to one two-valued Column.

A filter is parsed into a list of clauses (tests, negations, unions), and the
clauses are compiled onto a metadata map or, where the caller names them, onto
real columns, so that the scan can skip row groups. Every test is true or
false, never null, so negations also match documents that lack the field.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: operators, connectives, depth and the two spellings of booleans are part of the filter language
MAX_DEPTH = 32
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
INFINITE = r"^[+-]?(?i:inf|infinity)$"
BOOLEANS = {"sdk": {True: "true", False: "false"}, "engine": {True: "True", False: "False"}}
SCALAR, LIST, FLAG = "a scalar", "a list of scalars that is not empty", "true or false"
OPERANDS = {"$eq": SCALAR, "$ne": SCALAR, "$gt": SCALAR, "$gte": SCALAR, "$lt": SCALAR, "$lte": SCALAR, "$in": LIST, "$nin": LIST, "$exists": FLAG}
CONNECTIVES = ("$and", "$or", "$not")


class FilterError(ValueError):
    """The filter is not well formed."""


@dataclass(frozen=True)
class Test:
    """One operator on one field; ``operand`` is text, a tuple of texts or a bool."""

    field: str
    op: str
    operand: Any


@dataclass(frozen=True)
class Group:
    """Clauses joined by ``all`` or ``any``, or ``none`` of them."""

    how: str
    clauses: tuple


def _text(value: Any, bool_style: str) -> str:
    if isinstance(value, bool):
        return BOOLEANS[bool_style][value]
    return "" if value is None else str(value)


def _is_scalar(value: Any) -> bool:
    return value is None or isinstance(value, (str, bool, int, float))


#: What each kind of operand must look like, and how it is written down.
_CHECKS: dict[str, tuple[Callable[[Any], bool], Callable[[Any, str], Any]]] = {
    SCALAR: (_is_scalar, _text),
    LIST: (lambda v: isinstance(v, (list, tuple)) and bool(v) and all(map(_is_scalar, v)), lambda v, style: tuple(_text(x, style) for x in v)),
    FLAG: (lambda v: isinstance(v, bool), lambda v, style: v),
}


def parse(tree: Any, bool_style: str = "sdk") -> Group:
    """The filter as nested groups; refused as a whole if any part is not well formed.

    Works through a list of open places, not by recursion, so that depth is a
    plain number beside each place.
    """
    root: list = []
    todo = [(tree, 0, root)]
    built: list[tuple[list, str, list]] = []  # (where a group goes, how it joins, its clauses), outer ones first
    while todo:
        node, depth, into = todo.pop()
        if depth > MAX_DEPTH:
            raise FilterError(f"more than {MAX_DEPTH} levels of conditions")
        if not isinstance(node, Mapping) or not node:
            raise FilterError(f"expected an object with conditions, got {node!r}")
        for name, wanted in node.items():
            if name in CONNECTIVES:
                inner = [wanted] if name == "$not" else wanted
                if not isinstance(inner, (list, tuple)) or not inner:
                    raise FilterError(f"{name} joins a list of filters, got {wanted!r}")
                # every member is a conjunction of its own
                members: list = []
                built.append((into, {"$and": "all", "$or": "any", "$not": "none"}[name], members))
                for each in inner:
                    clauses: list = []
                    built.append((members, "all", clauses))
                    todo.append((each, depth + 1, clauses))
            elif not isinstance(name, str) or not name.strip() or name.startswith("$"):
                raise FilterError(f"{name!r} is neither a field nor one of {', '.join(CONNECTIVES)}")
            else:
                into.extend(_tests(name, wanted, bool_style))
    for into, how, clauses in reversed(built):
        into.append(Group(how, tuple(clauses)))
    return Group("all", tuple(root))


def _tests(field: str, wanted: Any, bool_style: str) -> list[Test]:
    asked = wanted if isinstance(wanted, Mapping) else {"$eq": wanted}
    if not asked:
        raise FilterError(f"no condition on {field}")
    found = []
    for op, operand in asked.items():
        if op not in OPERANDS:
            raise FilterError(f"{op!r} on {field} is none of {', '.join(OPERANDS)}")
        fits, write = _CHECKS[OPERANDS[op]]
        if not fits(operand):
            raise FilterError(f"{op} on {field} takes {OPERANDS[op]}, got {operand!r}")
        found.append(Test(field, op, write(operand, bool_style)))
    return found


def _number(text: Column) -> Column:
    plain = F.when(text.rlike(NUMBER) | text.rlike(INFINITE), text.try_cast("double"))
    return F.when(plain.isNull() & text.rlike(INFINITE), F.when(text.startswith("-"), float("-inf")).otherwise(float("inf"))).otherwise(plain)


def _parsed(text: str) -> float | None:
    try:
        value = float(text) if text == text.strip() and "_" not in text else math.nan
    except ValueError:
        return None
    return None if math.isnan(value) else value


_COMPARE = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Place:
    """Where a field is found: its text, whether it is there and, for whole-numbered columns, the number itself."""

    text: Column
    present: Column
    whole: Column | None = None

    def test(self, op: str, operand: Any) -> Column:
        """Two-valued; equalities and comparisons of plain columns reach the scan as pushed filters."""
        if op == "$exists":
            return self.present if operand else ~self.present
        if op in ("$ne", "$nin"):
            return ~self.test({"$ne": "$eq", "$nin": "$in"}[op], operand)
        if op == "$eq":
            return self._equals(operand)
        if op == "$in":
            if self.whole is not None:
                return reduce(lambda a, b: a | b, [self._equals(x) for x in operand])
            return self.text.isNotNull() & self.text.isin(list(operand))
        return self._range(op, operand)

    def _equals(self, operand: str) -> Column:
        if self.whole is None:
            return self.text.eqNullSafe(F.lit(operand))
        try:
            number = int(operand)
        except ValueError:
            return F.lit(False)
        return self.whole.eqNullSafe(F.lit(number)) if str(number) == operand and abs(number) < 1 << 63 else F.lit(False)

    def _range(self, op: str, operand: str) -> Column:
        compare, number = _COMPARE[op], _parsed(operand)
        if self.whole is not None and number is not None and abs(number) < 1 << 53:
            edge = {"$gt": math.floor, "$lte": math.floor, "$gte": math.ceil, "$lt": math.ceil}[op](number)
            return self.whole.isNotNull() & compare(self.whole, F.lit(edge))
        as_text = compare(self.text, F.lit(operand))
        if number is None:
            return self.text.isNotNull() & as_text
        value = _number(self.text)
        return F.coalesce(F.when(value.isNotNull(), compare(value, F.lit(number))).otherwise(as_text), F.lit(False))


def map_place(metadata: Column, field: str) -> Place:
    return Place(F.try_element_at(metadata, F.lit(field)), F.coalesce(F.map_contains_key(metadata, field), F.lit(False)))


def column_place(df: DataFrame, column: str) -> Place:
    """A column of ``df`` as a field; null is absent."""
    at, kind = F.col(column), df.schema[column].dataType
    return Place(at if isinstance(kind, T.StringType) else at.cast("string"), at.isNotNull(), at if isinstance(kind, _WHOLE) else None)


def _compile(clause: Test | Group, place: Callable[[str], Place]) -> Column:
    if isinstance(clause, Test):
        return place(clause.field).test(clause.op, clause.operand)
    parts = [_compile(c, place) for c in clause.clauses]
    joined = reduce((lambda a, b: a & b) if clause.how != "any" else (lambda a, b: a | b), parts)
    return ~joined if clause.how == "none" else joined


def metadata_filter(metadata: Column, tree: dict, bool_style: str = "sdk", key_prefix: str = "", columns: Mapping[str, Place] | None = None) -> Column:
    """The Column that is true for rows whose metadata match ``tree``.

    Null metadata behave like an empty map. ``key_prefix`` rewrites every field
    name, so that callers cannot reach reserved fields. Fields named in
    ``columns`` are tested there and not in the map.
    """
    known = columns or {}
    return _compile(parse(tree, bool_style), lambda field: known.get(key_prefix + field) or map_place(metadata, key_prefix + field))


def _listed(df: DataFrame, ident: str, ids: list[str]) -> DataFrame:
    """Rows with a listed id; long lists are joined, so that the plan does not grow with them."""
    wanted = sorted(set(ids))
    if len(wanted) <= 1000:
        return df.filter(F.col(ident).isin(wanted))
    table = df.sparkSession.createDataFrame([(i,) for i in wanted], f"`{ident}` string")
    return df.join(table, ident, "left_semi").select(*df.columns)


def apply_filter(
    df: DataFrame, spec: dict | None, metadata: str = "metadata", ident: str = "document_id", bool_style: str = "sdk", columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Keeps the rows that match a flat metadata filter or an envelope ``{metadata, document_ids}``.

    ``document_ids`` is a list of ids, or a DataFrame with the id column for allowlists of any size.
    ``columns`` maps field names to columns of ``df`` that hold them, so that tests on them reach the scan.
    """
    if spec is None:
        return df
    envelope = set(spec) <= {"metadata", "document_ids"} and bool(spec)
    tree, ids = (spec.get("metadata"), spec.get("document_ids")) if envelope else (spec, None)
    if envelope and "document_ids" in spec:
        if isinstance(ids, DataFrame):
            df = df.join(ids.select(ident).distinct(), ident, "left_semi").select(*df.columns)
        elif isinstance(ids, (list, tuple)) and ids and all(isinstance(i, str) and i.strip() for i in ids):
            df = _listed(df, ident, ids)
        else:
            raise FilterError("document_ids is a DataFrame or a list of ids, none of them blank")
    if tree is not None and (tree or not envelope):
        places = {field: column_place(df, c) for field, c in (columns or {}).items()}
        df = df.filter(metadata_filter(F.col(metadata) if metadata in df.columns else F.lit(None).cast("map<string,string>"), tree, bool_style, columns=places))
    return df


# --- other dialects, rewritten to the tree above

# fixed values: the operator names of the condition dialect
CONDITION_OPERATORS = {"==": "$eq", "!=": "$ne", ">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte", "in": "$in", "nin": "$nin"}


def from_conditions(conditions: list[dict], combine: str = "and") -> dict:
    """Conditions ``{key, operator, value}`` with the operators
    ``== != > >= < <= in nin is_empty`` joined by ``and``, ``or`` or ``not``; a
    condition may itself be ``{conditions, combine}``."""
    trees = []
    for c in conditions:
        if "conditions" in c:
            trees.append(from_conditions(c["conditions"], c.get("combine", "and")))
        elif c["operator"] == "is_empty":
            trees.append({"$or": [{c["key"]: {"$exists": False}}, {c["key"]: ""}]})
        elif c["operator"] in CONDITION_OPERATORS:
            trees.append({c["key"]: {CONDITION_OPERATORS[c["operator"]]: c["value"]}})
        else:
            raise FilterError(f"unknown operator {c['operator']}")
    if not trees:
        raise FilterError("no conditions")
    if combine not in ("and", "or", "not"):
        raise FilterError(f"conditions are joined by and, or, not; got {combine!r}")
    if combine == "not":
        return {"$not": {"$or": trees}}
    return trees[0] if len(trees) == 1 else {f"${combine}": trees}


def from_memory_filters(node: dict) -> dict:
    """Filters with ``AND``/``OR``/``NOT`` lists, ``"*"`` for presence and lists for membership."""
    parts = []
    for key, value in node.items():
        if key in ("AND", "OR"):
            parts.append({f"${key.lower()}": [from_memory_filters(v) for v in value]})
        elif key == "NOT":
            parts.append({"$not": {"$or": [from_memory_filters(v) for v in value]}})
        elif value == "*":
            parts.append({key: {"$exists": True}})
        elif isinstance(value, (list, tuple)):
            parts.append({key: {"$in": list(value)}})
        elif isinstance(value, dict):
            parts.append({key: {f"${op}": v for op, v in value.items()}})
        else:
            parts.append({key: value})
    return parts[0] if len(parts) == 1 else {"$and": parts}


def from_tags(tags: list[str], match: str = "or", prefix: str = "tag:") -> dict:
    """Rows that carry any (``or``) or all (``and``) of the tags."""
    trees = [{prefix + t: {"$exists": True}} for t in tags]
    return trees[0] if len(trees) == 1 else {f"${match}": trees}


def from_pairs(pairs: dict, where: dict | None = None) -> dict:
    """Plain ``{field: value}`` equalities, lists for membership, and optionally a further filter ``where``; both must hold."""
    trees = [{k: {"$in": list(v)} if isinstance(v, (list, tuple)) else v} for k, v in pairs.items()] + ([where] if where else [])
    if not trees:
        raise FilterError("no conditions")
    return trees[0] if len(trees) == 1 else {"$and": trees}
