"""Filters: a conjunction of recursive predicates, compiled to one Catalyst expression.

A leaf is false on an attribute that a record does not have, negative leaves
too; ``Not`` complements truth, so ``Not(Eq(k, v))`` holds where ``k`` is absent.
Logic is two-valued. In a positive place leaves stay bare, as ``WHERE`` drops
NULL like false and Parquet can then prune; below a ``Not`` they are made
NULL-safe.

Two bindings give a key its column: ``Columns`` (a column per attribute, SQL NULL
means absent, the Spark type is the value's type) and ``Attrs`` (a map of tagged
values, in which a present null is not an absent one).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

MAX_FUZZY = 8
MAX_DEPTH = 128


@dataclass(frozen=True)
class DateTime:
    """A moment as UTC epoch milliseconds; not interchangeable with an integer."""

    ms: int


def kind_of(value: Any) -> str:
    """Tag of a literal: null, str, int, bool, list, float or dt."""
    if value is None:
        return "null"
    for kind, types in (("bool", bool), ("int", int), ("float", float), ("str", str), ("dt", DateTime)):
        if isinstance(value, types):
            return kind
    if isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value):
        return "list"
    raise TypeError(f"not an attribute value: {value!r}")


# --- predicates -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return All([self, other])

    def __or__(self, other: Predicate) -> Predicate:
        return Any_([self, other])

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class _Leaf(Predicate):
    key: str
    value: Any


class Eq(_Leaf): ...
class Ne(_Leaf): ...
class Glob(_Leaf): ...
class IGlob(_Leaf): ...
class In(_Leaf): ...
class NotIn(_Leaf): ...
class Lt(_Leaf): ...
class Le(_Leaf): ...
class Gt(_Leaf): ...
class Ge(_Leaf): ...
class Contains(_Leaf): ...
class NotContains(_Leaf): ...
class ContainsAny(_Leaf): ...
class ContainsAllTokens(_Leaf): ...
class ContainsAnyToken(_Leaf): ...
class ContainsTokenSequence(_Leaf): ...
class Regex(_Leaf): ...


@dataclass(frozen=True)
class Fuzzy(_Leaf):
    edits: int = 1


@dataclass(frozen=True)
class All(Predicate):
    of: list[Predicate] = field(default_factory=list)


@dataclass(frozen=True)
class Any_(Predicate):
    of: list[Predicate] = field(default_factory=list)


@dataclass(frozen=True)
class Not(Predicate):
    of: Predicate


LEAVES = {c.__name__: c for c in (Eq, Ne, Glob, IGlob, In, NotIn, Lt, Le, Gt, Ge, Contains, NotContains, ContainsAny, ContainsAllTokens, ContainsAnyToken, ContainsTokenSequence, Regex)}


# --- JSON form --------------------------------------------------------------------------------------------------

_TAGS = {"Str": str, "Int": int, "Float": float, "Bool": bool, "List": list, "DateTime": DateTime}


def value_from_json(v: Any) -> Any:
    """A tagged value: "Null" or {tag: value} with tag Str, Int, Float, Bool, List or DateTime."""
    if v == "Null":
        return None
    if isinstance(v, dict) and len(v) == 1 and (tag := next(iter(v))) in _TAGS:
        return _TAGS[tag](v[tag])
    raise ValueError(f"not a tagged value: {v!r}")


def value_to_json(v: Any) -> Any:
    tag = {"str": "Str", "int": "Int", "float": "Float", "bool": "Bool", "list": "List", "dt": "DateTime", "null": None}[kind_of(v)]
    return "Null" if tag is None else {tag: v.ms if tag == "DateTime" else list(v) if tag == "List" else v}


def predicate_from_json(p: dict, depth: int = 0) -> Predicate:
    """A predicate as {variant: arguments}; plain strings are patterns and queries, other values tagged."""
    if depth > MAX_DEPTH:
        raise ValueError("filter nested too deeply")
    ((name, args),) = p.items()
    if name in ("All", "Any"):
        return (All if name == "All" else Any_)([predicate_from_json(x, depth + 1) for x in args])
    if name == "Not":
        return Not(predicate_from_json(args, depth + 1))
    if name == "Fuzzy":
        return Fuzzy(args[0], args[1], int(args[2]))
    if name not in LEAVES:
        raise ValueError(f"unknown predicate {name}")
    key, value = args
    if name in ("In", "NotIn", "ContainsAny"):
        return LEAVES[name](key, [value_from_json(x) for x in value])
    return LEAVES[name](key, value if isinstance(value, str) and value != "Null" else value_from_json(value))


def millis(c: Column, t: T.DataType) -> Column:
    """Epoch milliseconds of a timestamp column; one without a time zone is UTC."""
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    return F.unix_millis(c)


def moment(ms: int, t: T.DataType) -> Column:
    """A literal of the type of a timestamp column, so that comparisons are pushed down."""
    if isinstance(t, T.TimestampNTZType):
        text = (datetime(1970, 1, 1) + timedelta(milliseconds=ms)).isoformat(sep=" ", timespec="milliseconds")
        return F.lit(text).cast("timestamp_ntz")
    return F.timestamp_millis(F.lit(ms))


# --- bindings ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Attr:
    """How one key reads: ``present``, and a (column, condition on its type) for each type it may have."""

    present: Column
    types: dict[str, tuple[Column, Column | None]]


class Columns:
    """Attributes as columns of ``df``; NULL means absent. The names in ``without`` are no attributes."""

    def __init__(self, df: DataFrame, without: tuple[str, ...] = ("collection", "id", "row", "vector")):
        self.fields = {f.name: f.dataType for f in df.schema if f.name not in without}

    @staticmethod
    def kind(t: T.DataType) -> str | None:
        if isinstance(t, T.IntegralType):
            return "int"
        if isinstance(t, T.FractionalType):
            return "float"
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return "dt"
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            return "list"
        return {T.StringType: "str", T.BooleanType: "bool"}.get(type(t))

    def attr(self, key: str) -> _Attr:
        if key not in self.fields:
            return _Attr(F.lit(False), {})
        c, kind = F.col(f"`{key}`"), self.kind(self.fields[key])
        return _Attr(c.isNotNull(), {kind: (c, None)} if kind else {})


#: Type of the map of tagged values: t is the tag; dt shares i.
VALUE = T.StructType([T.StructField(n, t) for n, t in (("t", T.StringType()), ("s", T.StringType()), ("i", T.LongType()), ("b", T.BooleanType()), ("l", T.ArrayType(T.StringType())), ("f", T.DoubleType()))])
ATTRS = T.MapType(T.StringType(), VALUE)
_SLOT = {"str": "s", "int": "i", "bool": "b", "list": "l", "float": "f", "dt": "i"}


class Attrs:
    """Attributes in one map column of tagged values."""

    def __init__(self, column: str = "attrs"):
        self.column = column

    def attr(self, key: str) -> _Attr:
        v = F.try_element_at(F.col(self.column), F.lit(key))
        return _Attr(v.isNotNull(), {"null": (v, v["t"] == "null")} | {k: (v[slot], v["t"] == k) for k, slot in _SLOT.items()})


def bind(df: DataFrame) -> Columns | Attrs:
    """The binding of a DataFrame: the map of tagged values if it has one as ``attrs``, else its columns."""
    tagged = "attrs" in df.columns and isinstance(df.schema["attrs"].dataType, T.MapType)
    return Attrs() if tagged else Columns(df)


def tagged(c: Column, t: T.DataType) -> Column:
    """A column's values as tagged values; NULL stays NULL (absent)."""
    kind = Columns.kind(t)
    if kind is None:
        raise TypeError(f"no attribute type for {t.simpleString()}")
    value = millis(c, t) if kind == "dt" else c
    slots = [value.cast(f.dataType).alias(f.name) if f.name == _SLOT[kind] else F.lit(None).cast(f.dataType).alias(f.name) for f in VALUE.fields[1:]]
    return F.when(c.isNotNull(), F.struct(F.lit(kind).alias("t"), *slots))


def to_attrs(df: DataFrame, columns: list[str]) -> Column:
    """A map of tagged values from columns; absent values have no entry."""
    pairs = [F.struct(F.lit(c).alias("k"), tagged(F.col(f"`{c}`"), df.schema[c].dataType).alias("v")) for c in columns]
    if not pairs:
        return F.lit(None).cast(ATTRS)
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"].isNotNull()))


def promote(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``df`` with columns for attributes of its map: key to kind (str, int, bool, list, float, dt); other-typed values are NULL."""
    for k, kind in keys.items():
        v = F.try_element_at("attrs", F.lit(k))
        c = F.when(v["t"] == kind, v[_SLOT[kind]])
        df = df.withColumn(k, F.timestamp_millis(c) if kind == "dt" else c)
    return df


# --- compiler ---------------------------------------------------------------------------------------------------


class _Compiler:
    def __init__(self, binding: Columns | Attrs):
        self.binding = binding

    def _typed(self, attr: _Attr, kind: str, test) -> Column:
        if kind not in attr.types:
            return F.lit(False)
        c, guard = attr.types[kind]
        return test(c) if guard is None else guard & test(c)

    def _compare(self, key: str, attr: _Attr, value: Any, op: str) -> Column:
        """Same-typed comparison; bare where it can be, so that it is pushed down."""
        kind = kind_of(value)
        if kind == "float" and math.isnan(value):
            return F.lit(False)
        if kind == "null":
            return self._typed(attr, "null", lambda c: F.lit(True)) if op == "eq" else F.lit(False)
        if kind == "list" and op != "eq":
            return F.lit(False)

        def test(c: Column) -> Column:
            if kind == "dt" and isinstance(self.binding, Columns):
                at, after = (moment(value.ms + i, self.binding.fields[key]) for i in (0, 1))
                return {"eq": (c >= at) & (c < after), "lt": c < at, "le": c < after, "gt": c >= after, "ge": c >= at}[op]
            v = F.lit(value.ms if kind == "dt" else list(value) if kind == "list" else value)
            out = {"eq": c == v, "lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}[op]
            return out & ~F.isnan(c) if kind == "float" and op in ("gt", "ge") else out

        return self._typed(attr, kind, test)

    def _text(self, attr: _Attr, test) -> Column:
        """``test`` of a string, or of any element of a list."""
        forms = {"str": test, "list": lambda c: F.exists(c, test)}
        return reduce(Column.__or__, [self._typed(attr, k, f) for k, f in forms.items() if k in attr.types] or [F.lit(False)])

    def _in(self, key: str, attr: _Attr, values: list) -> Column:
        plain: dict[str, list] = {}
        other = []
        for v in values:
            kind = kind_of(v)
            if kind in ("str", "int", "bool") or (kind == "float" and not math.isnan(v)):
                plain.setdefault(kind, []).append(v)
            else:
                other.append(self._compare(key, attr, v, "eq"))
        parts = [self._typed(attr, kind, lambda c, vs=vs: c.isin(vs)) for kind, vs in plain.items() if kind in attr.types]
        return reduce(Column.__or__, [*parts, *other] or [F.lit(False)])

    def leaf(self, p: Predicate) -> Column:
        attr, v = self.binding.attr(p.key), p.value
        false = F.lit(False)

        def absent_or(c: Column) -> Column:
            return attr.present & ~F.coalesce(c, false)

        if isinstance(p, Fuzzy):
            return self._text(attr, lambda c: F.levenshtein(X.fold_ascii(c), F.lit(X.fold(v)), p.edits) >= 0)
        match type(p).__name__:
            case "Eq":
                return self._compare(p.key, attr, v, "eq")
            case "Ne":
                return absent_or(self._compare(p.key, attr, v, "eq"))
            case "Lt" | "Le" | "Gt" | "Ge" as op:
                return self._compare(p.key, attr, v, op.lower())
            case "In":
                return self._in(p.key, attr, v)
            case "NotIn":
                return absent_or(self._in(p.key, attr, v))
            case "Glob":
                return self._typed(attr, "str", lambda c: c.rlike(X.glob_regex(v)))
            case "IGlob":
                return self._typed(attr, "str", lambda c: X.fold_ascii(c).rlike(X.glob_regex(X.fold(v))))
            case "Contains":
                return self._typed(attr, "list", lambda c: F.array_contains(c, v)) if isinstance(v, str) else false
            case "NotContains":
                return self._typed(attr, "list", lambda c: c.isNotNull() & ~F.coalesce(F.array_contains(c, v), false) if isinstance(v, str) else c.isNotNull())
            case "ContainsAny":
                some = [x for x in v if isinstance(x, str)]
                return self._typed(attr, "list", lambda c: F.arrays_overlap(c, F.lit(some))) if some else false
            case "ContainsAllTokens":
                q = sorted(set(X.token_list(v)))
                return self._text(attr, lambda c: X.has_all(c, q) & (F.size(F.array_intersect(X.tokens(c), F.lit(q))) == len(q)) if q else c.isNotNull())
            case "ContainsAnyToken":
                q = sorted(set(X.token_list(v)))
                return self._text(attr, lambda c: X.has_any(c, q) & F.arrays_overlap(X.tokens(c), F.lit(q))) if q else false
            case "ContainsTokenSequence":
                q = " ".join(X.token_list(v))
                return self._text(attr, lambda c: X.has_all(c, q.split(" ")) & F.contains(F.concat(F.lit(" "), F.array_join(X.tokens(c), " "), F.lit(" ")), F.lit(f" {q} ")) if q else c.isNotNull())
            case "Regex":
                return self._text(attr, lambda c: c.rlike(X.anchored_regex(v)))
        raise TypeError(f"not a predicate: {p!r}")

    def positive(self, p: Predicate) -> Column:
        if isinstance(p, All):
            return reduce(Column.__and__, map(self.positive, p.of)) if p.of else F.lit(True)
        if isinstance(p, Any_):
            return reduce(Column.__or__, map(self.positive, p.of)) if p.of else F.lit(False)
        if isinstance(p, Not):
            q = p.of
            if isinstance(q, Eq) and isinstance(self.binding, Columns) and kind_of(q.value) in ("str", "int", "bool"):
                attr = self.binding.attr(q.key)
                if kind_of(q.value) in attr.types:
                    return ~attr.types[kind_of(q.value)][0].eqNullSafe(F.lit(q.value))
            return ~F.coalesce(self.positive(q), F.lit(False))
        return self.leaf(p)


def validate(p: Predicate, depth: int = 0) -> None:
    """Raise ValueError for a filter that can't run: too many edits, bad patterns, too deep nesting."""
    if depth > MAX_DEPTH:
        raise ValueError("filter nested too deeply")
    if isinstance(p, (All, Any_)):
        for x in p.of:
            validate(x, depth + 1)
    elif isinstance(p, Not):
        validate(p.of, depth + 1)
    elif isinstance(p, Fuzzy) and not 0 <= p.edits <= MAX_FUZZY:
        raise ValueError(f"at most {MAX_FUZZY} edits")
    elif isinstance(p, Regex):
        X.anchored_regex(p.value)


def compile_filter(p: Predicate | None, binding: Columns | Attrs) -> Column:
    """The filter as a Column for ``where``: NULL counts as false."""
    if p is None:
        return F.lit(True)
    validate(p)
    return _Compiler(binding).positive(p)


def truth(p: Predicate | None, binding: Columns | Attrs) -> Column:
    """The same as a Column that is never NULL, for use outside ``where``."""
    return F.coalesce(compile_filter(p, binding), F.lit(False))
