"""Opt-in filter index: token and trigram tables that narrow a filter before it is verified.

Narrowing adds a semi-join with the ids that can match; the predicate stays
above it, so results are the same with and without an index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters as P
from ..functions import text as X
from ..functions.partitions import materialize

#: Above this share of the documents a semi-join costs more than it saves.
WORTH = 0.5


@dataclass(frozen=True)
class FilterField:
    field: str
    tokens: bool = True
    trigrams: bool = False

    def __post_init__(self):
        if not self.field or not (self.tokens or self.trigrams):
            raise ValueError("an indexed field has tokens, trigrams or both")


def trigrams(s: str) -> set[str]:
    s = X.fold(s)
    return {s[i : i + 3] for i in range(len(s) - 2)}


def build(df: DataFrame, fields: list[FilterField]) -> DataFrame:
    """(collection, field, kind, key, id): distinct tokens (kind t) and trigrams (kind g) of each document's attribute."""
    if len({f.field for f in fields}) != len(fields):
        raise ValueError("a field is declared twice")
    out = None
    for f in fields:
        listed = isinstance(df.schema[f.field].dataType, T.ArrayType)
        each = F.col(f.field) if listed else F.array(F.col(f.field))
        parts = []
        if f.tokens:
            parts.append(("t", F.array_distinct(F.flatten(F.transform(each, X.tokens)))))
        if f.trigrams:
            def grams(t):
                t = X.fold_ascii(t)
                n = F.length(t)
                return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(t, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))

            parts.append(("g", F.array_distinct(F.flatten(F.transform(each, grams)))))
        for kind, keys in parts:
            one = df.where(F.col(f.field).isNotNull()).select("collection", F.lit(f.field).alias("field"), F.lit(kind).alias("kind"), F.explode(keys).alias("key"), "id")
            out = one if out is None else out.unionByName(one)
    return out


def _with_keys(index: DataFrame, field: str, kind: str, keys: set[str], least: int) -> DataFrame:
    """Documents that have ``least`` of the keys at least."""
    own = index.where((F.col("field") == field) & (F.col("kind") == kind) & F.col("key").isin(sorted(keys)))
    ids = own.groupBy("collection", "id").agg(F.count(F.lit(1)).alias("n"))
    return ids.where(F.col("n") >= least).select("collection", "id")


def literals(pattern: str) -> set[str]:
    """Literal runs of three characters or more that every match has; none if the pattern has alternatives or groups."""
    if any(c in pattern for c in "|()[]{}\\^$"):
        return set()
    out, run = set(), ""
    for i, ch in enumerate(pattern):
        if ch in "*?":
            run = run[:-1]
        if ch in "*?+.":
            out.add(run)
            run = pattern[i - 1] if ch == "+" and i else ""
        else:
            run += ch
    return {r for r in out | {run} if len(r) >= 3}


def candidates(index: DataFrame, fields: list[FilterField], p: P.Predicate) -> DataFrame | None:
    """(collection, id) of all documents that may pass; None if the index can't narrow the predicate."""
    have = {f.field: f for f in fields}
    if isinstance(p, P.All):
        found = [c for c in (candidates(index, fields, x) for x in p.of) if c is not None]
        out = found[0] if found else None
        for c in found[1:]:
            out = out.join(c, ["collection", "id"], "left_semi")
        return out
    if isinstance(p, P.Any_):
        found = [candidates(index, fields, x) for x in p.of]
        if not found or any(c is None for c in found):
            return None
        out = found[0]
        for c in found[1:]:
            out = out.unionByName(c)
        return out.distinct()
    f = have.get(getattr(p, "key", None))
    if f is None:
        return None
    if isinstance(p, (P.ContainsAllTokens, P.ContainsTokenSequence)) and f.tokens:
        q = set(X.token_list(p.value))
        return _with_keys(index, f.field, "t", q, len(q)) if q else None
    if isinstance(p, P.ContainsAnyToken) and f.tokens:
        q = set(X.token_list(p.value))
        return _with_keys(index, f.field, "t", q, 1) if q else None
    if isinstance(p, P.Fuzzy) and f.trigrams:
        # One edit changes three trigrams at most.
        need = trigrams(p.value)
        least = len(need) - 3 * p.edits
        return _with_keys(index, f.field, "g", need, least) if least > 0 else None
    if isinstance(p, P.Regex) and f.trigrams:
        need = {g for x in literals(p.value) for g in trigrams(x)}
        return _with_keys(index, f.field, "g", need, len(need)) if need else None
    return None


def narrowed(df: DataFrame, p: P.Predicate, index: DataFrame, fields: list[FilterField], worth: float | None = WORTH) -> DataFrame:
    """``df`` filtered by ``p``, with a semi-join below where the index narrows it to few enough documents.

    Fuzzy and regular-expression narrowing count a list's trigrams over all its
    elements, a bound that holds for each element.
    """
    ids = candidates(index, fields, p)
    if ids is not None and worth is not None:
        ids = materialize(ids)
    if ids is not None and (worth is None or ids.count() <= worth * df.count()):
        df = df.join(ids, ["collection", "id"], "left_semi")
    return df.where(P.compile_filter(p, P.bind(df)))
