"""Predicates against a plain evaluator, in both bindings, with random nested filters."""

import datetime as dt
import fnmatch
import math
import random
import re

import pytest

from sextant.functions import filters as P
from sextant.functions import text as X
from sextant.operators import findex

KINDS = {"s": "str", "i": "int", "f": "float", "b": "bool", "l": "list", "d": "dt"}
DDL = "id string, collection string, s string, i long, f double, b boolean, l array<string>, d timestamp"


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def toks(s):
    return [t for t in re.split(r"[\W_]+", fold(s)) if t]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def run_of(q, t):
    return any(t[k : k + len(q)] == q for k in range(len(t) - len(q) + 1))


def plain(p, r):
    """Two-valued truth of a predicate on a dict of present attributes."""
    if isinstance(p, P.All):
        return all(plain(x, r) for x in p.of)
    if isinstance(p, P.Any_):
        return any(plain(x, r) for x in p.of)
    if isinstance(p, P.Not):
        return not plain(p.of, r)
    if p.key not in r:
        return False
    a, v, name = r[p.key], p.value, type(p).__name__

    def eq(x, y):
        return P.kind_of(x) == P.kind_of(y) and x == y

    texts = [a] if isinstance(a, str) else a if isinstance(a, list) else []
    match name:
        case "Eq":
            return eq(a, v)
        case "Ne":
            return not eq(a, v)
        case "In":
            return any(eq(a, x) for x in v)
        case "NotIn":
            return not any(eq(a, x) for x in v)
        case "Lt" | "Le" | "Gt" | "Ge":
            if P.kind_of(a) != P.kind_of(v) or isinstance(a, list):
                return False
            x, y = (a.ms, v.ms) if isinstance(a, P.DateTime) else (a, v)
            return {"Lt": x < y, "Le": x <= y, "Gt": x > y, "Ge": x >= y}[name]
        case "Contains":
            return isinstance(a, list) and isinstance(v, str) and v in a
        case "NotContains":
            return isinstance(a, list) and not (isinstance(v, str) and v in a)
        case "ContainsAny":
            return isinstance(a, list) and bool(set(a) & {x for x in v if isinstance(x, str)})
        case "Glob":
            return isinstance(a, str) and re.fullmatch(fnmatch.translate(v), a) is not None
        case "IGlob":
            return isinstance(a, str) and re.fullmatch(fnmatch.translate(fold(v)), fold(a)) is not None
        case "Fuzzy":
            return any(edits(fold(t), fold(v)) <= p.edits for t in texts)
        case "ContainsAllTokens":
            return any(set(toks(v)) <= set(toks(t)) for t in texts)
        case "ContainsAnyToken":
            return any(set(toks(v)) & set(toks(t)) for t in texts)
        case "ContainsTokenSequence":
            return any(run_of(toks(v), toks(t)) for t in texts)
        case "Regex":
            return any(re.fullmatch(v, t) for t in texts)


WORDS = ["run", "Running", "café", "CAFE", "a", "bb", "don't", "x-y", "two words", ""]
VALUES = {"s": WORDS, "i": [0, 1, -3, 10, 2], "f": [0.0, -0.0, 1.5, math.nan, 10.0], "b": [True, False], "l": [[], ["a"], ["run", "two words"], ["café", ""]], "d": [P.DateTime(0), P.DateTime(1500), P.DateTime(-1)]}


def random_rows(rng, n):
    return [{k: (rng.choice(v) if k != "s" else " ".join(rng.choices(WORDS, k=rng.randint(1, 3)))) for k, v in VALUES.items() if rng.random() < 0.75} for _ in range(n)]


def random_filter(rng, depth=3):
    if depth and rng.random() < 0.45:
        kind = rng.choice(["all", "any", "not"])
        if kind == "not":
            return P.Not(random_filter(rng, depth - 1))
        return (P.All if kind == "all" else P.Any_)([random_filter(rng, depth - 1) for _ in range(rng.randint(0, 3))])
    key = rng.choice([*"sifbld", "gone"])
    any_value = lambda: rng.choice(VALUES[rng.choice("sifbld")])
    leaf = rng.choice([P.Eq, P.Ne, P.In, P.NotIn, P.Lt, P.Le, P.Gt, P.Ge, P.Contains, P.NotContains, P.ContainsAny, P.Glob, P.IGlob, P.Fuzzy, P.ContainsAllTokens, P.ContainsAnyToken, P.ContainsTokenSequence, P.Regex])
    if leaf in (P.Glob, P.IGlob):
        return leaf(key, rng.choice(["*", "r*", "?a*", "*[a-c]*", "R[!x]n*", "", "*words*"]))
    if leaf is P.Regex:
        return leaf(key, rng.choice(["r.*", "(a|bb).*", r"\w+", ".*café.*", "", "two words"]))
    if leaf is P.Fuzzy:
        return leaf(key, rng.choice(WORDS), rng.randint(0, 3))
    if leaf in (P.ContainsAllTokens, P.ContainsAnyToken, P.ContainsTokenSequence):
        return leaf(key, rng.choice([*WORDS, "run a", "words"]))
    if leaf in (P.In, P.NotIn, P.ContainsAny):
        return leaf(key, [any_value() for _ in range(rng.randint(0, 3))])
    return leaf(key, any_value() if rng.random() < 0.4 or key == "gone" else rng.choice(VALUES[key]))


@pytest.fixture(scope="module")
def data(spark):
    rows = random_rows(random.Random(7), 120)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    flat = [(str(n), "c", *[(epoch + dt.timedelta(milliseconds=r[k].ms) if k == "d" else r[k]) if k in r else None for k in "sifbld"]) for n, r in enumerate(rows)]
    columns = spark.createDataFrame(flat, DDL).cache()
    tagged = columns.select("id", "collection", P.to_attrs(columns, list("sifbld")).alias("attrs")).cache()
    return rows, columns, tagged


def test_random_filters(data):
    rows, columns, tagged = data
    rng = random.Random(11)
    for _ in range(8):
        filters = [random_filter(rng) for _ in range(25)]
        for df in (columns, tagged):
            got = df.select("id", *[P.truth(p, P.bind(df)).alias(f"p{i}") for i, p in enumerate(filters)]).collect()
            for r in got:
                for i, p in enumerate(filters):
                    assert r[f"p{i}"] == plain(p, rows[int(r.id)]), (p, rows[int(r.id)], df is tagged)


def test_where_equals_truth_and_pushes_down(data, spark, tmp_path):
    rows, columns, _ = data
    columns.write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    for p in (P.Eq("s", "run"), P.Not(P.Eq("i", 1)), P.Any_([P.Eq("b", True), P.Gt("i", 1)]), P.Le("d", P.DateTime(0)), P.NotIn("i", [1])):
        kept = df.where(P.compile_filter(p, P.bind(df)))
        assert {r.id for r in kept.collect()} == {str(i) for i, r in enumerate(rows) if plain(p, r)}
        if not isinstance(p, P.NotIn):
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert "PushedFilters: []" not in plan


def test_present_null_is_not_absent(spark):
    from sextant.sources.store import value

    df = spark.range(1).select(P.F.create_map(P.F.lit("n"), value(None), P.F.lit("x"), value("")).alias("attrs"))
    test = lambda p: df.select(P.truth(p, P.bind(df)).alias("t")).first()["t"]
    assert test(P.Eq("n", None)) and not test(P.Eq("gone", None)) and test(P.Ne("n", 1)) and test(P.Eq("x", "")) and not test(P.Eq("x", None))


@pytest.mark.parametrize(("glob", "yes", "no"), [("a[b", ["a[b"], ["ab"]), ("[]a]", [], ["a]", "]a]"]), ("[!]a", ["xa"], ["a"]), ("[a-]x", ["ax", "-x"], ["bx"]), ("a.b", ["a.b"], ["axb"]), ("*/x", ["a/b/x", "/x"], ["x"]), ("é?", ["éa"], ["é"]), ("**a", ["a", "ba"], ["ab"]), ("a\n?", ["a\nb"], ["a\n"])])
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "s string")
    assert {r.s for r in df.where(P.compile_filter(P.Glob("s", glob), P.bind(df))).collect()} == set(yes)


def test_regex_dialect(spark):
    df = spark.createDataFrame([("a\n",), ("a",), ("é",), ("a\rb",)], "s string")
    ask = lambda p: {r.s for r in df.where(P.compile_filter(P.Regex("s", p), P.bind(df))).collect()}
    assert ask("a") == {"a"} and ask(r"\w") == {"a", "é"} and ask("a.b") == {"a\rb"} and ask("a|é") == {"a", "é"}
    for bad in ("(a", r"(a)\1", "(?=a)", "a++"):
        with pytest.raises(ValueError):
            P.validate(P.Regex("s", bad))
    with pytest.raises(ValueError):
        P.validate(P.Not(P.Fuzzy("s", "x", 9)))


def test_json_form():
    p = P.predicate_from_json({"All": [{"Eq": ["k", {"Int": 3}]}, {"Not": {"Any": [{"Glob": ["s", "a*"]}, {"In": ["t", [{"Str": "x"}, "Null", {"DateTime": 5}]]}]}}, {"Fuzzy": ["s", "ab", 1]}, {"ContainsAllTokens": ["s", "a b"]}]})
    assert p == P.All([P.Eq("k", 3), P.Not(P.Any_([P.Glob("s", "a*"), P.In("t", ["x", None, P.DateTime(5)])])), P.Fuzzy("s", "ab", 1), P.ContainsAllTokens("s", "a b")])
    for v in ("x", 1, 1.5, True, ["a"], P.DateTime(3), None):
        assert P.value_from_json(P.value_to_json(v)) == v


def test_index_gives_the_same(data):
    rows, columns, _ = data
    fields = [findex.FilterField("s", True, True), findex.FilterField("l", True, True)]
    index = findex.build(columns, fields).cache()
    rng = random.Random(5)
    for _ in range(15):
        p = random_filter(rng)
        got = {r.id for r in findex.narrowed(columns, p, index, fields, worth=None).select("id").collect()}
        assert got == {str(i) for i, r in enumerate(rows) if plain(p, r)}, p


def test_trigram_bound_is_sound():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choices("ab", k=rng.randint(0, 9)))
        b = "".join(rng.choices("ab", k=rng.randint(0, 9)))
        d = edits(a, b)
        assert len(findex.trigrams(a) & findex.trigrams(b)) >= len(findex.trigrams(a)) - 3 * d


def test_token_list_matches_column(spark):
    texts = ["Don't stop_it", "ÀB c1²", " ", "x-y", "日本 語"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r.t for r in df.select(X.tokens(df.s).alias("t")).collect()] == [X.token_list(t) for t in texts]
