"""Quality rules: a decision list learned from labelled statistics, in DataFrame operations.

Features are computed from whole texts with built-in functions. Sequential
covering then grows rules one after the other: a rule is a conjunction of
thresholds; each step adds the condition of greatest information gain, found in
counts of (feature, bin, label) over the labelled rows that no earlier rule
covers; a rule is pruned on rows that did not grow it. The list becomes one
ordered ``CASE WHEN`` over the features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TMP, materialize

#: The base rules' bounds, and the characters that count as symbols.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
SPACE = "\\x20\\x09-\\x0D"

#: Labelled rows that rules are learned from at most (a hash of the id picks them).
TRAIN_ROWS = 20_000
BINS, MAX_RULES, MAX_CONDITIONS = 24, 12, 3
#: A rule rejects if so large a share of what it covers is labelled poor, in growing and in pruning rows, and it covers enough.
PRECISION, LEAST_COVERED = 0.9, 8
FEATURES = ("f_words", "f_word_chars", "f_symbols", "f_upper", "f_digits", "f_marks", "f_dup_lines", "f_repeats", "f_line_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.bound) if self.above else c <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


def _all(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often the lambda uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repeated_positions(h: Column) -> Column:
    """Of an array of hashes, the sorted places whose hash stands there more than once."""

    def from_sorted(s: Column) -> Column:
        def place(e: Column, i: Column) -> Column:
            same_before = (i > 0) & (F.get(s, i - 1)["h"] == e["h"])
            same_after = F.get(s, i + 1)["h"] == e["h"]
            return F.when(same_before | F.coalesce(same_after, F.lit(False)), e["i"])

        return F.array_sort(F.array_compact(F.transform(s, place)))

    return _let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), from_sorted)


def _covered(places: Column) -> Column:
    """How many places the 3-long windows at sorted ``places`` cover."""
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: long) and ``FEATURES`` (double) of every row."""
    text, words, grams = TMP + "text", TMP + "words", TMP + "grams"

    def count(chars: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))

    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias(text))
    df = df.withColumn(words, F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = df.withColumn(TMP + "lines", lines)
    df = df.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count(SYMBOLS.replace("|", "\\|")).cast("long").alias("n_symbols"),
        (F.size(TMP + "lines") - F.size(F.array_distinct(TMP + "lines"))).cast("long").alias("n_dup_lines"),
        F.size(TMP + "lines").alias(TMP + "n_lines"),
        count("A-Z").alias(TMP + "upper"),
        count("0-9").alias(TMP + "digits"),
        count("!?").alias(TMP + "marks"),
        F.when(F.size(words) < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 2)), lambda i: F.xxhash64(F.get(F.col(words), i - 1), F.get(F.col(words), i), F.get(F.col(words), i + 1))))
        .alias(grams),
    )
    repeated = F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_covered(_repeated_positions(F.col(grams))))
    df = df.withColumn("n_repeat_words", repeated.cast("long"))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    n_lines = F.greatest(F.col(TMP + "n_lines"), F.lit(1)).cast("double")
    values = (
        F.col("n_words").cast("double"), F.col("word_chars") / n, F.col("n_symbols") / n, F.col(TMP + "upper") / chars, F.col(TMP + "digits") / chars,
        F.col(TMP + "marks") / n, F.col("n_dup_lines") / n_lines, F.col("n_repeat_words") / n, F.col("n_words") / n_lines,
    )
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[v.alias(k) for v, k in zip(values, FEATURES, strict=True)])


def _bins(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate bounds of each feature: quantiles of all rows and of the poor ones."""
    marks = [i / BINS for i in range(1, BINS)]
    poor = [F.percentile_approx(F.when(F.col("poor") == 1, F.col(f)), marks, 2000).alias("p" + f) for f in FEATURES]
    got = rows.agg(*[F.percentile_approx(f, marks, 2000).alias(f) for f in FEATURES], *poor).first()
    return {f: sorted({float(x) for x in (got[f] or []) + (got["p" + f] or [])}) for f in FEATURES}


def _counts(rows: DataFrame, bins: dict[str, list[float]]) -> dict[tuple[str, int], list[int]]:
    """(feature, bin) to [good, poor] rows; bin i holds values over bound i - 1 and up to bound i."""
    each = []
    for f in FEATURES:
        if bins[f]:
            at = sum((F.when(F.col(f) > b, 1).otherwise(0) for b in bins[f]), F.lit(0))
            each.append(F.struct(F.lit(f).alias("f"), at.alias("b")))
    out: dict[tuple[str, int], list[int]] = {}
    for r in rows.select("poor", F.explode(F.array(*each)).alias("x")).groupBy("x.f", "x.b", "poor").count().collect():
        out.setdefault((r["f"], r["b"]), [0, 0])[r["poor"]] += r["count"]
    return out


def _best(counts: dict[tuple[str, int], list[int]], bins: dict[str, list[float]], used: list[Condition]) -> tuple[float, Condition | None, int, int]:
    """The condition of greatest FOIL gain: (gain, condition, good and poor rows that it leaves)."""
    found: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for f in FEATURES:
        cells = [counts.get((f, b), [0, 0]) for b in range(len(bins[f]) + 1)]
        good, poor = sum(c[0] for c in cells), sum(c[1] for c in cells)
        if not poor:
            continue
        base = math.log2(poor / (good + poor))
        low_good = low_poor = 0
        for b, bound in enumerate(bins[f]):
            low_good += cells[b][0]
            low_poor += cells[b][1]
            for above, g, p in ((False, low_good, low_poor), (True, good - low_good, poor - low_poor)):
                if p:
                    gain = p * (math.log2((p + 1) / (g + p + 2)) - base)
                    c = Condition(f, above, bound)
                    if gain > found[0] + 1e-9 and c not in used:
                        found = gain, c, g, p
    return found


def learn(rows: DataFrame) -> list[list[Condition]]:
    """The decision list for ``rows`` (FEATURES, poor 0/1, prune boolean): rules that reject, in order."""
    rules: list[list[Condition]] = []
    bins = _bins(rows)
    if not any(bins.values()):
        return rules
    left = rows
    while len(rules) < MAX_RULES:
        grow, rule, good, poor = left.where(~F.col("prune")), [], 1, 0
        while len(rule) < MAX_CONDITIONS and good:
            gain, condition, good_left, poor_left = _best(_counts(grow.where(_all(rule)), bins), bins, rule)
            if condition is None or poor_left < LEAST_COVERED / 2:
                break
            rule.append(condition)
            good, poor = good_left, poor_left
        if not rule:
            break
        # Prune: keep the shortest beginning that does not lose worth on the rows kept for it.
        sums = [F.sum(F.when(_all(rule[: i + 1]), F.col("poor") if y else 1 - F.col("poor")).otherwise(0)).alias(f"{'p' if y else 'g'}{i}") for i in range(len(rule)) for y in (0, 1)]
        both = {r["prune"]: r for r in left.groupBy("prune").agg(*sums).collect()}
        zero = {f"{k}{i}": 0 for k in "pg" for i in range(len(rule))}
        test, seen = both.get(True, zero), both.get(False, zero)
        worth = [((test[f"p{i}"] or 0) - (test[f"g{i}"] or 0)) / max(1, (test[f"p{i}"] or 0) + (test[f"g{i}"] or 0)) for i in range(len(rule))]
        keep = max(range(len(rule)), key=lambda i: (round(worth[i], 6), -i))
        p, g = (seen[f"p{keep}"] or 0) + (test[f"p{keep}"] or 0), (seen[f"g{keep}"] or 0) + (test[f"g{keep}"] or 0)
        if p + g < LEAST_COVERED or p / (p + g) < PRECISION:
            break
        rules.append(rule[: keep + 1])
        left = left.where(~_all(rules[-1]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that rejects the row, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(_all(rule), i) if out is None else out.when(_all(rule), i)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rule (the number of the learned rule that rejects, 0 for none) of every row.

    Rules are learned from rows with a label ``quality`` (0 or 1; the least of
    repeated labels counts), ``train_rows`` at most, that the base rules pass. A
    null text counts as empty and fails the base rules. Repeated rows each give
    a row; null ids have no label; without labels nothing but the base rules
    rejects. Equal 3-word windows are found by 64-bit hashes. An empty table
    gives an empty result; other columns are not read.
    """
    made = materialize(features(docs))
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("poor"))
    # The labels' sample has train_rows narrow rows at most, so it is broadcast.
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = made.where(~base_failed()).join(F.broadcast(some), "doc_id").select(*FEATURES, "poor", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"))
    rules = learn(materialize(rows))
    rule = verdict(rules).cast("int")
    out = made.withColumn("base_failed", base_failed()).withColumn("rule", rule)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
