"""Line dedup by winnowing over line hashes, in DataFrame operations.

1. Lines with a word are hashed (surrounding white space aside).
2. Winnowing: for each line, the shortest run from it that holds ``words`` words
   is a window; the line of the least hash in it (the last of equals) is an
   anchor. A line of ``words`` words is its own window, so always an anchor.
3. The fingerprint of an anchor is the hash of the shortest run from it that
   holds ``words`` words. A repeated run of 2 x ``words`` - 1 words or more, and
   a repeated line of ``words`` or more, always share one.
4. Each fingerprint is joined to its earliest place: documents in order of their
   id (null last, then by a hash of the text), then lines.
5. A later match is extended both ways while lines are equal, over the short
   lines beside it; longer lines are anchors and have matches of their own.
6. The lines of later matches are deleted, with blank lines inside them.

Only hashes and line numbers are shuffled for matching. The earliest place of a
fingerprint comes from partial aggregates, so a line of a third of all documents
meets in no single task, and no pair of two later places is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TMP, materialize

WORDS = 8
#: Fixed value: the characters between words.
SPACE = " \t\n\x0b\x0c\r"

ID, HASH, LINES = TMP + "id", TMP + "hash", TMP + "lines"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often the lambda uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _indices(n: Column) -> Column:
    """0 to n - 1; none for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _full_lines(text: Column) -> Column:
    """Lines with a word: their number i, hash h and number of words n."""

    def line(x: Column, i: Column) -> Column:
        return _let(F.btrim(x, F.lit(SPACE)), lambda t: F.struct(i.alias("i"), F.xxhash64(t).alias("h"), F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).alias("n")))

    return F.filter(F.transform(F.split(text, "\n"), line), lambda x: x["n"] > 0)


def _anchors(lines: Column, words: int) -> Column:
    """Places in ``lines`` that are the least of some window."""
    top = F.lit((1 << 63) - 1)

    def least(j: Column) -> Column:
        start = F.struct(F.lit(0).alias("s"), top.alias("h"), F.lit(-1).alias("p"), j.alias("k"))

        def step(a: Column, x: Column) -> Column:
            lower = x["h"] <= a["h"]
            more = F.struct((a["s"] + x["n"]).alias("s"), F.least(x["h"], a["h"]).alias("h"), F.when(lower, a["k"]).otherwise(a["p"]).alias("p"), (a["k"] + 1).alias("k"))
            return F.when(a["s"] >= words, a).otherwise(more)

        return F.aggregate(F.slice(lines, j + 1, words), start, step, lambda a: F.when(a["s"] >= words, a["p"]))

    return F.array_distinct(F.array_compact(F.transform(_indices(F.size(lines)), least)))


def _beside(lines: Column, words: int) -> Column:
    """The (h, i) of the lines from the first on, while they are short."""
    start = F.struct(F.array().cast("array<struct<h:bigint,i:int>>").alias("got"), F.lit(True).alias("on"))

    def step(a: Column, x: Column) -> Column:
        on = a["on"] & (x["n"] < words)
        return F.struct(F.when(on, F.concat(a["got"], F.array(F.struct(x["h"].alias("h"), x["i"].alias("i"))))).otherwise(a["got"]).alias("got"), on.alias("on"))

    return F.aggregate(lines, start, step, lambda a: a["got"])


def _fingerprint(lines: Column, p: Column, words: int) -> Column:
    """Of the anchor at ``p``: hash g, first and last line number of its run, the short lines before (nearest first) and after."""
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("g"), p.alias("e"))

    def step(a: Column, x: Column) -> Column:
        more = F.struct((a["s"] + x["n"]).alias("s"), F.xxhash64(a["g"], x["h"]).alias("g"), (a["e"] + 1).alias("e"))
        return F.when(a["s"] >= words, a).otherwise(more)

    def made(run: Column) -> Column:
        low = F.greatest(F.lit(0), p - 2 * words)
        return F.when(
            run["s"] >= words,
            F.struct(
                run["g"].alias("g"),
                F.get(lines, p)["i"].alias("first"),
                F.get(lines, run["e"] - 1)["i"].alias("last"),
                _beside(F.reverse(F.slice(lines, low + 1, p - low)), words).alias("before"),
                _beside(F.slice(lines, run["e"] + 1, F.lit(2 * words)), words).alias("after"),
            ),
        )

    return _let(F.aggregate(F.slice(lines, p + 1, words), start, step), made)


def _equal(a: Column, b: Column) -> Column:
    """How many (h, i) at the beginning of two arrays have equal h."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(same, start, lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def _reach(lines: Column, n: Column, otherwise: Column) -> Column:
    return F.when(n > 0, F.get(lines, n - 1)["i"]).otherwise(otherwise)


def repeated_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(__sx_id, __sx_hash, __sx_lines): per document with repeats, the numbers of its lines to delete, sorted.

    ``__sx_hash`` is the hash of the text; with the id it names a row (rows equal in both are one).
    """
    rows = docs.select(F.col("doc_id").alias(ID), F.xxhash64("text").alias(HASH), _full_lines(F.col("text")).alias(LINES)).where(F.size(LINES) > 0)
    # Both projections use the arrays several times, so the optimizer keeps them apart.
    rows = rows.select(ID, HASH, LINES, _anchors(F.col(LINES), words).alias("anchors"))
    marks = F.array_compact(F.transform("anchors", lambda p: _fingerprint(F.col(LINES), p, words)))
    prints = materialize(rows.select(ID, HASH, F.explode(marks).alias("m")).select(F.struct(F.col(ID).isNull().alias("z"), F.col(ID).alias("id"), F.col(HASH).alias("h"), F.col("m.first").alias("at")).alias("place"), "m.*"))
    # Written, so that the join has exchanges of its own and a hot fingerprint's partition can be split.
    first = materialize(prints.groupBy("g").agg(F.min(F.struct("place", "before", "after")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "o"))
    later = prints.join(first, "g").where(F.col("place") > F.col("o.place"))
    back, on = _equal(F.col("before"), F.col("o.before")), _equal(F.col("after"), F.col("o.after"))
    runs = later.select("place.id", "place.h", F.sequence(_reach(F.col("before"), back, F.col("first")), _reach(F.col("after"), on, F.col("last"))).alias("run"))
    return runs.groupBy(F.col("id").alias(ID), F.col("h").alias(HASH)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("run")))).alias(LINES))


def deduplicate(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, removed) for every row of ``docs``.

    ``text`` is without the lines of repeated runs; ``removed`` has their
    numbers, from 0. Null texts stay null, with no lines; empty texts have one.
    Rows equal in id and text count as one document, so they keep their lines
    alike. Null ids come after all others. An empty table gives an empty result;
    other columns are not read.
    """
    return _joined(docs.select("doc_id", "text"), words).select(
        "doc_id",
        _without(F.col("text"), F.col(LINES)).alias("text"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(LINES), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(LINES, F.array().cast("array<int>")).alias("removed"),
    )


def _joined(docs: DataFrame, words: int) -> DataFrame:
    runs = repeated_runs(docs, words)
    keyed = docs.withColumn(HASH, F.xxhash64("text"))
    return keyed.join(runs, keyed["doc_id"].eqNullSafe(runs[ID]) & (keyed[HASH] == runs[HASH]), "left").drop(runs[HASH])


def _without(text: Column, removed: Column) -> Column:
    def cut(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(_indices(F.size(lines)), removed), lambda i: F.get(lines, i)), "\n")

    return F.when(removed.isNull(), text).otherwise(_let(F.split(text, "\n"), cut))


def drop_repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated runs cut from ``text``; rows that lose their last word go.

    A column ``n_chars`` is brought up to date. Rows without words, null texts
    among them, stay as they are.
    """
    done = _joined(docs, words)
    new = TMP + "new"
    done = done.withColumn(new, _without(F.col("text"), F.col(LINES)))
    done = done.where(F.col(LINES).isNull() | (F.btrim(F.col(new), F.lit(SPACE)) != ""))
    columns = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(LINES).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return done.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])
