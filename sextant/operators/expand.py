"""Neighbour expansion and rollup of chunked records."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import SearchOptions

#: Attributes that chunked records carry.
TEXT, PARENT, INDEX, START = "mem_text", "mem_parent_id", "mem_chunk_index", "mem_char_start"


def stitch(pieces: Column) -> Column:
    """One text of pieces (index, text, start) in index order.

    What a piece repeats of the source text before it is left out; pieces that
    follow on directly are joined as they are; where there is a gap, or a start is
    unknown, a blank line stands between. NULL if nothing is left.
    """
    zero = F.struct(F.lit("").alias("text"), F.lit(None).cast("bigint").alias("upto"))

    def step(a: Column, p: Column) -> Column:
        start, size = p["start"].cast("bigint"), F.length(p["text"]).cast("bigint")
        known = start.isNotNull() & a["upto"].isNotNull()
        skip = F.when(known & (start < a["upto"]), a["upto"] - start).otherwise(F.lit(0).cast("bigint"))
        body = F.substring(p["text"], (skip + 1).cast("int"), F.greatest(size - skip, F.lit(0)).cast("int"))
        joined = F.when(known & (start <= a["upto"]), F.concat(a["text"], body)).when(a["text"] == "", p["text"]).otherwise(F.concat(a["text"], F.lit("\n\n"), p["text"]))
        new = F.struct(joined.alias("text"), F.coalesce(F.greatest(a["upto"], start + size), start + size).alias("upto"))
        return F.when((size == 0) | size.isNull(), a).otherwise(new)

    out = F.aggregate(F.array_sort(pieces), zero, step, lambda a: a["text"])
    return F.when(out != "", out)


def expand(hits: DataFrame, records: DataFrame, radius: int, text: str = TEXT, parent: str = PARENT, index: str = INDEX, start: str | None = START) -> DataFrame:
    """``hits`` with ``context``: the texts of the chunks at most ``radius`` before and after each, stitched.

    Hits without a parent or an index have no context; radius 0 gives a hit's own
    text. The page of hits is joined to the records of its parents by (collection,
    parent), so the records are scanned once and hits are never added or dropped.
    """
    own = hits.select("collection", "id", F.col(parent).alias("__p"), F.col(index).cast("int").alias("__i")).where("__p is not null and __i is not null")
    places = own.select("collection", "id", "__p", F.explode(F.sequence(F.col("__i") - radius, F.col("__i") + radius)).alias("__n"))
    at = F.col(start).cast("bigint") if start else F.lit(None).cast("bigint")
    chunks = records.select("collection", F.col(parent).alias("__p"), F.col(index).cast("int").alias("__n"), F.struct(F.col(index).cast("int").alias("index"), F.coalesce(F.col(text), F.lit("")).alias("text"), at.alias("start")).alias("__c")).where("__p is not null and __n is not null")
    near = places.join(chunks, ["collection", "__p", "__n"]).groupBy("collection", "id").agg(stitch(F.collect_list("__c")).alias("context"))
    return hits.join(near, ["collection", "id"], "left")


def rollup(opts: SearchOptions, per_parent: int = 1, parent: str = PARENT) -> SearchOptions:
    """Search options that keep at most ``per_parent`` chunks of a document; ``expand`` then adds their neighbours."""
    return replace(opts, limit_per=(parent, max(1, per_parent)))
