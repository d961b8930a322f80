"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations.

Each source is a task of its target weight w whose jobs are blocks of
``block_docs`` documents. Block j (from 0) is released at floor(j / w) and due at
ceil((j + 1) / w); in each slot the released block with the earliest deadline
goes. No block is late, and at any time each source is less than one block from
its target share of the slots, however many there are. When a source has given
its last block a new stretch begins, in which the others' weights are raised in
proportion.

Only the sources with their counts reach the driver (``MAX_SOURCES`` at most). It
goes through the slots once, one for ``block_docs`` documents and ``SLOTS`` about at most
at any size of the table, and hands them to Spark ``CHUNK`` at a time. Where the caller gives a ``period``, weights are
rounded to whole shares of so many slots and the schedule repeats; it goes to Spark as a small
table of the stretches, each with its slots of one period. Every document is
kept; documents get ranks within their source without bringing a source to one task.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TMP, materialize, unique_rows, with_rank

#: Documents of a block at least.
BLOCK_DOCS = 16
#: Sources at most; each one that ends costs the driver a step over those that are left.
MAX_SOURCES = 5000
#: Slots that the driver holds at a time, and slots at most: beyond, blocks have more documents, so that there are no more.
CHUNK, SLOTS = 1 << 18, 1 << 24
#: Slots (of about 32 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000
#: The column of ``with_positions`` that sorts the documents.
POSITION = TMP + "position"
#: A column of ``with_positions``' input that stands for the text: its xxhash64.
TEXT = TMP + "text"
#: Weights are whole shares of about this number, so that they are off by less than a block in 2^60 slots.
WHOLE = 1 << 60
#: Default weights: documents to this power, which evens out large and small sources.
POWER = 0.5


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of ``period`` slots, in proportion to ``weights``, at least one each (largest remainders)."""
    period = max(period, len(weights))
    total = sum(weights.values())
    free = period - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def pattern(share: dict[str, int]) -> list[str]:
    """One period's slots by earliest deadline first among released blocks; ties by source."""
    period = sum(share.values())
    coming = [(0, -(-period // n), s, 0) for s, n in share.items()]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    slots = []
    for t in range(period):
        while coming and coming[0][0] <= t:
            _, due, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        assert due > t, "a block is late"
        slots.append(s)
        if j + 1 < share[s]:
            heapq.heappush(coming, ((j + 1) * period // share[s], -(-(j + 2) * period // share[s]), s, j + 1))
    return slots


def schedule(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[dict]:
    """Stretches: source, its first block and number of blocks there, the stretch's first slot and period, and the source's slots of a period."""
    left = {s: n for s, n in blocks.items() if n > 0}
    given = dict.fromkeys(left, 0)
    stretches, start = [], 0
    while left:
        share = shares({s: weights[s] for s in left}, period) if len(left) > 1 else dict.fromkeys(left, 1)
        order, length = pattern(share), sum(share.values())
        slots: dict[str, list[int]] = {s: [] for s in left}
        for slot, s in enumerate(order):
            slots[s].append(slot)
        whole = min(left[s] // share[s] for s in left)
        part = dict.fromkeys(left, 0)
        # After the whole periods, the slots up to the one that some source's last block takes.
        ends = 0
        if all(left[s] > whole * share[s] for s in left):
            for slot, s in enumerate(order):
                part[s] += 1
                if left[s] == whole * share[s] + part[s]:
                    ends = slot + 1
                    break
        for s in list(left):
            n = whole * share[s] + part[s]
            if n:
                stretches.append({"source": s, "first": given[s], "blocks": n, "start": start, "length": length, "slots": slots[s]})
            given[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start += whole * length + ends
    return stretches


def turns(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[str]:
    """The source of each slot, by earliest deadline first among released blocks (ties by source) at the weights themselves."""
    left = {s: n for s, n in blocks.items() if n > 0}
    scale = max(weights[s] for s in left) if left else 1
    whole = {s: max(1, round(weights[s] / scale * WHOLE)) for s in left}
    while left:
        total = sum(whole[s] for s in left)
        coming = [(0, -(-total // whole[s]), s, 0) for s in left]
        heapq.heapify(coming)
        ready: list[tuple[int, str, int]] = []
        t, ended = 0, False
        while not ended:
            while coming and coming[0][0] <= t:
                _, due, s, j = heapq.heappop(coming)
                heapq.heappush(ready, (due, s, j))
            due, s, j = heapq.heappop(ready)
            assert due > t, "a block is late"
            yield s
            left[s] -= 1
            ended = not left[s]
            if not ended:
                heapq.heappush(coming, ((j + 1) * total // whole[s], -(-(j + 2) * total // whole[s]), s, j + 1))
            t += 1
        del left[s]


def _slot_table(docs: DataFrame, blocks: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """(__sx_of, __sx_nth, __sx_slot): the slot of every block of every source."""
    kind = "array<struct<source string, first long, slots array<long>>>"
    given = dict.fromkeys(blocks, 0)
    order = turns(blocks, weights)
    parts, start, total = [], 0, sum(blocks.values())
    while start < total or not parts:
        slots: dict[str, list[int]] = {}
        for t in range(start, min(start + CHUNK, total)):
            slots.setdefault(next(order), []).append(t)
        rows = [{"source": s, "first": given[s], "slots": x} for s, x in slots.items()]
        for s, x in slots.items():
            given[s] += len(x)
        each = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("r")).select("r.*")
        each = each.select(F.col("source").alias(TMP + "of"), "first", F.posexplode("slots").alias("pos", TMP + "slot"))
        parts.append(materialize(each.select(TMP + "of", (F.col("first") + F.col("pos")).alias(TMP + "nth"), TMP + "slot")))
        start += CHUNK
    return reduce(DataFrame.unionAll, parts)


def source_key(source: Column) -> Column:
    """The source's name, marked so that a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def with_positions(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int | None = None, period: int | None = None) -> DataFrame:
    """``docs`` with three more columns: ``__sx_block``, ``__sx_slot`` and ``__sx_position``."""
    key, at, block = TMP + "key", TMP + "rank", TMP + "block"
    first, blocks, start, length, slots = (TMP + c for c in ("first", "blocks", "start", "length", "slots"))
    keyed = docs.withColumn(key, source_key(F.col("source").cast("string")))
    sizes = {r[key]: r["count"] for r in keyed.groupBy(key).count().limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    given = None if weights is None else {"null" if s is None else f"={s}": w for s, w in weights.items()}
    if given is not None and (bad := [s for s in sizes if not given.get(s, 0) > 0]):
        raise ValueError(f"no positive weight for sources {sorted(bad)[:5]}")
    block_docs = block_docs or max(BLOCK_DOCS, -(-sum(sizes.values()) // SLOTS))
    counts, targets = {s: -(-n // block_docs) for s, n in sizes.items()}, given or {s: n**POWER for s, n in sizes.items()}
    by = F.xxhash64(*unique_rows(docs), F.col(TEXT) if TEXT in docs.columns else F.xxhash64("text") if "text" in docs.columns else F.lit(0))
    ranked = with_rank(keyed, [key], by, unique_rows(docs), at, sum(sizes.values())).withColumn(block, F.floor(F.col(at) / block_docs).cast("long"))
    position = F.col(TMP + "slot") * block_docs + F.col(at) % block_docs
    if period is None:
        table = _slot_table(docs, counts, targets)
        if sum(counts.values()) <= BROADCAST:
            table = F.broadcast(table)
        placed = ranked.join(table, (F.col(key) == F.col(TMP + "of")) & (F.col(block) == F.col(TMP + "nth")))
        return placed.withColumn(TMP + "position", position.cast("long")).select(*docs.columns, block, TMP + "slot", TMP + "position")
    stretches = schedule(counts, targets, period)
    # A period's slots for each stretch: small, whatever the number of documents.
    kind = "array<struct<source string, first long, blocks long, start long, length int, slots array<int>>>"
    table = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(stretches)), kind)).alias("r")).select(*[F.col(f"r.{c[len(TMP):]}").alias(c) for c in (first, blocks, start, length, slots)], F.col("r.source").alias(TMP + "of"))
    inside = (F.col(block) >= F.col(first)) & (F.col(block) < F.col(first) + F.col(blocks))
    placed = ranked.join(F.broadcast(table), (F.col(key) == F.col(TMP + "of")) & inside)
    nth, each = F.col(block) - F.col(first), F.size(slots)
    slot = F.col(start) + F.floor(nth / each) * F.col(length) + F.get(F.col(slots), (nth % each).cast("int"))
    return placed.withColumn(TMP + "slot", slot.cast("long")).withColumn(TMP + "position", position.cast("long")).select(*docs.columns, block, TMP + "slot", TMP + "position")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int | None = None, period: int | None = None) -> DataFrame:
    """(doc_id, source, block, slot, position) for every row of ``docs``: the order in which to read them.

    ``weights`` are the sources' targets (any positive numbers, None names the
    null source); by default documents to the power ``POWER``. ``position`` sorts
    the documents, is unique, and has gaps where a block is not full. Documents have a pseudo-random order within their source, by a
    hash of the row; rows equal in all of ``documents``' columns are
    interchangeable. Null ids and texts are rows like others; a null source is a
    source. An empty table gives an empty result. Other columns are not read.
    """
    placed = with_positions(docs, weights, block_docs, period)
    return placed.select("doc_id", "source", F.col(TMP + "block").alias("block"), F.col(TMP + "slot").alias("slot"), F.col(TMP + "position").alias("position"))


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int | None = None, period: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, laid out in mixed order: range partitions of ``position``, sorted."""
    position = TMP + "position"
    placed = with_positions(docs, weights, block_docs, period)
    return placed.repartitionByRange(position).sortWithinPartitions(position).select(*docs.columns)
