"""SimHash near-duplicate detection with deletion-variant signatures.

1. Every text gets a 64-bit fingerprint: bit b is 1 if bit b is set in over
   half of the XXH64 hashes (seed 42) of its word shingles.
2. Rows with equal fingerprints are one node; only distinct fingerprints go on.
3. Two fingerprints that differ in at most ``max_bits`` bits, cut into
   ``max_bits // 2 + 1`` segments, agree in some segment up to one bit. So each
   segment is indexed once per bit position with that bit deleted: 64 keys a
   fingerprint in all. Equal keys are joined and the distance is verified in
   the join condition. A pair is emitted at its first common key only, so once.
4. Where there are so many fingerprints that a segment's 20 bits no longer part
   them, each key is refined: the other bits, cut into ``max_bits + 1`` blocks,
   agree in some block exactly, which adds 8 bits to the key for 5 times the keys.
   The links are the same.
5. What still shares a segment (and block) with very many is a dense group of
   near copies, which would be compared pairwise. Its members go another, exact way:
   fingerprints within ``max_bits`` of each other share a value at
   ``max_bits / 2`` flips or fewer from both, and all that share such a value
   are linked, so each links to the least of them: linear in the members.
6. Connected components by alternating large-star and small-star rounds; what is
   at most ``FEW_EDGES`` links, on the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TMP, arrow_map, materialize

BITS = 64
#: Distinct fingerprints with one exact segment value (and block, where keys are refined), from which they count as dense.
DENSE = 128
#: Distinct fingerprints from which keys are refined: there a segment value has 32 by chance, and far less than DENSE with a block.
REFINE = 1 << 26
#: Links of 16 bytes that are joined to components on the driver; more are in rounds of shuffles, which for a few links cost files and tasks only.
FEW_EDGES = 1 << 17
#: Parts in which the members of a component look up its id.
PARTS = 16
#: Shingles hashed into bit counts at a time.
STEP = 1 << 15


def simhash(text: str | None, words: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for null or a text without words.

    ``bytes.lower`` folds A-Z only and ``bytes.split`` splits at exactly space and \\x09-\\x0D.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist()
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        h = np.array([digest(flat[s:e], 42) for s, e in zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; ``fp`` is a signed long."""
    return arrow_map(
        docs.select("doc_id", "text"),
        [("fp", T.LongType())],
        lambda texts: [[simhash(t, words) for t in texts]],
        keep=["doc_id"],
    )


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, length) of the segments, one of which differs by at most one bit."""
    n = max_bits // 2 + 1
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _long(value: int) -> Column:
    value &= (1 << 64) - 1
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def _part(fp: Column, low: int, size: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(_long((1 << size) - 1))


def _variant(value: Column, low: int, bit: int) -> Column:
    """Key of a segment value with one bit deleted, with the bit's number in the low 6 bits."""
    return F.shiftleft(value.bitwiseAND(_long(~(1 << (bit - low)))), 6).bitwiseOR(_long(bit))


def _keys(nodes: DataFrame, cut: list[tuple[int, int]]) -> DataFrame:
    every = [_variant(_part(F.col("fp"), low, size), low, b) for low, size in cut for b in range(low, low + size)]
    return nodes.select("fp", F.explode(F.array(*every)).alias("key"))


def _blocks(low: int, size: int, max_bits: int) -> list[int]:
    """Masks of ``max_bits + 1`` blocks of the bits outside a segment."""
    other = [b for b in range(BITS) if not low <= b < low + size]
    n = max_bits + 1
    return [sum(1 << b for b in other[round(i * len(other) / n) : round((i + 1) * len(other) / n)]) for i in range(n)]


def _refined(keys: DataFrame, cut: list[tuple[int, int]], max_bits: int) -> DataFrame:
    """Keys of (fp, key) rows with a block of the other bits hashed in: the block's number in bits 6 to 9, the deleted bit below."""
    bit = F.col("key").bitwiseAND(_long(63)).cast("int")
    each = F.lit(None)
    for low, size in cut:
        made = [F.xxhash64("key", F.col("fp").bitwiseAND(_long(m))).bitwiseAND(_long(~1023)).bitwiseOR(F.lit(j << 6).cast("long")).bitwiseOR(bit.cast("long")) for j, m in enumerate(_blocks(low, size, max_bits))]
        each = F.when(bit.between(low, low + size - 1), F.array(*made)).otherwise(each)
    return keys.select("fp", F.explode(each).alias("key"))


def _first_common(x: Column, key: Column, cut: list[tuple[int, int]], refined: int = 0) -> Column:
    """True at the first key that fingerprints differing in the bits ``x`` share; ``refined`` is max_bits for refined keys."""
    bit = key.bitwiseAND(_long(63)).cast("int")
    block = F.shiftrightunsigned(key, 6).bitwiseAND(_long(15)).cast("int")
    found, before = F.lit(False), F.lit(True)
    for low, size in cut:
        part = x.bitwiseAND(_long(((1 << size) - 1) << low))
        here = bit.between(low, low + size - 1)
        # Equal segments share all variants: the lowest counts. Else only the one without the differing bit.
        at = ((part == 0) & (bit == low)) | ((F.bit_count(part) == 1) & (F.call_function("shiftrightunsigned", part, bit) == 1))
        if refined:
            first, none_yet = F.lit(False), F.lit(True)
            for j, m in enumerate(_blocks(low, size, refined)):
                same = x.bitwiseAND(_long(m)) == 0
                first = first | (none_yet & same & (block == j))
                none_yet = none_yet & ~same
            at = at & first
        found = found | (before & here & at)
        before = before & (F.bit_count(part) > 1)
    return found


def _dense_links(hot: DataFrame, max_bits: int) -> DataFrame:
    """Links among ``hot`` fingerprints by the values at ``max_bits / 2`` flips or fewer from them."""
    flips = [0] + [sum(1 << b for b in c) for r in range(1, (max_bits + 1) // 2 + 1) for c in combinations(range(BITS), r)]
    masks = F.array(*[_long(m) for m in flips])
    # Few rows, each of which becomes thousands: kept over all partitions.
    hot = hot.repartition(int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    near = hot.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))
    least = near.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = near.join(least, "key").where(F.col("fp") != F.col("a"))
    if max_bits % 2:  # an odd bound: what shares a value may differ by one bit more
        pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("a"))) <= max_bits)
    return pairs.select("a", F.col("fp").alias("b")).distinct()


def _groups(nodes: DataFrame, cut: list[tuple[int, int]], max_bits: int, refine: bool) -> DataFrame:
    """(fp, s, j, v): for each segment s (and block j of the other bits) the value v that the fingerprint has there."""
    each = []
    for i, (low, size) in enumerate(cut):
        value = _part(F.col("fp"), low, size)
        blocks = [F.xxhash64(value, F.col("fp").bitwiseAND(_long(m))) for m in _blocks(low, size, max_bits)] if refine else [value]
        each += [F.struct(F.lit(i).alias("s"), F.lit(j).alias("j"), v.alias("v")) for j, v in enumerate(blocks)]
    return nodes.select("fp", F.explode(F.array(*each)).alias("x")).select("fp", "x.*")


def links(nodes: DataFrame, max_bits: int = 4, dense: int = DENSE, refine: bool | None = None) -> DataFrame:
    """(a, b) with a < b among the distinct ``nodes.fp``: enough of the pairs at ``max_bits`` or fewer to connect all such pairs."""
    if max_bits % 2:
        dense = 1 << 62  # the dense way is exact for even bounds
    if refine is None:
        refine = nodes.count() > REFINE
    cut = segments(max_bits)

    def keyed(df: DataFrame) -> DataFrame:
        keys = _keys(df, cut)
        return _refined(keys, cut, max_bits) if refine else keys

    keys = keyed(nodes)
    groups = _groups(nodes, cut, max_bits, refine).groupBy("s", "j", "v").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"))
    hot = materialize(groups.where(F.col("n") > dense).select("s", "j", "fp"))
    found = None
    if hot.take(1):
        # A group's keys are those of any of its members, for this segment and block.
        bit = F.col("key").bitwiseAND(_long(63)).cast("int")
        block = F.shiftrightunsigned("key", 6).bitwiseAND(_long(15)).cast("int") if refine else F.lit(0)
        of = F.lit(len(cut))
        for i, (low, size) in enumerate(cut):
            of = F.when(bit.between(low, low + size - 1), i).otherwise(of)
        own = keyed(hot.select("fp").distinct()).select("fp", "key", of.alias("s"), block.alias("j"))
        hot_keys = own.join(hot, ["fp", "s", "j"], "left_semi").select("key").distinct()
        found = _dense_links(keys.join(hot_keys, "key", "left_semi").select("fp").distinct(), max_bits)
        keys = keys.join(hot_keys, "key", "left_anti")
    a, b = keys.withColumnsRenamed({"fp": "a"}), keys.withColumnsRenamed({"fp": "b"})
    x = F.col("a").bitwiseXOR(F.col("b"))
    ok = (F.col("a") < F.col("b")) & (F.bit_count(x) <= max_bits)
    first = _first_common(x, a["key"], cut, max_bits if refine else 0)
    pairs = a.join(b, (a["key"] == b["key"]) & ok & first).select("a", "b")
    return pairs if found is None else pairs.unionByName(found).distinct()


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, sorted, and of each the least node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        # Roots go below the least root that they have an edge to, then all nodes below their last root.
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, max_rounds: int = 60, few: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, which are longs; root is the least node of its component.

    Alternating large-star and small-star rounds, each written to the shared
    checkpoint folder; they end when the edges form stars. At most ``few`` edges
    (FEW_EDGES) are joined on the driver.
    """
    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    now = sign(edges)
    if now[0] <= (FEW_EDGES if few is None else few):
        got = edges.toArrow()
        nodes, root = roots(*(got[c].to_numpy() for c in "ab"))
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": root}))
    for _ in range(max_rounds):
        if not now[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        edges, before = materialize(small), now
        now = sign(edges)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the least
    doc_id reachable over links of at most ``max_bits`` differing bits.

    Null or empty texts, and texts without words, have fingerprint zero and are
    linked like any other. Repeated rows each give a row. Rows with a null
    doc_id take part; a component of nothing else has a null component_id. An
    empty table gives an empty result. Other columns are not read.
    """
    fps = materialize(fingerprints(docs, words))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = components(links(nodes.select("fp"), max_bits, dense))
    linked = materialize(nodes.join(comp, nodes.fp == comp.node).select("fp", "rep", "root"))
    # A component may hold a third of all rows, so its members look its id up in parts.
    part = TMP + "part"
    ids = linked.groupBy("root").agg(F.min("rep").alias("component_id")).withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    named = linked.withColumn(part, F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")).join(ids, ["root", part]).select("fp", "component_id")
    every = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = fps.join(every, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
