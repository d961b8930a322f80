"""Near-dedup by the exact Jaccard similarity of word shingles, SimHash first.

1. A text's shingles are its distinct runs of ``words`` words (all words, if
   fewer), as 64-bit hashes. Texts equal in their bytes are one node.
2. ``simhash.links`` joins the nodes' 64-bit fingerprints at ``FEW_BITS``. What is
   similar to the least node of its component there is in one group with it. That
   only saves work: every node takes part in what follows.
3. All similar pairs share a prefix: with shingles in one order for all texts, the rarest
   first, two sets at similarity t have a common shingle among the first
   n - ceil(t n) + 1 of the larger and the first n - ceil(2 t / (1 + t) n) + 1 of the smaller.
   So only prefixes are joined, and no pair is missed. The order is by counts in
   a sample of the nodes; the sample chooses how many candidates there are, not the result.
4. A candidate's places in both prefixes bound its common shingles, and so do the sizes;
   what cannot reach t is dropped in the join.
5. Shingles that several nodes have are looked at in turns: first each node with the
   first of its shingle, then, in ``STARS`` turns, with one chosen anew for each shingle, so that
   what shares several shingles meets as many others; then, with what is similar merged, only nodes of different
   groups, the largest group of a shingle against the others: a dense group of near copies costs
   its size and not its square. Of the crowded shingles that two nodes share the first makes the pair.
6. A node's ``parity`` map has a bit for each class of hashes, about as many as it has shingles: whether it
   has an odd number there. Two maps differ in no more bits than the sets differ in shingles, so
   a pair whose maps differ in more than t allows is not similar. All but about the similar pairs end
   here, at an eighth to a quarter of a byte a shingle; only what is left moves whole sets.
7. Pairs are verified by the exact similarity of their shingle sets, one pair of
   each node first, then those whose nodes are not in one group by then. Groups
   are the connected components (``simhash.components``).
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import TMP, arrow_map, materialize
from .linededup import SPACE
from .simhash import BITS, _long, components, links

#: Probability that a pair at the least similarity shares a key; one at 0.85 in place of 0.8 then does with 0.98, at 0.9 with 0.998.
RECALL = 0.95
#: Bits in which the fingerprints of the first step's pairs differ at most; bits of a segment at least.
FEW_BITS, LEAST_WIDTH = 4, 16
#: A shingle that in one of SAMPLED nodes is found more often than DENSE times comes later in the order; of at most ORDERED shingles.
SAMPLED, DENSE, ORDERED = 8, 3, 500_000
#: Nodes of the sample at most, about.
SAMPLE_NODES = 50_000
#: Nodes with one shingle from which it is crowded; of the crowded shingles of a node so many are known to its other rows.
CROWDED, FIRSTS = 8, 64
#: Turns in which each node is held against one chosen node of each of its shingles, before pairs are made: of a group of near copies little is left to pair then.
STARS = 2
#: Rows of 8 bytes that may be broadcast; more are joined by a shuffle.
BROADCAST = 500_000
#: Shingles hashed into bit counts at a time.
STEP = 1 << 14


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of the shingles, sorted; A-Z are folded and words end at space and \\x09-\\x0D. Without words, the one of the empty text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    flat = b" ".join(parts)
    at = np.cumsum([0] + [len(p) + 1 for p in parts]).tolist()
    n = max(1, len(parts) - words + 1)
    last = [at[min(i + words, len(parts))] - 1 for i in range(n)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[s : max(e, 0)], 42) for s, e in zip(at, last, strict=False)], np.uint64))


def bits(hashes: np.ndarray, longs: int) -> list[int]:
    """``longs`` signed 64-bit fingerprints of a set: a bit is 1 if it is set in over half of the mixed hashes."""
    counts = np.zeros((longs, BITS), np.int64)
    for at in range(0, len(hashes), STEP):
        h = hashes[at : at + STEP]
        for i in range(longs):
            x = (h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
            counts[i] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), axis=1).view(np.int64).ravel().tolist()


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bit for each class of the hashes modulo the least power of two that is 64 and as many as they are: 1 if an odd number is in it."""
    size = max(BITS, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differ(similarity: float) -> float:
    """The probability that a bit of two sets of one size at a Jaccard similarity differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shape(nodes: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a segment, segments) for so many nodes."""
    width = max(LEAST_WIDTH, math.ceil(math.log2(max(2, nodes))) - 2)
    q = differ(least)
    one = (1 - q) ** width + width * q * (1 - q) ** (width - 1)
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def _node(text: Column) -> Column:
    """Hash of the text; texts without a word have the one of the empty text."""
    return F.xxhash64(F.when(F.btrim(text, F.lit(SPACE)) != "", text).otherwise(""))


def ordered(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes by their counts in the sorted ``common`` ones, those that are not there first, then by themselves."""
    if not len(common):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.lexsort((hashes, np.where(common[at] == hashes, counts[at], 0)))]


def prefix(n: int, least: float) -> tuple[int, int]:
    """How many first shingles of ``n`` a set shares one of with all that are similar: with smaller ones, and with larger ones."""
    return n - math.ceil(least * n - 1e-9) + 1, n - math.ceil(2 * least / (1 + least) * n - 1e-9) + 1


def _counts(docs: DataFrame, words: int, sampled: int, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that more than ``dense`` nodes of a sample have, and their counts."""
    some = docs.select(_node(F.col("text")).alias("node"), "text").where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(sampled)) == 0).dropDuplicates(["node"])
    made = arrow_map(some, [("h", T.ArrayType(T.LongType()))], lambda ns, ts: [[shingles(t, words).view(np.int64) for t in ts]])
    got = made.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).orderBy(F.desc("n"), "h").limit(ORDERED).toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def _small(df: DataFrame) -> DataFrame:
    """The materialized narrow ``df``, marked for a broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _near(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that can be similar by the sizes and parity maps of ``nodes`` (node, n, map)."""
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("map").alias(m)) for c, n, m in (("a", "m", "x"), ("b", "n", "y")))
    small, large, size = F.least("m", "n"), F.greatest("m", "n"), F.least(F.size("x"), F.size("y"))
    both = pairs.join(y, "b").join(x, "a").where(small >= F.lit(least) * large - 1e-9)

    def folded(c: str) -> Column:
        # Sets of which one may be 1.25 times the other have maps of one size, or of twice the size: its halves fold into the map of half the size.
        halves = F.zip_with(F.slice(c, 1, size), F.slice(c, size + 1, size), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(c) > size, halves).otherwise(F.col(c))

    apart = F.aggregate(F.zip_with(folded("x"), folded("y"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return materialize(both.where(apart <= F.lit((1 - least) / (1 + least)) * (F.col("m") + F.col("n")) + 1e-9).select("a", "b"))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) at similarity ``least`` or more, exactly."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= F.lit(least) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the ``pairs`` (a, b) of nodes that are similar; only their texts are read."""
    pairs = materialize(pairs)
    wanted = _small(materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    texts = docs.select(_node(F.col("text")).alias("node"), "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    sets = materialize(arrow_map(texts.select("node", "text"), [("set", T.ArrayType(T.LongType()))], lambda ts: [[shingles(t, words).view(np.int64) for t in ts]], keep=["node"]))
    return materialize(_similar(pairs, sets, least))


def _in_rounds(pairs: DataFrame, verify) -> DataFrame:
    """``verify`` of the node pairs, first for one pair of each node, then for those that are not in one group by then."""
    pairs = materialize(pairs)
    one = verify(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    group = components(one)
    roots = [group.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab"]
    apart = pairs.join(roots[0], "a", "left").join(roots[1], "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    return one.unionByName(verify(apart.join(one, ["a", "b"], "left_anti").select("a", "b")))


def _possible(least: float) -> Column:
    """Of the sets of ``m`` and ``n`` shingles (m <= n, by size and then node), which share those at the places ``j`` and ``i``: whether they can be similar."""
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("m") + F.col("n")) - 1e-9)
    # At the first shingle that both have, which is in both prefixes, only what follows it can be common too.
    most = 1 + F.least(F.col("m") - F.col("j") - 1, F.col("n") - F.col("i") - 1)
    order = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b")))
    return order & (F.col("m") >= F.lit(least) * F.col("n") - 1e-9) & (most >= need)


def _prefix_pairs(nodes: DataFrame, groups: DataFrame, least: float, verify) -> DataFrame:
    """(a, b): links that connect all similar pairs of ``nodes`` (node, n, prefix, map), given the ``groups`` (node, root) that are known."""
    rows = nodes.select("node", F.col("n").alias("size"), F.posexplode("prefix").alias("at", "key"))
    size = F.col("size")
    short = size - F.ceil(F.lit(2 * least / (1 + least)) * size - 1e-9) + 1
    # What only one node has, or only in its longer prefix, is of no use.
    rows = rows.withColumn("inner", (F.col("at") < short).cast("int"))
    both = Window.partitionBy("key")
    kept = rows.withColumn("k", F.count(F.lit(1)).over(both)).withColumn("in", F.max("inner").over(both)).where("k > 1 and in = 1").drop("k", "in")
    kept = materialize(kept)

    def sides(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        a = rows.where("inner = 1").select("key", F.col("node").alias("a"), F.col("size").alias("m"), F.col("at").alias("j"), *[F.col(c).alias(c + "a") for c in more])
        b = rows.select("key", F.col("node").alias("b"), F.col("size").alias("n"), F.col("at").alias("i"), *[F.col(c).alias(c + "b") for c in more])
        return a, b

    def named(rows: DataFrame, links: DataFrame) -> DataFrame:
        return rows.join(links.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    # First each node with the smallest of its shingle.
    now = materialize(named(kept, groups))
    heads = now.where("inner = 1").groupBy("key").agg(F.min(F.struct("size", "node", "at", "root")).alias("h"))
    heads = heads.select("key", F.col("h.node").alias("a"), F.col("h.size").alias("m"), F.col("h.at").alias("j"), F.col("h.root").alias("roota"))
    stars = heads.join(sides(now, "root")[1], "key").where(_possible(least) & (F.col("roota") != F.col("rootb"))).select("a", "b").distinct()
    found = _in_rounds(_near(stars, nodes, least), verify)
    # The smallest is often the same for all shingles of a group, so then others, at most a pair for each row again.
    old = groups.select(F.col("root").alias("a"), F.col("node").alias("b"))
    mine = F.struct("size", "node", "at", "inner", "root")
    for turn in range(STARS):
        now = materialize(named(kept, components(old.unionByName(found))))
        heads = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("by"), mine.alias("h"))).alias("h")).select("key", F.col("h.h").alias("h"))
        both = now.select("key", mine.alias("x")).join(heads, "key").where("x.root <> h.root").select(F.least("x", "h").alias("x"), F.greatest("x", "h").alias("y")).where("x.inner = 1")
        both = both.select(*[F.col(of).alias(c) for c, of in (("a", "x.node"), ("m", "x.size"), ("j", "x.at"), ("b", "y.node"), ("n", "y.size"), ("i", "y.at"))])
        found = found.unionByName(_in_rounds(_near(both.where(_possible(least)).select("a", "b").distinct(), nodes, least), verify))
    # Then what is not in one group yet.
    now = materialize(named(kept, components(old.unionByName(found))))
    sizes = now.groupBy("key", "root").count()
    mixed = sizes.groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("count").alias("rows")).where("kinds > 1").select("key", F.col("top.root").alias("top"), (F.col("rows") > CROWDED).alias("crowded"))
    open_ = materialize(now.join(mixed, "key").withColumn("other", (F.col("root") != F.col("top")).cast("int")))
    # A pair that shares several crowded shingles is made at the first of them, as the order is one for all: a row has its node's crowded shingles before it, of the first.
    firsts = open_.where("crowded").groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "key"))), 1, FIRSTS).alias("firsts"))
    before = F.transform(F.filter("firsts", lambda x: x["at"] < F.col("at")), lambda x: x["key"])
    open_ = open_.join(firsts, "node", "left").withColumn("before", F.when(F.col("crowded"), before)).drop("firsts")
    open_ = materialize(open_)
    ways = []
    for x, y in ((1, 1), (1, 0), (0, 1)):  # never the largest group against itself
        a, b = sides(open_, "root", "other", "before")
        a, b = a.where(F.col("othera") == x), b.where(F.col("otherb") == y)
        again = F.coalesce(F.arrays_overlap("beforea", "beforeb"), F.lit(False))
        ways.append(a.join(b, "key").where((F.col("roota") != F.col("rootb")) & _possible(least) & ~again).select("a", "b"))
    return found.unionByName(_in_rounds(_near(ways[0].unionByName(ways[1]).unionByName(ways[2]).distinct(), nodes, least), verify))


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, sampled: int = SAMPLED, dense: int = DENSE) -> DataFrame:
    """(doc_id, node, component_id, component_node) for every row of ``docs``: the least doc_id (null last), and then node, reachable over links of similarity ``least`` or more."""
    common, counts = _counts(docs, words, max(sampled, docs.count() // SAMPLE_NODES) if sampled > 1 else 1, dense)
    shared = docs.sparkSession.sparkContext.broadcast((common, counts))

    def marked(texts: list) -> list[list]:
        fps, sizes, firsts, maps = [], [], [], []
        for t in texts:
            h = shingles(t, words)
            fps.append(bits(h, 1)[0])
            sizes.append(len(h))
            firsts.append(ordered(h, *shared.value)[: prefix(len(h), least)[0]].view(np.int64))
            maps.append(parity(h))
        return [fps, sizes, firsts, maps]

    rows = docs.select("doc_id", _node(F.col("text")).alias("node"), "text")
    marks = arrow_map(
        rows,
        [("fp", T.LongType()), ("n", T.IntegerType()), ("prefix", T.ArrayType(T.LongType())), ("map", T.ArrayType(T.LongType()))],
        marked,
        keep=["doc_id", "node"],
    )
    nodes = materialize(
        marks.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node"))).alias("rep"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("prefix").alias("prefix"), F.min("map").alias("map"))
    )
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("node")))

    def verify(pairs: DataFrame) -> DataFrame:
        return _verified(docs, pairs, words, least)

    # Of each component of near-identical fingerprints the texts are held against that of the least only: a pair for each, not for each link.
    few = components(links(heads.select("fp"), FEW_BITS)).where("node <> root")
    one, two = heads.select(F.col("fp").alias("root"), F.col("node").alias("a")), heads.select("fp", F.col("node").alias("b"))
    stars = few.withColumnRenamed("node", "fp").join(one, "root").join(two, "fp").select("a", "b")
    same = nodes.select("fp", F.col("node").alias("b")).join(one.withColumnRenamed("root", "fp"), "fp").where("a <> b").select("a", "b")
    found = verify(_near(stars.unionByName(same), nodes, least))
    # What is like its component's least is in its group; all go on, as each may be like something else.
    found = found.unionByName(_prefix_pairs(nodes.select("node", "n", "prefix", "map"), components(found), least, verify))

    groups = components(found)
    roots = nodes.join(groups, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    ids = roots.groupBy("root").agg(F.min("rep").alias("rep"))
    named = roots.join(ids.withColumnRenamed("rep", "least"), "root").select("node", F.col("least.id").alias("component_id"), F.col("least.node").alias("component_node"))
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component_id", "component_node")


def drop_similar(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, of which one in each group of similar texts stays: the least doc_id (null last), then the least hash of the text.

    All texts at similarity ``least`` or more are linked, and nothing below it is. Of rows equal in id and text
    one stays, whatever their other columns hold. Rows without any word are one
    group. An empty table gives an empty result.
    """
    row, n = TMP + "row", TMP + "n"
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("component_node"))
    groups = similar_groups(docs, words, least)
    # Most rows stay, so the few that don't, and the few that stand several times, are looked up.
    kinds = groups.groupBy(F.xxhash64("doc_id", "node").alias(row)).agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias(n))
    odd = materialize(kinds.where(~F.col("stays") | (F.col(n) > 1)).select(row, "stays"))
    keyed = docs.withColumn(row, F.xxhash64("doc_id", _node(F.col("text"))))
    plain = keyed.join(_small(odd), row, "left_anti")
    again = keyed.join(_small(odd.where("stays")), row, "left_semi").dropDuplicates([row])
    return plain.unionByName(again).select(*docs.columns)
