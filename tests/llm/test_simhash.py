import random

import numpy as np
import pytest
import xxhash

from sextant.llm import simhash as S


def brute_fp(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(pairs):
    """pairs: (doc_id, fp); the least id reachable at 4 bits or fewer."""
    n, root = len(pairs), list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = np.array([p[1] for p in pairs], dtype=np.uint64)
    for i in range(n):
        for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= 4)[0]:
            root[find(i)] = find(int(j))
    least = {}
    for i in range(n):
        r = find(i)
        least[r] = min(least.get(r, pairs[i][0]), pairs[i][0])
    return {pairs[i][0]: least[find(i)] for i in range(n)}


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "a b c", "A b c É d e", "x " * 9, "the cat SAT on the mat " * 50])
def test_fingerprint(text):
    assert S.simhash(text) & (2**64 - 1) == brute_fp(text)


def test_query_against_brute_force(spark):
    import __spark_entry__ as e

    rows = e.queries()["op1_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = [(d.doc_id, brute_fp(d.text)) for d in docs]
    comp = brute_components(want)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{f:016x}", comp[i]) for i, f in want}


@pytest.mark.parametrize(("dense", "refine"), [(512, False), (20, False), (512, True), (20, True), (3, True)])
def test_links_and_components(spark, dense, refine):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    for _ in range(250):  # a dense group, chained outwards
        fps.add(centre)
        c = rng.choice(sorted(fps)) if rng.random() < 0.3 else centre
        for _ in range(rng.randint(1, 5)):
            c ^= 1 << rng.randrange(64)
        fps.add(c)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs = S.links(nodes, 4, dense, refine)
    if dense == 512:
        every = {(a, b) for i, a in enumerate(signed) for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
        rows = [(r.a, r.b) for r in pairs.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == every
    got = {r.node: r.root for r in S.components(pairs).collect()}
    want = brute_components(list(zip(signed, fps, strict=True)))
    assert {f: got.get(f, f) for f in signed} == want


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    """A round writes a table and six shuffles, however few the links are; at 211 partitions those files were most of the disk."""
    rng, written, materialize = random.Random(5), [], S.materialize
    chain = rng.sample(range(-(10**18), 10**18), 400)  # needs several rounds
    some = list(zip(chain, chain[1:], strict=False)) + [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(7, 7), (None, 3)]
    edges = spark.createDataFrame(some, "a long, b long")
    monkeypatch.setattr(S, "materialize", lambda df: (written.append(df.columns), materialize(df))[1])
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert written == [["a", "b"]]
    assert got == {r.node: r.root for r in S.components(edges, few=0).collect()} and len(written) > 4
    assert all(got[c] == min(chain) for c in chain) and all(got[a] == got[b] and got[a] <= a for a, b in some[:-2] if a != b)
    none = S.components(edges.where("a is null"))
    assert none.columns == ["node", "root"] and not none.collect()


def test_edge_rows(spark):
    rows = [(1, "", 7), (2, None, 7), (None, "a b", 7), (4, "a b", 7), (4, "a b", 7), (5, "z y x w v", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 4), (4, 4), (4, 4), (5, 5)], key=str)
    assert S.near_duplicates(docs.where("false")).count() == 0
