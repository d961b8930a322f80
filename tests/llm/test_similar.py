import random

import numpy as np

import corpus_pipeline as P
from sextant.llm import similar as S


def jaccard(a, b):
    a, b = (set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def planted(rng, groups, copies):
    """(group, text): texts of random words, and copies with some words changed, at similarities around 0.8 to 1."""
    out = []
    for g in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 400))]
        out.append((g, " ".join(words)))
        for _ in range(copies):
            new = list(words)
            for i in rng.sample(range(len(words)), max(1, int(len(words) * rng.choice([0.004, 0.01, 0.015, 0.02, 0.03])))):
                new[i] = f"x{rng.randrange(10**9)}"
            out.append((g, " ".join(new)))
    return out


def brute_groups(texts):
    n, root = len(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and texts[i][0] == texts[j][0] and jaccard(texts[i][1], texts[j][1]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(n)}


def test_shingles():
    for t in (None, "", " \n\t", "one", "A b C d", "a b c d e f", "x " * 40):
        w = (t or "").lower().split()
        assert len(S.shingles(t, 5)) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    assert S.shingles("A b", 5) == S.shingles("a  B", 5) and S.shingles(None, 5) == S.shingles(" ", 5)


def test_bits_follow_the_similarity():
    rng = random.Random(8)
    for least in (0.8, 0.9):
        share = []
        for _ in range(60):
            both = [rng.getrandbits(64) for _ in range(int(1000 * least))]
            own = [[rng.getrandbits(64) for _ in range(500 - int(500 * least))] for _ in range(2)]
            a, b = (S.bits(np.array(both + x, np.uint64), 4) for x in own)
            share.append(sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True)) / 256)
        assert abs(np.mean(share) - S.differ(least)) < 0.01


def test_segments_hold_the_recall_at_every_size():
    for nodes in (10, 10**5, 10**8, 10**11):
        width, segments = S.shape(nodes, 0.8)
        q = S.differ(0.8)
        one = (1 - q) ** width + width * q * (1 - q) ** (width - 1)
        assert 1 - (1 - one) ** segments >= S.RECALL and width * segments < 1 << 16


def test_stage_finds_copies_from_similarity_08(spark):
    # One copy a text, so that each pair counts for itself.
    rng = random.Random(4)
    texts = planted(rng, 400, 1)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    want = brute_groups(texts)
    pairs = {i + 1: jaccard(texts[i][1], texts[i + 1][1]) for i in range(0, 800, 2)}
    kept = {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}
    assert all(i in kept for i, r in want.items() if i == r)  # nothing below 0.8 goes
    for low, high, share in ((0.8, 0.85, 0.85), (0.85, 0.9, 0.93), (0.9, 1.01, 0.97)):
        some = [i for i, s in pairs.items() if low <= s < high]
        assert len(some) > 30 and sum(i not in kept for i in some) >= share * len(some)


def test_dense_groups_go_either_way(spark):
    rng = random.Random(6)
    texts = planted(rng, 2, 150) + planted(rng, 60, 1)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    ways = [{r.doc_id: r.component_id for r in S.similar_groups(docs, 5, 0.8, sampled, dense).collect()} for sampled, dense in ((1, 3), (1, 40), (16, 10**6))]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == len(texts)


def test_edge_rows(spark):
    rows = [(1, "", 7), (2, None, 7), (3, " \n", 7), (None, "a b", 7), (4, "a b", 7), (4, "a b", 8), (6, "A  b", 7), (5, "z y x w v", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = S.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    # One id with several texts: each group keeps one row. A group of null ids only keeps one too.
    same = spark.createDataFrame([(5, "a b"), (2, "a b"), (5, "A b"), (5, "c d"), (None, "a b"), (None, "x y"), (None, "X y"), (None, "x y")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text.lower()) for r in S.drop_similar(same).collect()), key=str) == [(2, "a b"), (5, "c d"), (None, "x y")]
    long = " ".join(f"w{i}" for i in range(200_000))
    assert S.drop_similar(spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")).count() == 1
    assert S.drop_similar(docs.where("false")).count() == 0


def test_no_similar_pair_is_left_out(spark):
    """Against all pairs, at similarities around 0.8, among texts that all hold one passage, and where a copy links only by another copy."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(40)]
    texts = [(0, " ".join(common + t.split() + common[: rng.randrange(40)])) for _, t in planted(rng, 60, 3)]
    base = [f"b{i}" for i in range(300)]
    for step in range(0, 120, 4):  # a chain: neighbours are similar, its ends are not
        texts.append((0, " ".join([f"n{i}" for i in range(step)] + base[step:])))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    want = brute_groups(texts)
    for sampled, dense in ((1, 3), (8, 3)):
        assert {r.doc_id: r.component_id for r in S.similar_groups(docs, 5, 0.8, sampled, dense).collect()} == want


def test_parity_maps_never_part_similar_sets():
    rng = np.random.default_rng(3)
    for m, n in ((1, 1), (60, 70), (64, 80), (500, 520), (1000, 1030)):
        x = np.unique(rng.integers(0, 2**64, n, np.uint64))
        y = np.concatenate((x[:m], rng.integers(0, 2**64, 9, np.uint64)))
        a, b = S.parity(x), S.parity(y)
        short, long = sorted((a, b), key=len)
        if len(long) > len(short):
            long = long[: len(short)] ^ long[len(short) :]
        assert len(short) == len(long) and sum(int(v & (2**64 - 1)).bit_count() for v in (short ^ long).tolist()) <= len(np.setxor1d(x, y))


def test_whole_sets_move_only_for_what_may_be_similar(spark, monkeypatch):
    """Texts that share half of their words are candidates by their prefixes, but no pair of them is read whole."""
    passage, seen, verified = " ".join(f"p{i}" for i in range(120)), [], S._verified
    texts = [f"{passage} " + " ".join(f"t{i}w{j}" for j in range(80)) for i in range(30)]
    texts.append(texts[0].rsplit(" ", 1)[0] + " other")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(S, "_verified", lambda docs, pairs, *a: (seen.append(pairs.count()), verified(docs, pairs, *a))[1])
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs, 5, 0.8, 1, 10**6).collect()}
    assert got == {i: i for i in range(30)} | {30: 0} and sum(seen) <= 2


def test_crowded_shingles_make_each_pair_and_miss_none(spark, monkeypatch):
    rng = random.Random(21)
    texts = [(0, t) for _, t in planted(rng, 1, 40)] + [(0, t) for _, t in planted(rng, 20, 1)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    want = brute_groups(texts)
    monkeypatch.setattr(S, "CROWDED", 1)
    monkeypatch.setattr(S, "FIRSTS", 2)
    assert {r.doc_id: r.component_id for r in S.similar_groups(docs, 5, 0.8, 1, 10**6).collect()} == want


def test_a_group_of_near_copies_leaves_few_pairs_to_the_last_turn(spark, monkeypatch):
    rng, counts, near = random.Random(9), [], S._near
    base, texts = [f"b{i}" for i in range(150)], []
    for _ in range(120):
        new = list(base)
        for i in rng.sample(range(150), rng.randint(1, 3)):
            new[i] = f"x{rng.randrange(10**9)}"
        texts.append((0, " ".join(new)))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(S, "_near", lambda pairs, *a: (counts.append(pairs.count()), near(pairs, *a))[1])
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs, 5, 0.8, 1, 10**6).collect()}
    assert got == brute_groups(texts)
    turns = list(counts)
    counts.clear()
    monkeypatch.setattr(S, "STARS", 0)
    assert {r.doc_id: r.component_id for r in S.similar_groups(docs, 5, 0.8, 1, 10**6).collect()} == got
    assert turns[-1] < counts[-1], (turns, counts)
