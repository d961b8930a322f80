"""Exact pairs of vectors, the dedupe that rests on them, and the embedder, each against a plain loop."""

import random

import numpy as np
import pytest
import xxhash

from sextant.functions import near as N
from sextant.functions import vectors as V
from sextant.functions.analysis import TOKEN
from sextant.functions.providers import HashEmbedder
from sextant.operators.memory import Memory, similar_first
from sextant.sources import store as St


def plain_first(exact, threshold, out=()):
    """(row: the nearest before it that stays, or itself), row by row."""
    stay, onto = [], {}
    for i in range(len(exact)):
        if i in out:
            continue
        like = [j for j in stay if exact[i, j] >= threshold]
        onto[i] = max(like, key=lambda j: (exact[i, j], -j)) if like else i
        if not like:
            stay.append(i)
    return onto


@pytest.mark.parametrize("metric, threshold", [("cosine", 0.9), ("cosine", -0.2), ("euclidean", -0.3), ("euclidean", -30.0), ("dot", 0.9)])
def test_pairs_and_first(metric, threshold):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 30))
    m = np.concatenate([base[rng.integers(0, 60, 900)] + 0.25 * rng.normal(size=(900, 30)), base]).astype(np.float32)
    m = m if metric == "cosine" else 0.3 * m
    m[5] = 0
    exact = V.scores(m.astype(float), m.astype(float), metric)
    axes = N.turn(m)
    left, right = N.Side(m, axes, metric), N.Side(m, axes, metric, right=True)
    a, b = N.together(left), N.together(right)
    assert sorted(a) == list(range(len(m)))
    got = [(x, y) for i, j, _ in N.pairs(left.take(a), right.take(b), threshold) for x, y in zip(a[i], b[j], strict=True)]
    assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(exact >= threshold), strict=True))
    out = np.zeros(len(m), bool)
    out[::9] = True
    best = N.Best(len(m))
    stays = N.first_of(left, right, np.arange(len(m)), best, out, threshold, step=64)
    want = plain_first(exact, threshold, set(np.flatnonzero(out)))
    assert {i for i in want if want[i] == i} == set(np.flatnonzero(stays))
    assert all(exact[i, best.rank[i]] == pytest.approx(exact[i, j]) for i, j in want.items() if i != j)


def test_vectors_that_are_not_finite_are_like_none():
    m = np.array([[1, 0], [np.nan, 1], [np.inf, 1], [1, 0]], np.float32)
    for metric, threshold in (("cosine", 0.5), ("euclidean", -0.1), ("dot", 0.5)):
        side, right = (N.Side(m, np.eye(2), metric, right=r) for r in (False, True))
        assert {(int(i), int(j)) for x, y, _ in N.pairs(side, right, threshold) for i, j in zip(x, y, strict=True)} == {(0, 0), (0, 3), (3, 0), (3, 3)}


def test_no_pair_at_the_threshold_is_left_out(spark):
    """Pairs just at the threshold, over several blocks: none is left to chance, and each goes onto the nearest."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    m = np.concatenate([base, 0.9501 * base + np.sqrt(1 - 0.9501**2) * side]).astype(np.float32)
    exact = V.unit(m.astype(float)) @ V.unit(m.astype(float)).T
    rows = [(i, (f"{i:05}", 0), v.tolist()) for i, v in enumerate(m)]
    nodes = spark.createDataFrame(rows, "node long, place struct<id:string,h:long>, vector array<float>")
    live = spark.createDataFrame([("old", m[7].tolist()), ("older", m[8].tolist())], "id string, vector array<float>")
    got = {r.node: r.onto for r in similar_first(nodes, live, 0.95, "cosine").collect()}
    gone = {i: "old" if exact[i, 7] >= exact[i, 8] else "older" for i in range(len(m)) if max(exact[i, 7], exact[i, 8]) >= 0.95}
    want = {i: f"{j:05}" for i, j in plain_first(exact, 0.95, gone).items()} | gone
    assert sum(want[i] != f"{i:05}" for i in want) >= 1500 and got == want
    got = {r.node: r.onto for r in similar_first(nodes, live, 0.95, "cosine", block=700).collect()}
    assert got == want


def test_embedder_hashes_words_and_pairs():
    def plain(text, dim):
        words = [m[0].lower() for m in TOKEN.finditer(text or "")]
        v = np.zeros(dim)
        for feature in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
            h = xxhash.xxh64_intdigest(feature)
            v[h % dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(v)
        return (v / norm if norm else v).astype(np.float32).tolist()

    rng = random.Random(4)
    odd = "aAbBσΣςİıßéÉ \n\t.,'-_0９٣𝟘漢́̇‍­:\x00\ud800"
    texts = ["", None, "  ", "a", "İstanbul ΑΣ ΣΑΣ Σ, ὈΔΥΣΣΕΎΣ x", "x" * 31 + " " + "y" * 32 + " " + "z" * 100, "½ Ⅻ ⓐ ǅ", " lead", "trail "]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(90))) for _ in range(500)]
    for dim in (64, 7):
        assert HashEmbedder(dim).embed_batch(texts) == [plain(t, dim) for t in texts]
    assert HashEmbedder(7).embed_batch([]) == []


def test_only_the_attributes_asked_for_move(spark, tmp_path):
    store = St.Store(spark, f"file://{tmp_path}/o", 2)
    store.upsert(spark.createDataFrame([("a", "long text", 1), ("b", "more text", 2)], "id string, body string, n int"), "k")
    store.reinforce("k", ["a"], 50)
    keys = lambda **how: {r.id: set(r.attrs) for r in store.records(["k"], **how).collect()}
    assert keys() == {"a": {"body", "n", St.COUNT, St.ACCESSED}, "b": {"body", "n"}}
    assert keys(only=["n"]) == {"a": {"n"}, "b": {"n"}} and keys(only=[St.COUNT]) == {"a": {St.COUNT}, "b": set()}
    assert keys(without=["body", St.ACCESSED]) == {"a": {"n", St.COUNT}, "b": {"n"}}


def test_dedupe_keeps_what_the_record_had(spark, tmp_path):
    """Onto a record that is there: its other attributes and its time of creation stay, its text and expiry don't."""
    m = Memory(St.Store(spark, f"file://{tmp_path}/h", 64), "notes")
    m.remember(spark.createDataFrame([("a", "the cat sat on the mat", "pets")], "id string, text string, topic string"), 1000, ttl_seconds=100, summarize=True)
    m.remember(spark.createDataFrame([("b", "The cat sat on the mat!"), ("b", "The cat sat on the mat!"), ("c", "stock prices fell")], "id string, text string"), 2000, dedupe_threshold=0.95)
    got = {r.id: {k: v.s or v.i for k, v in r.attrs.items()} for r in m.store.records().collect()}
    assert got == {
        "a": {"topic": "pets", "mem_summary": "the cat sat on the mat", "mem_text": "The cat sat on the mat!", St.CREATED: 1000, St.UPDATED: 2000},
        "c": {"mem_text": "stock prices fell", St.CREATED: 2000, St.UPDATED: 2000},
    }


def test_texts_of_a_deduped_call_move_once(spark, tmp_path):
    m, plans = Memory(St.Store(spark, f"file://{tmp_path}/p", 64), "notes"), []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m.store.upsert = lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or 0
        m.remember(spark.createDataFrame([("a", "the cat sat on the mat"), ("b", "stock prices fell")], "id string, text string"), 1000, dedupe_threshold=0.95)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans[0].count("Exchange hashpartitioning(") == 3  # of texts by their place, of the places that win, of vectors
