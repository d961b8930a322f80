"""Fingerprints, mixing and packing against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as e
from sextant.llm import fingerprint as X
from sextant.llm import mixing as M
from sextant.llm import packing as K
from sextant.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def plain_pairs(docs):
    """docs: (doc_id, text) -> rows of the contract that don't depend on the method."""
    order = sorted(docs, key=lambda r: -r[0])
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        yield d, len(t), t[: len(t) - half] + nxt[:half], t, nxt


def jaccard(a, b):
    a, b = X.terms(a), X.terms(b)
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_fingerprint_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in e.queries()["op8_weighted_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    errors, by_text = [], {}
    for d, n, changed, text, nxt in plain_pairs(docs):
        r = got[d]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - jaccard(text, changed), r.near_next - jaccard(text, nxt)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_fingerprint_buckets_and_edges(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(50)]
    rows = [(i * 3 % 2503, " ".join(rng.choices(words, k=rng.randint(0, 30))) or None, "x") for i in range(2503)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(7)
    got = {r.doc_id: r for r in X.compare_with_edited(docs, 16).collect()}
    assert len(got) == len(rows)
    for d, n, changed, _, _ in plain_pairs([r[:2] for r in rows]):
        assert (got[d].n_chars, got[d].edited_sha256) == (n, hashlib.sha256(changed.encode()).hexdigest())
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, "d"), (2, "")], "doc_id long, text string")
    rows = X.compare_with_edited(odd, 16).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, None: 2, 2: 1}
    one = X.compare_with_edited(odd.where("doc_id = 2"), 16).collect()
    assert (one[0].near_edited, one[0].near_next) == (1.0, 1.0) and X.compare_with_edited(odd.where("false"), 16).count() == 0


def test_schedule_is_pfair():
    rng = random.Random(2)
    for _ in range(20):
        n = rng.randint(1, 8)
        blocks = {f"s{i}": rng.randint(1, 400) for i in range(n)}
        weights = {s: rng.random() + 0.05 for s in blocks}
        period = rng.choice([10, 97, 1000])
        slots = {}
        ends = Counter()
        for x in M.schedule(blocks, weights, period):
            each = len(x["slots"])
            for j in range(x["blocks"]):
                slot = x["start"] + j // each * x["length"] + x["slots"][j % each]
                assert slot not in slots
                slots[slot] = x["source"]
            assert x["first"] == ends[x["source"]]
            ends[x["source"]] += x["blocks"]
        assert dict(ends) == blocks and sorted(slots) == list(range(sum(blocks.values())))
        # Until the first source runs out: less than one block from the share.
        share = M.shares(weights, max(period, n)) if n > 1 else {"s0": 1}
        total, given = sum(share.values()), Counter()
        for t in range(len(slots)):
            given[slots[t]] += 1
            assert all(abs(given[s] - (t + 1) * share[s] / total) < 1 for s in blocks)
            if any(given[s] == blocks[s] for s in blocks):
                break


def test_mixing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = e.queries()["op5_source_mixing"](spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert len({r.position for r in got}) == len(got)
    by = {}
    for r in got:
        assert r.position // M.BLOCK_DOCS == r.slot
        by.setdefault((r.source, r.block), []).append(r.position)
    assert all(len(v) <= M.BLOCK_DOCS and len({p // M.BLOCK_DOCS for p in v}) == 1 for v in by.values())


def test_mixing_edges(spark):
    rows = [(i, "t", None if i % 3 else "a", i) for i in range(500)] + [(7, "t", "a", 7), (7, "t", "a", 7), (None, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    got = M.mix(docs, {"a": 3, None: 1, "b": 1}, block_docs=4).collect()
    assert len(got) == len(rows) == len({r.position for r in got})
    first = Counter(r.source for r in sorted(got, key=lambda r: r.position)[:160])
    # The only row of b goes first; then a and the null source share by 3 to 1.
    assert abs(first["a"] - 160 * 3 / 4) < 8
    laid = M.in_mixed_order(docs)
    assert laid.columns == docs.columns and laid.count() == len(rows) and M.mix(docs.where("false")).count() == 0


def check_packing(rows, texts, size):
    tok = K.encoder(tokenizer_path()).tokenizer
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    seqs, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for d, ps in pieces.items():
        ps.sort(key=lambda p: p.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and sum(p.length for p in ps) == len(ids[d])
        assert all(p.length == size for p in ps[1:]) and (len(ids[d]) > size or len(ps) == 1)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= size
    assert set(pieces) == set(texts)
    return len(seqs), -(-sum(map(len, ids.values())) // size)


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, least = check_packing(e.queries()["op10_best_fit_packing"](spark, SF).collect(), texts, 2048)
    assert n <= least + 1


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 400, 4: "a", 5: "é\n\n  x\t y"}
    docs = spark.createDataFrame([(d, t, 0) for d, t in texts.items()], "doc_id long, text string, length int")
    check_packing(K.pack(docs, tokenizer_path(), 32).collect(), texts, 32)
    assert K.pack(docs.where("false"), tokenizer_path()).count() == 0
    twice = K.pack(docs.unionByName(docs), tokenizer_path(), 32).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


def test_plan_holds_every_piece():
    rng = np.random.default_rng(3)
    for scale in (1, 40):
        counts = np.zeros(129, np.int64)
        for v in rng.integers(1, 129, 300):
            counts[v] += scale
        done, seen = K.plan(counts, 128), np.zeros(129, np.int64)
        for lengths, n in done:
            assert sum(lengths) <= 128
            for v in lengths:
                seen[v] += n
        assert (seen == counts).all()
        assert sum(n for _, n in done) <= sum(n for _, n in K.best_fit(counts, 128))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_patterns_place_most_pieces(sf):
    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    enc = K.encoder(tokenizer_path())
    counts = np.bincount([n for t in texts for _, n in K.cuts(len(enc.encode(t or "")) + 1, 2048)], minlength=2049)
    rows = K.patterns(np.nonzero(counts)[0], 2048)
    x = K.fit(rows, counts.astype(float))
    fitted = sum(np.bincount(c, x, 2049) for c in rows.T)
    assert np.abs((fitted - counts)[1:]).sum() < 0.05 * counts.sum()
    done, left = K.rounded(rows, x, counts, 2048)
    assert all(sum(p) == 2048 for p, _ in done) and left.sum() <= 0.25 * counts.sum()
    assert sum(n for _, n in K.plan(counts, 2048)) == sum(n for _, n in done) + sum(n for _, n in K.best_fit(left, 2048))
    # No more sequences than best fit alone takes, and within one of the least number.
    n = sum(n for _, n in done) + sum(n for _, n in K.best_fit(left, 2048))
    assert n <= sum(n for _, n in K.best_fit(counts, 2048)) and n <= -(-int(counts @ np.arange(2049)) // 2048) + 1


def test_encoder_equals_the_tokenizer():
    enc, rng = K.Encoder(tokenizer_path()), random.Random(1)
    assert enc.fast
    parts = ["a", "the", " ", " ", "\n", "\t", "'s", ".", "1", "é", "<|endoftext|>", "\u3000", "\0", "\r\n", " a b", "\nx"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()] + [" " * 1_000_000, "a" * 100_000]
    for s in texts:
        assert enc.encode(s).tolist() == enc.tokenizer.encode(s, add_special_tokens=False).ids


def test_other_vocabularies_go_through_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = K.Encoder(path)
    assert enc.fast is None and enc.encode("The cat sat.").tolist() == enc.tokenizer.encode("The cat sat.", add_special_tokens=False).ids
