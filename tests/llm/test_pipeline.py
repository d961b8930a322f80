from collections import Counter

import corpus_pipeline as P
from sextant.llm import langid, packing, simhash
from sextant.llm.common import held_out

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id < 3"))
    tables = [docs]
    for _, stage in P.STAGES:
        tables.append(stage(spark, tables[-1], SF).cache())
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [t.collect() for t in tables]
    # Language: the model's own verdict on each text.
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    want = [r for r in rows[0] if model.predict(r.text)[0] != "und" and model.predict(r.text)[1] >= 0.5]
    assert Counter(rows[1]) == Counter(want)
    # Lines: of lines of eight words or more each stands in one document only, or in equal ones.
    lines = {}
    for r in rows[2]:
        for x in r.text.split("\n"):
            if len(x.split()) >= 8:
                lines.setdefault(x.strip(), set()).add(r.doc_id)
        assert r.n_chars == len(r.text)
    assert all(len(v) == 1 for v in lines.values())
    was = {x.strip() for r in rows[1] for x in r.text.split("\n") if len(x.split()) >= 8}
    assert was == set(lines)
    # Near copies: no two kept texts within four bits, every dropped one reaches a kept one.
    fps = {r.doc_id: simhash.simhash(r.text, 5) & (2**64 - 1) for r in rows[2]}
    kept = [r.doc_id for r in rows[3]]
    assert len(kept) == len(set(kept))
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4
    assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(near(d, e) for e in fps if e != d) for d in fps if d not in set(kept))
    # Mixing keeps all rows.
    assert Counter(rows[4]) == Counter(rows[3])
    # Packing: every document's tokens once, gapless sequences.
    tok = packing.encoder(P.tokenizer_path()).tokenizer
    pieces = {}
    for r in rows[5]:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(kept)
    for r in rows[4]:
        n = len(tok.encode(r.text, add_special_tokens=False).ids) + 1
        assert sum(x.length for x in pieces[r.doc_id]) == n


def test_run(spark):
    out = P.run(spark, SF)
    seqs = {}
    for r in out.collect():
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(n for s in seqs.values() for _, n in s)
    assert len(seqs) <= -(-total // 2048) + 1
