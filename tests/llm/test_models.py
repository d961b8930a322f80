"""Learned operators: held-out accuracy, exactness of search, and edge rows."""

import collections
import re
import zlib

import numpy as np

import __spark_entry__ as e
from sextant.llm import langid, quality, toxicity

SF, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def is_held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    got = e.queries()["op9_language_id"](spark, BIG).collect()
    assert len(got) == len(docs)
    right = collections.Counter((r.lang_pred == docs[r.doc_id].lang) for r in got if r.held_out)
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert right[True] / sum(right.values()) > 0.97


def test_language_edges(spark):
    rows = [(i, "the cat and the dog", "en", 0) for i in range(6)] + [(i, "der hund und die katze", "de", 0) for i in range(6, 12)] + [(20, None, "en", 0), (21, "", None, 0), (22, "123 !?", "de", 0), (None, "der hund", None, 0), (20, "the dog", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = collections.Counter((r.doc_id, r.lang_pred) for r in langid.identify(docs).collect())
    assert got[20, "und"] == got[21, "und"] == got[22, "und"] == got[None, "de"] == got[20, "en"] == 1
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 14
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None)).collect()} <= {"und"}
    assert langid.identify(docs.where("false")).count() == 0


def test_language_chunks_count_every_ngram():
    text = "abc déf " * 40
    old = langid.CHUNK_CHARS
    whole = np.sort(np.concatenate(list(langid.buckets(text))))
    try:
        langid.CHUNK_CHARS = 7
        cut = np.sort(np.concatenate(list(langid.buckets(text))))
    finally:
        langid.CHUNK_CHARS = old
    assert (whole == cut).all() and len(whole) == 3 * (len(text) + 1) - 3


def test_language_scores_against_plain_bayes(spark):
    rng = np.random.default_rng(2)
    words = {"en": ["the", "and", "cat", "dog"], "de": ["der", "und", "katze", "hund"], "fr": ["le", "et", "chat", "chien"]}
    rows = [(i, " ".join(rng.choice(words[k], 6)), k) for i, k in enumerate(["en", "de", "fr"] * 20)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), smoothing=0.5)
    size, counts = 1 << langid.BUCKET_BITS, {k: collections.Counter() for k in words}

    def grams(t):
        t, found = "\n" + t.lower(), []
        for order in (1, 2, 3):
            for i in range(len(t) - order + 1):
                h = 0
                for k, c in enumerate(t[i : i + order], 1):
                    h = (h * 0x01000193 + ord(c) + k) % 2**32
                found.append(h * 0x9E3779B1 % 2**32 >> 32 - langid.BUCKET_BITS)
        return found

    for _, t, k in rows:
        counts[k].update(grams(t))
    total = {k: sum(c.values()) + 0.5 * size for k, c in counts.items()}
    texts = [" ".join(rng.choice(sum(words.values(), []), n)) for n in (1, 2, 3, 5, 9) for _ in range(10)]
    old = langid.CELLS
    try:
        langid.CELLS = 100  # several parts
        got = m.predict_batch([None, *texts, "1 2"])
    finally:
        langid.CELLS = old
    assert got[0] == got[-1] == ("und", 0.0)
    for t, (lang, score) in zip(texts, got[1:-1], strict=True):
        logp = {k: np.log(1 / 3) + sum(np.log((counts[k][b] + 0.5) / total[k]) for b in grams(t)) for k in words}
        best = max(logp, key=logp.get)
        assert lang == best and abs(score - 1 / sum(np.exp(v - logp[best]) for v in logp.values())) < 1e-3


def plain_quality(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = collections.Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    base = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), base


def test_quality_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    got = e.queries()["op6_quality_rules"](spark, BIG).collect()
    assert len(got) == len(docs)
    seen = collections.Counter()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            seen[labels[r.doc_id], r.kept] += 1
    assert seen[1, True] >= 0.97 * (seen[1, True] + seen[1, False]) and seen[0, False] >= 0.8 * (seen[0, True] + seen[0, False])


def test_quality_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b c a b c", 0), (None, "x\n x\nx", 0), (4, "é|<é> " * 60, 0), (4, "é|<é> " * 60, 0), (5, "\x0b\x0ca\x1fb\x85c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(4, None)], "doc_id long, quality int")
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs, labels).collect()), key=str)
    assert got == sorted(((i, *plain_quality(t)) for i, t, _ in rows), key=str)
    assert quality.judge(docs.where("false"), labels).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        t = rng.choice(60, rng.integers(0, 8), replace=False)
        w = rng.random(len(t)) + 0.1
        w = w / np.sqrt((w * w).sum()) if len(t) else w
        vectors.append(dict(zip(t.tolist(), w.tolist(), strict=True)))
    index = toxicity.Index(vectors, block=16)
    for q in vectors[::7] + [{}, {99: 1.0}]:
        plain = sorted(((-sum(q.get(t, 0) * w for t, w in v.items()), i) for i, v in enumerate(vectors)))
        want = [(i, -s) for s, i in plain if s < 0][:10]
        got = index.search(q, 10)
        assert [round(s, 9) for _, s in got] == [round(s, 9) for _, s in want]
        assert all(abs(sum(q.get(t, 0) * w for t, w in vectors[i].items()) - s) < 1e-9 for i, s in got)


def test_toxicity_query(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = e.queries()["op7_toxicity_neighbours"](spark, d).collect()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    seen = collections.Counter((labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels)
    assert seen[1, 1] >= 0.85 * (seen[1, 1] + seen[1, 0]) and seen[0, 1] <= 0.02 * (seen[0, 0] + seen[0, 1])


def plain_terms(t):
    return collections.Counter(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))


def test_toxicity_neighbours_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    counts = {i: plain_terms(t) for i, t in docs.items()}
    first = {}
    for i in sorted(docs):
        if i in labels and not is_held_out(i):
            first.setdefault(docs[i], i)
    have, df = collections.Counter(), collections.Counter()
    for i in first.values():
        have.update(counts[i].keys())
    for c in counts.values():
        df.update(c.keys())
    n = len(docs)
    idf = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t, k in have.items() if k >= toxicity.LEAST and df[t] <= max(toxicity.LEAST, toxicity.STOP * n)}

    def unit(c):
        v = {t: (1 + np.log(k)) * idf[t] for t, k in c.items() if t in idf}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    examples = {i: unit(counts[i]) for i in first.values()}
    got = e.queries()["op7_toxicity_neighbours"](spark, SF).collect()
    assert len(got) == n and sum(bool(r.nearest) for r in got) > 0.9 * n
    for r in got:
        q = unit(counts[r.doc_id])
        cos = {i: sum(w * v.get(t, 0.0) for t, w in q.items()) for i, v in examples.items()}
        want = sorted((c for c in cos.values() if c > 1e-12), reverse=True)[: toxicity.SHOWN]
        assert np.allclose([cos[i] for i in r.nearest], want)
        assert set(r.evidence) <= {t for t in counts[r.doc_id]}


def test_toxicity_examples_are_distinct_texts(spark):
    rows = [(1, "you idiot fool"), (1, "kind words here"), (1, "you idiot fool"), (2, "you idiot fool"), (3, "kind words there"), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(1, 6)], "doc_id long, toxic int")
    old = toxicity.held_out
    try:
        toxicity.held_out = lambda c: c.isNull()
        m = toxicity.train(docs, labels)
    finally:
        toxicity.held_out = old
    assert sorted(zip(m.ids, m.labels.tolist(), strict=True)) == [(1, 1.0), (1, 1.0), (3, 0.0), (4, 0.0)]
    assert m.index.n == 4 and set(m.names) == {b"kind", b"words"}


def test_toxicity_edges(spark):
    rows = [(i, f"you idiot fool {i} some other words", 0) for i in range(40)] + [(i, f"kind words {i} some other words", 0) for i in range(40, 120)] + [(200, None, 0), (201, "", 0), (None, "you idiot fool", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows) and got[None].predicted == 1 and got[200].predicted == got[201].predicted == 0
    assert all(got[i].predicted == int(i < 40) for i in range(120))
    none = toxicity.classify(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.0} and toxicity.classify(docs.where("false"), labels).count() == 0
