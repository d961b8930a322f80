import corpus_pipeline as P
from sextant.llm import mixing as M
from sextant.llm import packing as K
from test_layout import check_packing


def test_sequences_follow_the_weights(spark):
    # Source a has 9600 documents and b 2400, so weights are as 2 to 1: b ends after 7200 documents.
    docs = spark.range(12000).selectExpr("id doc_id", "IF(id % 5 = 0, 'b', 'a') source", "repeat('word ', int(20 + id * 7919 % 400)) text")
    rows = P.best_fit_packing(spark, docs, "").collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    last = max(r.sequence_id for r in rows) + 1
    for low, high, want in ((0, 0.25, 1 / 3), (0.25, 0.5, 1 / 3), (0.7, 1, 0)):
        part = [r.doc_id % 5 == 0 for r in rows if low * last <= r.sequence_id < high * last]
        assert abs(sum(part) / len(part) - want) < 0.06


def test_windows(spark):
    texts = {i: "word " * (i * 37 % 90) for i in range(300)} | {300: None, 301: ""}
    docs = spark.createDataFrame([(d, t, "s") for d, t in texts.items()], "doc_id long, text string, source string")
    placed = M.with_positions(K.tokenize_rows(docs, P.tokenizer_path(), 64))
    rows = K.pack_in_order(placed, M.POSITION, 64, 32).collect()
    n, least = check_packing(rows, texts, 64)
    assert {r.sequence_id for r in rows} == set(range(n))
    at = {r.doc_id: r[M.POSITION] // 32 for r in placed.collect()}
    by = sorted((r.sequence_id, at[r.doc_id]) for r in rows)
    assert [w for _, w in by] == sorted(w for _, w in by)
    assert K.pack_in_order(placed.where("false"), M.POSITION).count() == 0
