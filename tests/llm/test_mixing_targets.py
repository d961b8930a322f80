from collections import Counter

import numpy as np
import pytest

from sextant.llm import mixing as M


@pytest.mark.parametrize(("n", "hot"), [(3, 1 / 7), (20, 0.2), (100, 1 / 3), (400, 0.1)])
def test_within_a_block_of_the_targets(n, hot):
    weights = {"hot": hot} | {f"s{i}": (1 - hot) / (n - 1) for i in range(1, n)}
    total, steps = 40_000, np.arange(1, 40_001)
    order = M.turns(dict.fromkeys(weights, total), weights)
    slots = [next(order) for _ in range(total)]
    for s in ("hot", "s1", f"s{n - 1}"):
        given = np.cumsum([x == s for x in slots])
        assert np.abs(given - steps * weights[s]).max() < 1 + 1e-9  # the weights are floats


def test_query_follows_the_targets(spark):
    n = 600  # more sources than one old schedule took
    docs = spark.range(120_000).selectExpr("id doc_id", f"CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % {n}) END source", "'t' text")
    names = [r.source for r in docs.select("source").distinct().collect()]
    weights = {s: 0.2 if s == "hot" else 0.8 / (len(names) - 1) for s in names}
    rows = sorted({(r.slot, r.source, r.block) for r in M.mix(docs, weights, block_docs=4).collect()})
    assert [r[0] for r in rows] == list(range(len(rows)))
    left = Counter(r[1] for r in rows)
    given = Counter()
    for t, (_, s, block) in enumerate(rows, 1):
        assert block == given[s]
        given[s] += 1
        assert abs(given["hot"] - t * weights["hot"]) < 1 + 1e-9
        if given[s] == left[s]:
            break
    assert t > 2000
