"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

A bounded set of labelled examples, one for each distinct text, is indexed by
all terms that two or more of them have. Terms are weighted by counts and by
document frequency over the whole corpus. For a text the blocks' upper bounds
are summed from per-block maxima; blocks are scored exactly until none that is
left can reach the k nearest. The neighbours vote with weights that grow with
their cosine, on each term that they share with the text; the terms on which
they agree most for label 1 are the evidence, and their mean vote is calibrated
by isotonic regression on the examples' own leave-one-out votes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, held_out, materialize

#: Labelled examples of each class at most (a hash of the id picks them).
EXAMPLES = 2000
#: Examples that a term needs, and the share of the corpus's documents from which on it weighs nothing.
LEAST, STOP = 2, 0.5
NEIGHBOURS, BLOCK, FULL = 100, 128, 16
#: Votes of the prior that smooth a term's votes, and terms whose votes count.
SMOOTH, EVIDENCE = 5.0, 3
#: Neighbours that are returned by id.
SHOWN = 10
#: Texts whose scores are begun in one product.
TOGETHER = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> Counter:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased, as bytes, with their counts."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, size), one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Index:
    """Block-max inverted index of unit vectors. Rows keep the order given; blocks are runs of rows.

    Postings are sorted by term and row, so those of a term in a block are one
    run; each run has its block, its place and its greatest weight. Terms of at
    least one row in ``FULL`` have a full row of weights instead: their part of the
    scores is one product, known for all rows before the blocks are bounded.
    """

    def __init__(self, vectors: list[dict[int, float]], block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.blocks = max(1, -(-self.n // block))
        n_terms = max((max(v, default=-1) for v in vectors), default=-1) + 1
        term = np.array([t for v in vectors for t in v], np.int64)
        row = np.repeat(np.arange(self.n), [len(v) for v in vectors])
        weight = np.array([w for v in vectors for w in v.values()])
        often = np.bincount(term, minlength=n_terms) * FULL >= max(1, self.n)
        self.full_of = np.where(often, np.cumsum(often) - 1, -1)
        self.full = np.zeros((int(often.sum()), self.n))
        rare = ~often[term]
        self.full[self.full_of[term[~rare]], row[~rare]] = weight[~rare]
        term, row, weight = term[rare], row[rare], weight[rare]
        order = np.lexsort((row, term))
        self.row, self.weight = row[order], weight[order]
        key = term[order] * self.blocks + self.row // block
        self.start = np.nonzero(np.diff(key, prepend=-1))[0]  # of the runs
        self.size = np.diff(self.start, append=len(key))
        self.top = np.maximum.reduceat(self.weight, self.start) if len(key) else np.zeros(0)
        self.of = key[self.start] % self.blocks
        self.first = np.searchsorted(key[self.start], np.arange(n_terms + 1) * self.blocks)  # of a term's runs
        self.edges = np.arange(0, self.n, block)

    def begun(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(queries x rows): the scores' part of the terms with full rows, for several queries (terms, weights) together."""
        dense = np.zeros((len(queries), len(self.full)))
        for i, (ids, weights) in enumerate(queries):
            known = ids < len(self.full_of)
            full = self.full_of[ids[known]]
            dense[i, full[full >= 0]] = weights[known][full >= 0]
        return dense @ self.full

    def near(self, ids: np.ndarray, weights: np.ndarray, k: int, without: int = -1, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list]:
        """(rows, cosines) of the k greatest positive cosines, by descending cosine and then row; and what was read, for ``shared``."""
        at = np.nonzero(ids < len(self.full_of))[0]
        if not len(at) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0), []
        scores = self.begun([(ids, weights)])[0] if begun is None else begun
        full = self.full_of[ids[at]]
        often = at[full >= 0], full[full >= 0]
        at = at[full < 0]
        sizes = self.first[ids[at] + 1] - self.first[ids[at]]
        runs, by = _ranges(self.first[ids[at]], sizes), np.repeat(at, sizes)
        block = self.of[runs]
        bound = np.bincount(block, weights[by] * self.top[runs], self.blocks) + np.maximum.reduceat(scores, self.edges)
        done = np.zeros(self.n, bool)
        read = [often]

        def score(chosen: np.ndarray) -> None:
            mine = chosen[block]
            n = self.size[runs[mine]]
            post, of = _ranges(self.start[runs[mine]], n), np.repeat(by[mine], n)
            row = self.row[post]
            np.add(scores, np.bincount(row, weights[of] * self.weight[post], self.n), out=scores)
            read.append((of, row))
            done[np.repeat(chosen, self.block)[: self.n]] = True
            if without >= 0:
                scores[without] = 0.0

        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bound, kind="stable")[: 2 * k // self.block + 1]] = True
        score(first)
        known = scores[done]
        kth = np.partition(known, -k)[-k] if len(known) >= k else 0.0
        rest = ~first & (bound > 0) & (bound >= kth - 1e-12)
        if rest.any():
            score(rest)
        found = np.nonzero((scores > 0) & done)[0]
        found = found[np.lexsort((found, -scores[found]))][:k]
        return found, scores[found], read

    def shared(self, rows: np.ndarray, read: list, strength: np.ndarray, labels: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of a query's ``n`` terms the sums of ``strength`` and of ``strength`` x ``labels`` over those of ``rows`` that have it."""
        (often, full), *sparse = read
        by_row = np.zeros(self.n)
        by_row[rows] = strength
        total, marked = np.zeros(n), np.zeros(n)
        for of, row in sparse:
            got = by_row[row]
            use = np.nonzero(got)[0]
            of, got = of[use], got[use]
            total += np.bincount(of, got, n)
            marked += np.bincount(of, got * labels[row[use]], n)
        have = self.full[full[:, None], rows] > 0
        total[often], marked[often] = (have @ np.column_stack([strength, strength * labels[rows]])).T
        return total, marked

    def search(self, query: dict[int, float], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[int, float]]:
        """The k rows of the greatest positive cosine, (row, cosine), by descending cosine and then row; exact."""
        rows, scores, _ = self.near(np.array(list(query), np.int64), np.array(list(query.values()), float), k, without)
        return list(zip(rows.tolist(), scores.tolist(), strict=True))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators: (thresholds, values), each value from its threshold on."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([x[i], y[i] * weight[i], weight[i]])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            at, s, w = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += w
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """The index with its vocabulary, labels and calibration."""

    def __init__(self, vocabulary: dict[bytes, int], idf: np.ndarray, examples: list[tuple[int, int, dict[bytes, int]]], weights: dict[int, float]):
        self.vocabulary, self.idf, self.names = vocabulary, idf, sorted(vocabulary, key=vocabulary.__getitem__)
        rows = [(i, y, *self.vector(t)) for i, y, t in examples]
        # Rows that share their strongest term come together, which keeps block bounds tight.
        rows.sort(key=lambda r: (int(r[2][r[3].argmax()]) if len(r[2]) else -1, r[0]))
        self.ids, self.labels = [r[0] for r in rows], np.array([r[1] for r in rows], float)
        self.index = Index([dict(zip(r[2].tolist(), r[3].tolist(), strict=True)) for r in rows])
        # A class of which a sample was taken counts for all of it; on average an example weighs one.
        w = np.array([weights[int(y)] for y in self.labels])
        self.weight = w / w.mean() if len(w) else w
        self.prior = float((self.weight * self.labels).mean()) if len(w) else 0.0
        own = []
        for at in range(0, len(rows), TOGETHER):
            some = [r[2:] for r in rows[at : at + TOGETHER]]
            own += [self.vote(*v, at + i, b)[0] for i, (v, b) in enumerate(zip(some, self.index.begun(some), strict=True))]
        none = np.array([v is None for v in own], bool)
        self.blank = (float((self.weight * self.labels)[none].sum()) + self.prior) / (float(self.weight[none].sum()) + 1) if len(w) else 0.0
        votes = np.array([v for v in own if v is not None])
        self.at, self.value = isotonic(votes, self.labels[~none], self.weight[~none]) if len(votes) else (np.zeros(0), np.zeros(0))

    def vector(self, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of the unit TF-IDF vector over the vocabulary; (1 + ln(count)) x IDF per term."""
        ids = np.fromiter(map(self.vocabulary.get, counts, repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), float, len(counts))[ids >= 0]
        ids = ids[ids >= 0]
        v = (1 + np.log(n)) * self.idf[ids] if len(ids) else n
        ids, v = ids[v > 0], v[v > 0]
        return ids, v / np.sqrt((v * v).sum()) if len(v) else v

    def vote(self, ids: np.ndarray, weights: np.ndarray, without: int = -1, begun: np.ndarray | None = None) -> tuple[float | None, np.ndarray, np.ndarray]:
        """(mean vote on the evidence, None without neighbours; the neighbours' rows; places in ``ids`` by falling vote).

        The vote on a term is the share of label 1 among the neighbours that have
        it, each weighted by its cosine, and smoothed by the prior.
        """
        rows, cosines, read = self.index.near(ids, weights, NEIGHBOURS, without, begun)
        if not len(rows):
            return None, rows, rows
        n, a = self.index.shared(rows, read, self.weight[rows] * cosines / cosines.mean(), self.labels, len(ids))
        votes = (a + SMOOTH * self.prior) / (n + SMOOTH)
        order = np.lexsort((ids, -votes))
        best = votes[order[:EVIDENCE]]
        return float(np.append(best, [self.prior] * (EVIDENCE - len(best))).mean()), rows, order

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[str]]]:
        """(calibrated score, ids of the nearest examples, the terms that count) of each text."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            vectors = [self.vector(terms(t)) for t in texts[at : at + TOGETHER]]
            out += [self._score(ids, weights, begun) for (ids, weights), begun in zip(vectors, self.index.begun(vectors), strict=True)]
        return out

    def _score(self, ids: np.ndarray, weights: np.ndarray, begun: np.ndarray) -> tuple[float, list[int], list[str]]:
        vote, rows, order = self.vote(ids, weights, begun=begun)
        if vote is None:
            return self.blank, [], []
        score = float(np.interp(vote, self.at, self.value)) if len(self.at) else self.prior
        # Ties in the calibrated value keep the order of the votes.
        score = min(1.0, max(0.0, 0.999 * score + 0.001 * vote))
        shown = [self.names[int(ids[i])].decode("utf-8", "replace") for i in order[:EVIDENCE]]
        return score, [self.ids[r] for r in rows[:SHOWN]], shown


def _frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """In how many documents of the whole corpus each term of the vocabulary stands."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        n = np.zeros(len(words), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = [words[t] for t in terms(text) if t in words]
                n[found] += 1
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary))
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    return df


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Fit on the labelled rows that are not held out: at most ``examples`` distinct texts of each class.

    ``labels`` has doc_id and toxic (0 or 1, null for unknown; the greatest of
    repeated rows counts). A text that stands under several ids, or several times
    under one, is one example, of the label of most; of different texts under one id each is an
    example. ``examples`` bounds what the driver collects: that many texts of a
    class, as terms with counts.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialize(known)
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    some = picked[0].unionByName(picked[1])  # 2 x examples narrow rows at most, so it is broadcast
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    # Which class each distinct text is of; a class that yields more texts than it may have ids has them cut by hash.
    texts = joined.groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").cast("long").alias("doc_id"), F.round(F.avg("toxic")).cast("int").alias("toxic"), F.min("text").alias("text"))
    texts = materialize(texts)
    rows = texts.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "h").limit(examples).unionByName(texts.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "h").limit(examples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys, found = (batch.column(i).to_pylist() for i in range(3))
            for i, y, text in zip(ids, ys, found, strict=True):
                got = terms(text)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i]), "toxic": pa.array([y], pa.int32()), "terms": pa.array([list(got)], pa.list_(pa.binary())), "counts": pa.array([list(got.values())], pa.list_(pa.int64()))})

    made = rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, terms array<binary>, counts array<long>").toArrow().to_pylist()
    kept = [(r["doc_id"], r["toxic"], dict(zip(r["terms"], r["counts"], strict=True))) for r in made]
    kept.sort(key=lambda r: (r[0], sorted(r[2].items())))
    have: Counter = Counter()
    for _, _, t in kept:
        have.update(t.keys())
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, n in have.items() if n >= LEAST))}
    idf = np.zeros(0)
    if vocabulary:
        df, n = _frequencies(docs, vocabulary), docs.count()
        idf = np.where(df > max(LEAST, STOP * n), 0.0, np.log(1 + (n - df + 0.5) / (df + 0.5)))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    weights = {y: sizes.get(y, 0) / max(1, min(examples, sizes.get(y, 0))) for y in (0, 1)}
    return Model(vocabulary, idf, kept, weights)


def classify(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, nearest, evidence) for every row of ``docs``, from its text alone.

    ``nearest`` holds the doc_ids of the nearest labelled examples, ``evidence``
    the terms on which the neighbours' votes are highest. Of examples at equal cosine the first in the index is nearer. Texts without a known term (empty and null ones
    too) get the share of label 1 among such examples. Without labelled rows
    all scores are 0. Repeated rows each give a row; a row with a null id is held
    out; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, examples))

    def fn(texts: list) -> list:
        m = shared.value
        made = m.scores(texts)
        return [[s for s, _, _ in made], [int(s >= 0.5) for s, _, _ in made], [n for _, n, _ in made], [e for _, _, e in made]]

    fields = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("nearest", T.ArrayType(T.LongType())), ("evidence", T.ArrayType(T.StringType()))]
    out = arrow_map(docs.select("doc_id", "text"), fields, fn, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "nearest", "evidence")
