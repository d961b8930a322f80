"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of orders 1 to 3 of the lower-cased text, hashed into
2^16 buckets, per language. The smoothed log-probability matrix (buckets x
languages, 256 KB a language) is broadcast and texts are scored a batch at a time
as a sparse matrix of counts times it, in numpy. Texts are read whole, however long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_CHARS, arrow_map, held_out

BUCKET_BITS = 16
ORDERS = 3
#: Labelled documents per language that the model is fitted on, about; a hash of the id picks them.
TRAIN_DOCS = 4000
#: The matrix is broadcast; this many languages make 128 MB.
MAX_LANGUAGES = 512
#: Log-probabilities that are gathered at a time (a text has at most as many buckets as there are).
CELLS = 4_000_000
UNKNOWN = "und"
#: The start of every text counts as a boundary character, the same for all.
_EDGE = "\n"


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's n-grams, one array per order and chunk; chunks overlap so no n-gram is lost or doubled."""
    whole = np.frombuffer((_EDGE + text.lower()).encode("utf-32-le", "surrogatepass"), "<u4")
    shift = np.uint32(32 - BUCKET_BITS)
    for at in range(0, len(whole), CHUNK_CHARS):
        cp = whole[at : at + CHUNK_CHARS + ORDERS - 1]
        h = np.zeros(len(cp) + 1, np.uint32)
        for order in range(1, ORDERS + 1):
            h = h[:-1] * np.uint32(0x01000193) + cp[order - 1 :] + np.uint32(order)
            yield (h * np.uint32(0x9E3779B1) >> shift)[:CHUNK_CHARS]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's n-gram counts as (lang, bucket, n) rows of the buckets that occur."""
    size = 1 << BUCKET_BITS
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            to = sums.setdefault(lang, np.zeros(size, np.int64))
            for b in buckets(text):
                to += np.bincount(b, minlength=size)
    for lang, to in sums.items():
        at = np.nonzero(to)[0]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(to[at], pa.int64())})


class Model:
    """Languages in sorted order and their (buckets x languages) log-probabilities."""

    def __init__(self, languages: list[str], logp: np.ndarray, prior: np.ndarray):
        self.languages, self.logp, self.prior = languages, logp, prior

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior probability); (und, 0) for null, for a text without letters and for an empty model."""
        return self.predict_batch([text])[0]

    def predict_batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``predict`` of each text: a sparse (texts x buckets) matrix of counts times the log-probabilities, a bounded part at a time."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        most = max(1, CELLS // len(self.languages))
        rows: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            at = np.concatenate([b for b, _ in parts])
            n = np.concatenate([c for _, c in parts])
            starts = np.cumsum([0] + [len(b) for b, _ in parts[:-1]])
            total = self.prior + np.add.reduceat(self.logp[at] * n[:, None], starts, axis=0)
            p = np.exp(total - total.max(axis=1, keepdims=True))
            best = p.argmax(axis=1)
            for i, k, share in zip(rows, best.tolist(), (p.max(axis=1) / p.sum(axis=1)).tolist(), strict=True):
                out[i] = self.languages[k], share
            rows.clear()
            parts.clear()
            held = 0

        for i, text in enumerate(texts):
            if not text or not any(map(str.isalpha, text)):
                continue
            counts = sum(np.bincount(b, minlength=1 << BUCKET_BITS) for b in buckets(text))
            at = np.nonzero(counts)[0]
            if rows and held + len(at) > most:
                flush()
            rows.append(i)
            parts.append((at, counts[at].astype(np.float64)))
            held += len(at)
        if rows:
            flush()
        return out


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, smoothing: float = 0.2) -> Model:
    """Fit on ``labelled(doc_id, text, lang)``: at most about ``train_docs`` rows per language.

    Rows with null text or lang are passed over. Only counts reach the driver:
    buckets x languages at most.
    """
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train_docs / n))])
    picked = labelled.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) < share[F.col("lang")] * F.lit(float(1 << 30)))
    got = picked.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    place = {k: i for i, k in enumerate(languages)}
    counts = np.zeros((1 << BUCKET_BITS, len(languages)))
    if got.num_rows:
        cols = got["lang"].combine_chunks().dictionary_encode()
        to = np.array([place[k] for k in cols.dictionary.to_pylist()])[cols.indices.to_numpy()]
        counts[got["bucket"].to_numpy(), to] = got["n"].to_numpy()
    counts += smoothing
    logp = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    seen = np.array([sizes[k] for k in languages], float)
    return Model(languages, logp, np.log(seen / seen.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, from its text alone.

    Null or empty texts and texts without a letter give ``und`` and 0. Repeated
    rows each give a row; ids may be null; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: list) -> list:
        return list(map(list, zip(*shared.value.predict_batch(texts), strict=True)))

    return arrow_map(docs.select("doc_id", "text"), [("lang_pred", T.StringType()), ("score", T.DoubleType())], fn, keep=["doc_id"])


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fit on the rows that are not held out, then predict every row.

    A row is held out if crc32 of its id as text is divisible by 5, or its id is
    null. Without any labelled row everything is ``und``. An empty table gives
    an empty result.
    """
    out = predict(docs, train(docs.where(~held_out(F.col("doc_id"))), train_docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language at ``min_score`` or more.

    ``und`` rows (null, empty, no letters) go. The model is fitted on the
    table's own labelled rows that are not held out.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))), train_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = m.predict_batch(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def accuracy(docs: DataFrame, predicted: DataFrame) -> Counter:
    """Held-out right and wrong predictions, for reports and tests."""
    both = docs.select("doc_id", "lang").join(predicted, "doc_id").where("held_out and lang is not null")
    return Counter({r["ok"]: r["n"] for r in both.groupBy((F.col("lang") == F.col("lang_pred")).alias("ok")).agg(F.count(F.lit(1)).alias("n")).collect()})
