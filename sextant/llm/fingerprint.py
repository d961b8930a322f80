"""Document fingerprints by consistent weighted sampling.

For each of ``SAMPLES`` samples every weighted term (a word with its count)
draws r and c from Gamma(2, 1) and beta from U(0, 1), all fixed by a hash of
the term, and quantises its weight S: t = floor(ln S / r + beta), a = c /
exp(r (t - beta) + r). The term with the least a, with its t, is the sample.
Two texts have equal samples with a probability of their generalised Jaccard
similarity, sum(min) / sum(max) of the weights.

A term's draws depend on the term and its count alone, so workers remember them
for frequent (term, count) pairs as one integer per sample that orders by a and
carries the sample in its low bits; a text's signature is then a minimum.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map

SAMPLES = 128
#: Remembered (term, count) pairs per worker, 1 KB each; pairs seen once, which are remembered when they come again; texts whose signatures are remembered.
CACHE, ONCE, TEXTS = 160_000, 300_000, 20_000
#: Pairs whose draws are made at a time: their arrays fit the processor's cache.
BLOCK = 256
#: Pairs at most that wait for their draws together.
NEW = 4096
#: Documents of a batch that are compared together.
ROWS = 200
#: Rows of a bucket, about, when texts are brought beside their successors; and buckets at most.
BUCKET_ROWS, MAX_BUCKETS = 1000, 50_000

_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_U, _H = np.uint64, np.uint32


def terms(text: str | None) -> Counter:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as bytes, with their counts."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split())


def _mix(x: np.ndarray) -> np.ndarray:
    """32-bit hash, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> _H(shift)
        x *= _H(factor)
    x ^= x >> _H(16)
    return x


def _uniform(h: np.ndarray, bits: int) -> np.ndarray:
    """The middles of 2^bits cells of (0, 1), from the top bits of 32-bit hashes."""
    u = (h >> _H(32 - bits)).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-bits)
    return u


def packed(pairs: list[tuple[bytes, int]], samples: int = SAMPLES) -> np.ndarray:
    """One int64 per pair and sample: a as the bits of a positive float above, a hash of (term, t) below.

    r and beta come as r = e + f and beta = f / r of two unit exponentials, which gives
    them the distributions that they must have. So a = c exp(-e - r t), and a
    pair of count one, whose t is 0, needs c and the uniform u = exp(-e) alone.
    """
    seeds = np.array([xxhash.xxh64_intdigest(w) for w, _ in pairs], dtype=_U)
    k = (np.arange(1, samples + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) >> _U(32)).astype(_H)[None, :]
    low, high = seeds.astype(_H), (seeds >> _U(32)).astype(_H)
    h = _mix(low[:, None] ^ k)
    a = _uniform(h, 16)
    a *= _uniform(h << _H(16), 16)
    np.log(a, out=a)  # -c, a draw of Gamma(2, 1)
    h ^= high[:, None]
    u = _uniform(_mix(h), 24)
    a *= u
    np.negative(a, out=a)
    name = _mix(low ^ high)
    which = np.empty(a.shape, _H)
    which[:] = name[:, None]
    counts = np.array([n for _, n in pairs], dtype=np.float32)
    more = np.nonzero(counts > 1)[0]
    if len(more):
        f = -np.log(_uniform(_mix(h[more] + low[more, None]), 24))
        r = f - np.log(u[more])
        t = np.floor((np.log(counts[more])[:, None] + f) / r)
        a[more] *= np.exp(-r * t)
        which[more] = _mix(name[more, None] + t.astype(np.int64).astype(_H) * _H(0x9E3779B1)) * (t > 0) + which[more] * (t == 0)
    order = a.view(np.int32).astype(np.int64)
    order <<= 32
    order |= which
    return order


class Sampler:
    """Signatures of texts; remembers the draws of frequent pairs and the signatures of recent texts."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.place: dict = {}  # a pair's row; a pair of count one goes by its term alone
        self.once: set = set()
        self.texts: dict[bytes, bytes] = {}
        self.rows = np.empty((0, samples), np.int64)

    def _remember(self, keys: list, made: np.ndarray) -> None:
        """Keep the rows of those keys that were seen before."""
        again = [i for i, x in enumerate(keys) if x in self.once]
        if len(self.once) > ONCE:
            self.once.clear()
        self.once.update(keys)
        if not again:
            return
        if len(self.place) + len(again) > CACHE:
            self.place.clear()
        start, need = len(self.place), len(self.place) + len(again)
        if need > len(self.rows):
            grown = np.empty((min(CACHE, max(1024, 2 * need)), self.samples), np.int64)
            grown[:start] = self.rows[:start]
            self.rows = grown
        self.rows[start:need] = made[again]
        self.place.update((keys[i], at) for at, i in enumerate(again, start))
        self.once.difference_update([keys[i] for i in again])

    def _drawn(self, keys: list) -> np.ndarray:
        pairs = [x if type(x) is tuple else (x, 1) for x in keys]
        return np.concatenate([packed(pairs[at : at + BLOCK], self.samples) for at in range(0, len(pairs), BLOCK)])

    def signatures(self, texts: list[str | None]) -> list[bytes]:
        """16 bits per sample, big-endian, for each text; zeros for a text without terms."""
        names = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        out = {x: self.texts[x] for x in names if x in self.texts}
        new: dict = {}
        waiting: list[tuple[bytes, np.ndarray, list[int]]] = []

        def flush() -> None:
            if new:
                keys = list(new)
                made = self._drawn(keys)
            for x, least, at in waiting:
                if at:
                    np.minimum(least, made[at].min(axis=0), out=least)
                # A sample of zeros marks the empty text only.
                out[x] = (least & 0xFFFF).clip(1).astype(">u2").tobytes()
            if new:
                self._remember(keys, made)
            new.clear()
            waiting.clear()

        for x, text in zip(names, texts, strict=True):
            if x in out:
                continue
            out[x] = b"\0" * (2 * self.samples)
            keys = [w if n == 1 else (w, n) for w, n in terms(text).items()]
            if not keys:
                continue
            least = np.full(self.samples, np.iinfo(np.int64).max)
            places = list(map(self.place.get, keys))
            known = np.array([p for p in places if p is not None], np.intp)
            for at in range(0, len(known), 1024):
                np.minimum(least, self.rows[known[at : at + 1024]].min(axis=0), out=least)
            unknown = [k for k, p in zip(keys, places, strict=True) if p is None]
            while len(unknown) > NEW:  # a very long text: in parts
                part, unknown = unknown[:NEW], unknown[NEW:]
                np.minimum(least, self._drawn(part).min(axis=0), out=least)
            if len(new) + len(unknown) > NEW:
                flush()
            waiting.append((x, least, [new.setdefault(k, len(new)) for k in unknown]))
        flush()
        if len(self.texts) + len(out) > TEXTS:
            self.texts.clear()
        self.texts.update(out)
        return [out[x] for x in names]

    def signature(self, text: str | None) -> bytes:
        return self.signatures([text])[0]


_samplers: dict[int, Sampler] = {}


def sampler(samples: int = SAMPLES) -> Sampler:
    if samples not in _samplers:
        _samplers[samples] = Sampler(samples)
    return _samplers[samples]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal samples: the estimated generalised Jaccard similarity."""
    return float((np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")).mean())


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) for every row: 4 hex digits per sample.

    Null and empty texts, and texts without words, have a fingerprint of zeros.
    Equal texts have equal fingerprints. Repeated rows each give a row; ids may
    be null; other columns are not read.
    """
    return arrow_map(docs.select("doc_id", "text"), [("fingerprint", T.StringType())], lambda texts: [[x.hex() for x in sampler(samples).signatures(texts)]], keep=["doc_id"])


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many, or all, of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, halo, doc_id, text, tie) such that sorted buckets hold each document before the next one.

    Documents are ordered by descending id (null ids last, equal ids by a hash
    of the text). Buckets are ranges of ids at percentiles of the table; the
    first row of each non-empty bucket is sent to the one before it too (the
    first one's to the last), marked ``halo``. So the texts move once.
    """
    n = min(MAX_BUCKETS, docs.count() // BUCKET_ROWS)
    got = docs.agg(F.percentile_approx("doc_id", [i / (n + 1) for i in range(1, n + 1)], 10 * n + 100)).first()[0] if n else None
    cuts = np.unique(np.array(got or [], np.int64))
    nulls = len(cuts) + 1  # the bucket of null ids, after all others

    def bucket(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known, len(cuts) - np.searchsorted(cuts, ids, "left"), nulls)

    def values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return col.fill_null(0).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = values(batch.column(0))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket(ids, known), pa.int32()), "top": pa.array(ids, pa.int64())})

    top = docs.select(F.col("doc_id").cast("long")).mapInArrow(heads, "bucket int, top long").groupBy("bucket").agg(F.max("top").alias("top")).collect()
    tops = {r["bucket"]: r["top"] for r in top}
    order = sorted(tops)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    tie = F.xxhash64("text")
    last_tie = docs.where("doc_id is null").agg(F.max(tie)).first()[0] if nulls in tops else None
    out = T.StructType([T.StructField(c, t) for c, t in (("bucket", T.IntegerType()), ("halo", T.BooleanType()), ("doc_id", T.LongType()), ("text", T.StringType()), ("tie", T.LongType()))])
    arrow = to_arrow_schema(out)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = values(batch.column(0))
            own = bucket(ids, known)
            head = np.array([(i == tops[b]) if k else (x == last_tie) for i, k, b, x in zip(ids.tolist(), known.tolist(), own.tolist(), batch.column(2).to_pylist(), strict=True)], bool)
            again = np.nonzero(head)[0]
            cols = [pa.array(own, pa.int32()), pa.array(np.zeros(len(own), bool)), *batch.columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            if len(again):
                part = batch.take(pa.array(again))
                cols = [pa.array([before[b] for b in own[again].tolist()], pa.int32()), pa.array(np.ones(len(again), bool)), *part.columns]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), tie.alias("tie")).mapInArrow(deal, out)


def compare_with_edited(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """For every document its fingerprint, that of its edited text, and their likeness; and its likeness to the next document.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document's, in descending doc_id; after the last
    comes the first. A null text counts as empty. Null ids come last; equal ids
    are ordered by a hash of the text; a single row is its own successor. An
    empty table gives an empty result.
    """
    dealt = with_next(docs)
    sort = ["bucket", "halo", F.desc_nulls_last("doc_id"), F.desc("tie")]
    out = T.StructType(
        [T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))]
    )
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(samples)
        held = None  # (bucket, doc_id, text), until its successor is seen
        for batch in batches:
            pairs = []  # a document, its text, the next text
            for b, halo, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if held and held[0] == b:
                    pairs.append((held[1], held[2], text))
                held = None if halo else (b, doc_id, text)
            for at in range(0, len(pairs), ROWS):
                some = pairs[at : at + ROWS]
                changed = [edited(x, y) for _, x, y in some]
                signs = s.signatures([x for _, x, _ in some] + [y for _, _, y in some] + changed)
                own, after, other = signs[: len(some)], signs[len(some) : 2 * len(some)], signs[2 * len(some) :]
                cols = [
                    [d for d, _, _ in some], [len(x) for _, x, _ in some], [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
                    [x.hex() for x in own], [x.hex() for x in other], list(map(likeness, own, other)), list(map(likeness, own, after)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    done = dealt.repartition("bucket").sortWithinPartitions(*sort).select("bucket", "halo", "doc_id", "text").mapInArrow(run, out)
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
