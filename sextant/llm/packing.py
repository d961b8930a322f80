"""Best-fit packing of tokenised documents by patterns and non-negative least squares.

Only the histogram of piece lengths (``size`` bins at most, whatever the number
of documents) comes to the driver. There patterns of one to three lengths that fill
a sequence exactly are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded, and what is left over is
packed best fit, longest first, by length classes. Patterns place four fifths of the pieces. The plan is a table from
(length, rank among the pieces of that length) to (sequence, offset). Pieces
get their ranks in Spark and look themselves up.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import TMP, materialize, with_rank

SIZE = 2048
#: Patterns of three documents in a fit, about.
TRIPLES = 10_000
#: Steps of the least-squares fit.
STEPS = 400
#: Share of the pieces that rounded patterns place, about; the residuals close what rounding leaves.
SHARE = 0.8
#: Lower shares, each taken if that saves a sequence: where pieces are few, what the patterns leave may be hard to close.
GIVE_BACK = (0.6, 0.4, 0.2, 0.0)
#: Documents, in their order, that ``pack_in_order`` packs together.
WINDOW = 1 << 12
#: Fixed value: how a byte-level vocabulary parts texts before its merges.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, Encoder] = {}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Bytes to ids of a byte-level BPE file whose merges are in the order of their ids; None for any other file.

    Such a vocabulary gives the same ids whether its merges are looked up by
    their place in the file or by the id of what they make.
    """
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, before = made["model"], made["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made["normalizer"]
    if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocab, merges = model["vocab"], [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # Bytes that print stand for themselves, the others for characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)).difference(shown))
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte[c] for c in k): v for k, v in vocab.items()}


class Encoder:
    """Token ids of texts, as arrays of unsigned 32-bit integers.

    The vocabulary is the tokenizers file's. Where ``_ranks`` can read it, texts
    go through the library that needs a sixth of the time for the same ids;
    other files, and texts that it refuses (a million blanks in a row), go
    through tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ranks = _ranks(path)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: one, or full ones after a first that may be shorter."""
    first = n if n <= size else n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


#: The pieces of a document, as ``tokenize_rows`` gives them.
PIECES = TMP + "pieces"
_PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def tokenize_rows(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """``docs`` with its text replaced by ``__sx_pieces``, an array of (piece, start, length, ids_crc32); a document's ids are followed by ``end_id``."""
    keep = [c for c in docs.columns if c != "text"]
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField(PIECES, T.ArrayType(_PIECE))])
    arrow = to_arrow_schema(out)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            made = []
            for text in batch.column(0).to_pylist():
                ids = enc.encode(text or "").astype("<u4", copy=False).tobytes() + end
                made.append([{"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[4 * s : 4 * (s + n)])} for k, (s, n) in enumerate(cuts(len(ids) // 4, size))])
            kept = [batch.column(1 + j).cast(arrow.field(j).type) for j in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, arrow.field(len(keep)).type)], schema=arrow)

    return docs.select("text", *keep).mapInArrow(run, out)


def tokenize(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every row."""
    return tokenize_rows(docs.select("doc_id", "text"), tokenizer, size, end_id).select("doc_id", F.inline(PIECES))


def patterns(present: np.ndarray, size: int, most: int = TRIPLES) -> np.ndarray:
    """Rows of up to three lengths, ascending, 0 for none, that add up to ``size``; all of them are ``present``.

    Of the rows of three about ``most`` are taken, spread evenly over the lengths:
    with far more patterns than lengths a fit gives each too small a count to round.
    """
    have = np.zeros(size + 1, bool)
    have[present] = True
    found = [np.array([[0, 0, size]])] if have[size] else []
    a = np.nonzero(have[: size // 2 + 1])[0]
    a = a[(a > 0) & have[size - a]]
    found.append(np.column_stack([np.zeros_like(a), a, size - a]))
    three = []
    for x in np.nonzero(have[: size // 3 + 1])[0]:
        if x:
            y = np.arange(x, (size - x) // 2 + 1)
            y = y[have[y] & have[size - x - y]]
            three.append(np.column_stack([np.full_like(y, x), y, size - x - y]))
    if three:
        rows = np.concatenate(three)
        step = -(-len(rows) // most) or 1
        found.append(rows[(rows[:, 0] * 40503 + rows[:, 1] * 9973) % 65521 % step == 0])
    return np.concatenate(found).astype(np.int64)


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts of the patterns that fit the histogram in the least-squares sense (accelerated projected gradient).

    Each length's square is weighted by one over the number of patterns that
    have it, which makes one step size right for all.
    """
    bins = len(counts)
    cols = [np.ascontiguousarray(c) for c in rows.T]

    def forward(x):
        out = sum(np.bincount(c, x, bins) for c in cols)
        out[0] = 0.0
        return out

    weight = 1.0 / np.maximum(1.0, forward(np.ones(len(rows)))) / rows.shape[1]
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        r = weight * (forward(y) - counts)
        r[0] = 0.0
        new = np.maximum(0.0, y - sum(r[c] for c in cols))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): all pieces of the histogram, longest first, each into the fullest sequence that takes it.

    Pieces of a length and sequences of a content are handled together, so the
    work follows the number of lengths and not of pieces.
    """
    room: list[list[list]] = [[] for _ in range(size + 1)]  # by free space: [content, how many]
    filled = np.zeros(size + 1, bool)
    for length in np.nonzero(counts)[0][::-1].tolist():
        left = int(counts[length])
        while left:
            at = np.nonzero(filled[length:])[0]
            free = length + int(at[0]) if len(at) else size
            content, many = room[free].pop() if len(at) else [(), left]
            filled[free] = bool(room[free])
            each = free // length
            full, rest = (many, 0) if many * each <= left else divmod(left, each)
            for n, k in ((full, each), (int(rest > 0), rest)):
                if n:
                    room[free - k * length].append([content + (length,) * k, n])
                    filled[free - k * length] = True
            unused = many - full - int(rest > 0)
            if len(at) and unused:
                room[free].append([content, unused])
                filled[free] = True
            left -= full * each + rest
    return [(tuple(c), n) for group in room for c, n in group]


def rounded(rows: np.ndarray, x: np.ndarray, counts: np.ndarray, size: int, share: float = SHARE) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """((lengths, repeats) of the patterns, what they leave of ``counts``): the fit rounded down, then by largest remainders, until ``share`` of the pieces are placed.

    Remainders don't count for patterns with a piece under ``size`` / 32: such pieces are what closes the
    sequences of the residuals.
    """
    left, times = counts.copy(), np.zeros(len(rows), np.int64)
    goal = counts.sum() * (1 - share)

    def take(i: int, n: int) -> None:
        lengths = [v for v in rows[i].tolist() if v]
        n = min(n, -int(-(left.sum() - goal) // len(lengths)), *(int(left[v]) // lengths.count(v) for v in lengths))
        for v in lengths:
            left[v] -= n
        times[i] += n

    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1 or left.sum() <= goal:
            break
        take(i, int(x[i]))
    rest = x - np.floor(x)
    rest[np.where(rows > 0, rows, size).min(axis=1) < size // 32] = 0.0
    for i in np.argsort(-rest, kind="stable"):
        if rest[i] <= 1e-4 or left.sum() <= goal:
            break
        take(i, 1)
    return [(tuple(v for v in rows[i].tolist() if v), int(times[i])) for i in np.nonzero(times)[0]], left


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that hold every piece of the histogram ``counts`` (by length, 0 to ``size``) exactly once: rounded patterns, then residuals best fit; with the largest share of patterns that takes fewest sequences."""
    counts = counts.astype(np.int64)
    present = np.nonzero(counts)[0]
    if not len(present):
        return []
    rows = patterns(present, size)
    x = fit(rows, counts.astype(float))
    made = []
    for share in (SHARE, *GIVE_BACK):
        done, left = rounded(rows, x, counts, size, share)
        made.append(done + best_fit(left, size))
    return min(made, key=lambda p: sum(n for _, n in p))  # the first of the fewest


def slots(done: list[tuple[tuple[int, ...], int]], size: int) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by (length, first rank): where the pieces of each range of ranks go."""
    table, base, rank = [], 0, [0] * (size + 1)
    for lengths, n in done:
        offset = 0
        for v in lengths:
            table.append((v, rank[v], base, offset))
            rank[v] += n
            offset += v
        base += n
    table.sort()
    cols = np.array(table, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), cols, strict=True))


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is from 1 to ``size``."""
    bins = pieces.groupBy("length").count().toArrow()
    counts = np.zeros(size + 1, np.int64)
    counts[bins["length"].to_numpy()] = bins["count"].to_numpy()
    shared = pieces.sparkSession.sparkContext.broadcast(slots(plan(counts, size), size))
    at = TMP + "rank"
    ranked = with_rank(pieces, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], at, int(counts.sum()))
    ranked = ranked.select(*pieces.columns, at)
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(out)
    place, width = pieces.columns.index("length"), len(pieces.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        wide = 1 << 44  # more than the pieces of one length
        keys = s["length"] * wide + s["rank"]
        for batch in batches:
            rank = batch.column(width).to_numpy(zero_copy_only=False).astype(np.int64)
            i = np.searchsorted(keys, batch.column(place).to_numpy(zero_copy_only=False) * wide + rank, "right") - 1
            new = [s["sequence"][i] + rank - s["rank"][i], s["offset"][i]]
            cols = [batch.column(j).cast(arrow.field(j).type) for j in range(width)] + [pa.array(v, pa.int64()) for v in new]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return ranked.mapInArrow(run, out)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences of at most ``size`` tokens.

    Null texts count as empty: a piece of the end id alone. Repeated rows are
    packed each. Ids may be null; other columns are not read. An empty table
    gives an empty result.
    """
    return pack_pieces(materialize(tokenize(docs, tokenizer, size)), size)


def places(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces in their order: a plan (see ``plan``) whose patterns are spread evenly over the sequences and take the pieces of each length in turn."""
    table, base = [], 0
    for p, (pattern, n) in enumerate(plan(np.bincount(lengths, minlength=size + 1), size)):
        r = np.arange(n)
        at, offset = (r + p * 0.6180339887498949 % 1) / n, 0
        for v in pattern:
            table.append(np.array([np.full(n, v), at, base + r, np.full(n, offset)], float))
            offset += v
        base += n
    length, at, sequence, offset = np.concatenate(table, axis=1)
    order = np.lexsort((offset, sequence, at, length))
    # Sequences are numbered by where they are, with their number in the plan for ties.
    first = np.zeros(base)
    first[sequence.astype(np.int64)] = at
    number = np.empty(base, np.int64)
    number[np.argsort(first, kind="stable")] = np.arange(base)
    takes = np.argsort(lengths, kind="stable")
    out = np.empty((2, len(lengths)), np.int64)
    out[0, takes] = number[sequence[order].astype(np.int64)]
    out[1, takes] = offset[order].astype(np.int64)
    return out[0], out[1]


def pack_in_order(rows: DataFrame, position: str, size: int = SIZE, window: int = WINDOW) -> DataFrame:
    """Like ``pack``, with sequences in the order of the column ``position`` (unique, from 0, with few gaps) of ``rows`` from ``tokenize_rows``.

    Each ``window`` positions have a plan of their own, from the histogram of
    their lengths, and their sequences follow those of the windows before. So
    sources whose lengths differ keep their places. Within a window the pieces
    of each length go to its sequences in the order of their positions.
    """
    group, local = TMP + "window", TMP + "local"
    pieces = rows.select("doc_id", position, F.floor(F.col(position) / window).cast("long").alias(group), F.inline(PIECES))
    fields = [f for f in pieces.schema.fields if f.name != position]
    out = T.StructType([*fields, T.StructField(local, T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(position, "ascending"), ("piece", "ascending")])
        new = places(table.column("length").to_numpy().astype(np.int64), size)
        cols = [table.column(f.name).cast(arrow.field(j).type) for j, f in enumerate(fields)] + [pa.array(v, pa.int64()) for v in new]
        return pa.Table.from_arrays(cols, schema=arrow)

    packed = materialize(pieces.groupBy(group).applyInArrow(run, out))
    counts = packed.groupBy(group).agg((F.max(local) + 1).alias("n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(TMP + "start"))
    return packed.join(starts, group).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col(TMP + "start") + F.col(local)).alias("sequence_id"), "offset")
