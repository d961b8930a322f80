"""Secret scan: fixed patterns, and a battery of randomness tests for what they don't know.

Every run of 20 or more characters that could encode random bytes is a
candidate. Its encoding is inferred (the smallest alphabet that holds it) and
three tests ask how much more random it is than ordinary identifiers and words
would be (the null hypothesis):

* chi-squared: is the use of the alphabet closer to uniform,
* runs: do character classes change more often,
* serial correlation: do neighbours depend less on each other.

The three are joined to one p-value. Candidates of a text are then held to a
false-discovery rate by a Benjamini-Hochberg step whose weights grow with a
candidate's length, as short ones carry less evidence. A candidate must also
not contradict uniform randomness itself (repeats, counters).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: The base patterns, in the order in which kinds are listed, and the least length of the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the same as runs of any length of which the short ones are dropped
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Candidates of the battery.
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
#: Encodings by growing alphabet.
ENCODINGS = [
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"),
    ("base64url", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"),
    ("path", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"),
]
#: Of ordinary text, under the null hypothesis: excess of symbol concentration, rate of class changes, correlation of neighbours.
CONCENTRATION, CHANGES, CORRELATION = 0.7, 0.15, 0.35
#: False-discovery rate, and how unlikely under true randomness a candidate may be.
RATE, CONTRADICTS = 1e-3, 1e-3

_HEX_BYTES = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_TOKEN_BYTES = bytes(1 if chr(c) in ENCODINGS[-1][1] else 0 for c in range(256))


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def encoding(token: str) -> tuple[str, int]:
    """Name and alphabet size of the smallest known encoding that could have made ``token``."""
    have = set(token.rstrip("="))
    return next((name, len(alphabet)) for name, alphabet in ENCODINGS if have <= set(alphabet))


def battery(token: str) -> tuple[float, bool]:
    """(p-value of ``token`` being ordinary text, whether it fits true randomness)."""
    body = token.rstrip("=")
    _, k = encoding(token)
    n = len(body)
    counts = Counter(body)
    chi = sum(c * c for c in counts.values()) * k / n - n
    # Mean and spread of the statistic: uniform use, and use as concentrated as in ordinary text.
    uniform, spread = k - 1, math.sqrt(2 * (k - 1))
    z_chi = (chi - uniform - (n - 1) * CONCENTRATION) / math.sqrt(2 * (k - 1) + 4 * (n - 1) * CONCENTRATION)
    classes = np.array(["lower upper digit other".split().index("lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "other") for c in body])
    changes = int((classes[1:] != classes[:-1]).sum())
    z_runs = -(changes - 0.5 - (n - 1) * CHANGES) / math.sqrt((n - 1) * CHANGES * (1 - CHANGES))
    values = np.array([ord(c) for c in body], float)
    values -= values.mean()
    power = float((values * values).sum())
    r = float((values[1:] * values[:-1]).sum()) / power if power else 1.0
    z_serial = (r - CORRELATION) * math.sqrt(n)
    p = _phi((z_chi + z_runs + z_serial) / math.sqrt(3))
    fits = _phi(-(chi - uniform) / spread) >= CONTRADICTS and 2 * _phi(-abs(r + 1 / n) * math.sqrt(n)) >= CONTRADICTS and changes > 0
    return p, fits


def discoveries(tokens: list[str], rate: float = RATE) -> list[bool]:
    """Which of a text's candidates are random: weighted Benjamini-Hochberg, weights in proportion to length with mean one."""
    if not tokens:
        return []
    tested = [battery(t) for t in tokens]
    mean = sum(map(len, tokens)) / len(tokens)
    scaled = [p * mean / len(t) for (p, _), t in zip(tested, tokens, strict=True)]
    order = sorted(range(len(tokens)), key=scaled.__getitem__)
    last = max((i + 1 for i, j in enumerate(order) if scaled[j] <= rate * (i + 1) / len(tokens)), default=0)
    chosen = set(order[:last])
    return [i in chosen and tested[i][1] for i in range(len(tokens))]


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All (start, place of the kind in ``KINDS``, end) of one whole text, sorted; places are code points."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    spans = []
    if any(k in low for k in _KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"\1" * HEX_LEAST in raw.translate(_HEX_BYTES):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if b"\1" * LEAST in raw.translate(_TOKEN_BYTES):
        spans.sort()
        starts = [s for s, _, _ in spans]
        ends = list(accumulate((e for _, _, e in spans), max))  # the furthest end so far
        free = []
        for m in CANDIDATE.finditer(text):
            i = bisect_left(starts, m.end())  # spans before i begin before the candidate ends
            if not i or ends[i - 1] <= m.start():
                free.append(m)
        spans += [(m.start(), 3, m.end()) for m, yes in zip(free, discoveries([m[0] for m in free]), strict=True) if yes]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans array<struct<kind,start,end>>, by start and then kind.

    Null and empty texts have no spans. Repeated rows each give a row; ids may
    be null; other columns are not read.
    """
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def fn(texts: list) -> list:
        return [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t)] for t in texts]]

    return arrow_map(docs.select("doc_id", "text"), [("spans", kind)], fn, keep=["doc_id"])


def digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as a string, from ``scan_secrets``."""
    def of(kind):
        return F.filter("spans", lambda x: x["kind"] == kind)

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] != KINDS[3])
    return scan_secrets(docs).select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(of(KINDS[3])).cast("long").alias("n_random"),
    )
