"""License scan: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates expressions.

Notice phrases are sequences of words. A text is brought to lower-case words
joined by single blanks, so one automaton pass over it finds every phrase at
its word places. Identifier tags are found by a second automaton in the text as
it is; the expression after a tag is parsed and, if it is well formed, its
licences become labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases (public licence names) and their labels.
MORE = {
    "mit licence": "mit",
    "apache licence": "apache",
    "apache software license": "apache",
    "general public licence": "gpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "permission is hereby granted free of charge": "mit",
    "boost software license": "bsl",
    "creative commons": "cc",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "unlicense": "unlicense",
    "all rights reserved": "proprietary",
    "proprietary and confidential": "proprietary",
}
#: Tags that a licence expression follows (lower case).
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Starts of identifiers and the label of their family.
FAMILIES = {
    "agpl": "agpl",
    "apache": "apache",
    "bsd": "bsd",
    "bsl": "bsl",
    "cc-by-nc-nd": "cc-by-nc-nd",
    "cc-by-nc-sa": "cc-by-nc-sa",
    "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd",
    "cc-by-sa": "cc-by-sa",
    "cc-by": "cc-by",
    "cc0": "cc0",
    "cddl": "cddl",
    "epl": "epl",
    "gpl": "gpl",
    "isc": "isc",
    "lgpl": "lgpl",
    "mit": "mit",
    "mpl": "mpl",
    "unlicense": "unlicense",
}
#: Families whose terms ask little of a user; an expression is permissive if one of its alternatives is.
PERMISSIVE = {"apache", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "unlicense", "public-domain"}

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ITEM = re.compile(r"[^\S\n]*([()]|[A-Za-z0-9.+:-]+)")
#: Public identifiers are capitalised, or have a version.
_SHAPE = re.compile(r"[A-Z][A-Za-z0-9.-]*\+?|[A-Za-z][A-Za-z.-]*-[0-9][A-Za-z0-9.-]*\+?|[0-9][A-Za-z]+[A-Za-z0-9.-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass
class Expression:
    """A parsed licence expression: its licences, exceptions and alternatives in postfix order."""

    postfix: list[str]
    licenses: list[str] = field(default_factory=list)
    exceptions: list[str] = field(default_factory=list)

    def allowed(self, ok) -> bool:
        """Value with ``ok(licence)`` at the leaves: or needs one side, and needs both, with keeps its licence's value."""
        stack: list[bool] = []
        for x in self.postfix:
            if x in _BINDS:
                b, a = stack.pop(), stack.pop()
                stack.append(a or b if x == "or" else a and b if x == "and" else a)
            else:
                stack.append(bool(ok(x)))
        return stack[0]


def parse(text: str, start: int = 0) -> Expression | None:
    """The longest well-formed expression on a line that ``text`` has at ``start``, by shunting-yard; None if there is none.

    ``with`` binds tightest, then ``and``, then ``or``. Operators count in any case.
    Any word can be an identifier, so in running text the expression ends where
    two identifiers meet.
    """
    output: list[str] = []
    operators: list[str] = []
    want, after_with, closed, depth, at = True, False, False, 0, start
    # Where the last well-formed beginning ended: how much of the output it has, and the operators that close it.
    best: tuple[int, list[str]] | None = None
    leaves: list[tuple[int, bool]] = []

    def pop_while(least: int) -> None:
        while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= least:
            output.append(operators.pop())

    while m := _ITEM.match(text, at):
        item, low = m[1], m[1].lower()
        if item == "(":
            if not want or after_with:
                break
            operators.append("(")
            depth += 1
        elif item == ")":
            if want or not depth:
                break
            pop_while(0)
            operators.pop()
            depth -= 1
        elif low in _BINDS:
            if want or (low == "with" and (not leaves or closed)):
                break
            pop_while(_BINDS[low])
            operators.append(low)
            want, after_with = True, low == "with"
        else:
            item = item.rstrip(".:") or item
            if not want:
                break
            leaves.append((len(output), after_with))
            output.append(item)
            want, after_with = False, False
        closed = item == ")"
        at = m.end()
        if not want and not depth:
            best = len(output), operators[::-1]  # three operators at most, as each binds tighter than the one below
        if not want and m[1].endswith("."):
            break
    if best is None:
        return None
    n, close = best
    used = [(output[i], e) for i, e in leaves if i < n]
    return Expression([*output[:n], *close], [x for x, e in used if not e], [x for x, e in used if e])


def family(identifier: str) -> str:
    """The label of a licence identifier: its family, or itself in lower case."""
    low = identifier.lower()
    return next((FAMILIES[k] for k in sorted(FAMILIES, key=len, reverse=True) if low == k or low.startswith((k + "-", k + "+"))), low)


def known(identifier: str) -> bool:
    """Whether the word after a tag is an identifier: of a known family, a reference of its own, or in shape (with a digit or a capital and no lower case before it)."""
    return family(identifier) in FAMILIES.values() or identifier.lower().startswith(("licenseref-", "documentref-")) or bool(_SHAPE.fullmatch(identifier))


@cache
def _automata() -> tuple:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for base, table in ((False, MORE), (True, BASE)):
        for phrase, label in table.items():
            phrases.add_word(f" {phrase} ", (len(phrase) + 1, label, base))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


@dataclass
class Scan:
    """What one text holds. ``base``: (word place, label) of each base phrase; ``notices`` likewise of the others."""

    n_words: int
    base: list[tuple[int, str]]
    notices: list[tuple[int, str]]
    expressions: list[Expression]

    def labels(self) -> list[str]:
        """Base labels as they are; of other notices the longest where several start at one place, so cc-by-nc is not cc-by."""
        got = {x for _, x in self.base + self.notices}
        return sorted(got | {family(x).replace(",", " ") for e in self.expressions for x in e.licenses})

    def score(self) -> float:
        """Strength of the evidence: a tag 1, a base notice 0.9, another notice 0.6, joined as independent signs."""
        miss = (0.0 if self.expressions else 1.0) * 0.1 ** min(1, len(self.base)) * 0.4 ** len({x for _, x in self.notices})
        return round(1.0 - miss, 6)


def scan(text: str | None) -> Scan:
    """Scan one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_LOWER).split()
    if not words:
        return Scan(0, [], [], [])
    phrases, tags = _automata()
    # Latin-1 keeps one character a byte, and the phrases are ASCII.
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = [(end - size, size, label, base) for end, (size, label, base) in phrases.iter(flat)]
    base: list[tuple[int, str]] = []
    notices: list[tuple[int, str]] = []
    if hits:
        blanks = np.cumsum(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
        longest: dict[int, tuple[int, str]] = {}
        for at, size, label, is_base in hits:
            if is_base:
                base.append((int(blanks[at]) - 1, label))
            else:
                longest[at] = max(longest.get(at, (0, "")), (size, label))
        notices = [(int(blanks[at]) - 1, label) for at, (_, label) in longest.items()]
    found = []
    if b"license-" in (low := raw.lower()):
        low = low.decode("utf-8", "surrogatepass")
        for end, _ in tags.iter(low):
            if (e := parse(text, end + 1)) and all(map(known, e.licenses)):
                found.append(e)
    return Scan(len(words), sorted(base), sorted(notices), found)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive.

    ``expressions`` holds the well-formed licence expressions found after tags.
    ``permissive`` is null without any licence; an expression counts by its
    value, a notice by its family. Null and empty texts give zero counts, null
    places, empty labels and score 0. Repeated rows each give a row; ids may be
    null; other columns are not read.
    """

    def fn(texts: list) -> list:
        cols: list[list] = [[] for _ in range(9)]
        for t in texts:
            s = scan(t)
            places = [p for p, _ in s.base]
            ok = [e.allowed(lambda x: family(x) in PERMISSIVE) for e in s.expressions]
            ok += [x in PERMISSIVE for _, x in s.base + s.notices]
            row = (
                s.n_words, len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted({x for _, x in s.base})), ",".join(s.labels()), s.score(),
                [" ".join(e.postfix) for e in s.expressions], all(ok) if ok else None,
            )
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return cols

    fields = [
        ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
        ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()),
        ("expressions", T.ArrayType(T.StringType())), ("permissive", T.BooleanType()),
    ]
    return arrow_map(docs.select("doc_id", "text"), fields, fn, keep=["doc_id"])
