"""Text helpers that become Catalyst expressions: ASCII folding, token runs, globs and regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates tokens: anything but letters and numbers of Unicode.
NOT_TOKEN = r"[^\p{IsAlphabetic}\p{N}]+"


def fold_ascii(c: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def fold(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def tokens(c: Column) -> Column:
    """Case-folded token runs of a string column, in order."""
    return F.filter(F.split(fold_ascii(c), NOT_TOKEN), lambda t: t != "")


def _parts(c: Column, q: list[str]) -> list[Column]:
    # Lower-casing changes no more of ASCII than folding does, and is faster.
    return [F.contains(F.lower(c), F.lit(t)) for t in q if t.isascii()]


def has_all(c: Column, q: list[str]) -> Column:
    """Whether the text has all of the tokens ``q`` somewhere, which is cheap, needed for having them as tokens, and decides most rows."""
    out = F.lit(True)
    for part in _parts(c, q):
        out = out & part
    return out


def has_any(c: Column, q: list[str]) -> Column:
    """Likewise for any of them."""
    parts = _parts(c, q)
    if len(parts) < len(q):
        return F.lit(True)
    out = parts[0]
    for part in parts[1:]:
        out = out | part
    return out


def token_list(s: str) -> list[str]:
    """The same runs of a literal."""
    out, run = [], ""
    for ch in fold(s):
        if ch.isalpha() or ch.isnumeric():
            run += ch
        elif run:
            out, run = [*out, run], ""
    return [*out, run] if run else out


def glob_regex(glob: str) -> str:
    """An anchored Java regular expression for a glob.

    ``*`` is any run, ``?`` any character, ``[abc]``, ``[a-z]`` and ``[!...]`` or
    ``[^...]`` classes. There is no escape; a class that never ends is a literal
    bracket; a class closes at its first ``]``, so an empty one matches nothing.
    """

    def literal(ch: str) -> str:
        return ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch

    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out += "" if out.endswith(".*") else ".*"
        elif ch == "?":
            out += "."
        elif ch == "[":
            negated = glob[i : i + 1] in ("!", "^")
            start = i + negated
            end = glob.find("]", start)
            if end < 0:
                out += "\\["
                continue
            body, inside, j = glob[start:end], "", 0
            while j < len(body):
                if j + 2 < len(body) and body[j + 1] == "-":
                    low, high = body[j], body[j + 2]
                    if low <= high:
                        inside += f"{literal(low)}-{literal(high)}"
                    j += 3
                else:
                    inside += literal(body[j])
                    j += 1
            out += (f"[^{inside}]" if negated else f"[{inside}]") if inside else ("." if negated else "(?!)")
            i = end + 1
        else:
            out += literal(ch)
    return rf"(?s)\A(?:{out})\z"


_UNSUPPORTED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|\(\?P=|[*+?}]\+")


def anchored_regex(pattern: str) -> str:
    """The whole value must match ``pattern``; Unicode classes; ``.`` excludes the line feed only.

    Look-around, backreferences and possessive repetition are refused, as a
    linear-time engine would refuse them; so are patterns that don't compile.
    """
    plain = re.sub(r"\\\\|\[(?:\\.|[^\]\\])*\]", "x", pattern)
    if _UNSUPPORTED.search(plain):
        raise ValueError(f"unsupported construct in pattern {pattern!r}")
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\[pP]\w|\\z|\[\[:\^?\w+:\]\]", "x", pattern))
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from None
    return rf"(?Ud)\A(?:{pattern})\z"
