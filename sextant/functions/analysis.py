"""Text analysis for full-text search: tokens, folding, stopwords and stemming.

Analysis is a plain function of a string, applied inside Arrow batches; stems of
single words are remembered, so the cost follows the vocabulary.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import regex

#: Fixed value: English stopwords; those with an apostrophe never match, as it separates tokens.
STOPWORDS = frozenset(
    """a about above after again against all am an and any are aren't as at be because been before being below between
    both but by can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further
    had hadn't has hasn't have haven't having he her here hers herself him himself his how i if in into is isn't it its itself
    just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same shan't she
    should shouldn't so some such than that the their theirs them themselves then there these they this those through to too
    under until up very was wasn't we were weren't what when where which while who whom why will with won't would wouldn't
    you your yours yourself yourselves""".split()
)
#: Latin letters without a decomposition.
_SPECIAL = {"æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "ħ": "h", "ı": "i", "ĳ": "ij", "ĸ": "k", "ł": "l", "ŀ": "l", "ŋ": "n", "ŉ": "n", "ŧ": "t", "ſ": "s"}
TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}]+")


@dataclass(frozen=True)
class Analyzer:
    """Tokens are lower-cased; those of more than ``max_token_len`` characters are dropped before the other steps."""

    stem: bool = True
    stopwords: bool = True
    fold: bool = True
    max_token_len: int | None = None

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(term, start, end) of each token that gives a term."""
        out = []
        for m in TOKEN.finditer(text or ""):
            term = self.term(m[0].lower())
            if term and (self.max_token_len is None or m.end() - m.start() <= self.max_token_len):
                out.append((term, m.start(), m.end()))
        return out

    def terms(self, text: str) -> list[str]:
        return [t for t, _, _ in self.spans(text)]

    def term(self, token: str) -> str:
        if self.fold:
            token = fold_latin(token)
        if self.stopwords and token in STOPWORDS:
            return ""
        return stem(token) if self.stem else token


@lru_cache(1 << 16)
def fold_latin(token: str) -> str:
    """Letters of Latin-1 and Latin Extended-A without their marks; other characters stay."""
    if token.isascii():
        return token

    def one(ch: str) -> str:
        if not 0xC0 <= ord(ch) <= 0x17F:
            return ch
        ch = ch.lower()
        return _SPECIAL.get(ch[0]) or "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))

    return "".join(map(one, token))


# --- Porter's stemmer (1980, with the revised rules for -bli and -logi) ---------------------------------------------

#: Porter's suffix rules.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
_WORD = regex.compile("[a-z]{3,}")


def _shape(w: str) -> str:
    """c and v per letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """Stem of a word of three or more letters a-z; any other word stays."""
    if not _WORD.fullmatch(w):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                body = w[: -len(end)]
                if "v" in _shape(body):
                    if body.endswith(("at", "bl", "iz")):
                        body += "e"
                    elif len(body) > 1 and body[-1] == body[-2] and _shape(body)[-1] == "c" and body[-1] not in "lsz":
                        body = body[:-1]
                    elif _measure(body) == 1 and _short(body):
                        body += "e"
                    w = body
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, new in rules:
            if w.endswith(end):
                if _measure(w[: -len(end)]):
                    w = w[: -len(end)] + new
                break
    for end in _STEP4:
        if w.endswith(end) and _measure(w[: -len(end)]) > 1:
            w = w[: -len(end)]
            break
    else:
        if w.endswith(("sion", "tion")) and _measure(w[:-3]) > 1:
            w = w[:-3]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# --- highlighting ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Highlight:
    max_fragments: int = 1
    fragment_chars: int = 160

    def fragments(self, text: str, terms: set[str], analyzer: Analyzer) -> list[dict]:
        """Fragments {text, spans} around the matched words; spans are byte offsets in the fragment.

        A fragment starts half its budget before its first match and takes in
        every match that ends inside; both ends are moved to word boundaries.
        """
        hits = [(s, e) for t, s, e in analyzer.spans(text) if t in terms]
        budget, out, at = max(1, self.fragment_chars), [], 0
        while at < len(hits) and len(out) < max(1, self.max_fragments):
            first = hits[at]
            start = max(0, first[0] - budget // 2)
            if start:
                while start < first[0] and text[start - 1].isalnum():
                    start += 1
                while start < first[0] and not text[start].isalnum():
                    start += 1
            end = min(len(text), max(start + budget, first[1]))
            inside = [first]
            at += 1
            while at < len(hits) and hits[at][1] <= end:
                inside.append(hits[at])
                at += 1
            if end < len(text):
                back = end
                while back > inside[-1][1] and text[back].isalnum():
                    back -= 1
                end = back
            part = text[start:end]
            out.append({"text": part, "spans": [[len(text[start:s].encode()), len(text[start:e].encode())] for s, e in inside]})
        return out
