"""Chunking of texts: spans that tile a text, with optional overlap backwards.

``chunk`` works on one text; ``chunks`` is the Arrow-batched column function.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[int, int]
#: Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ")
#: Bytes of text whose chunks are Python objects at a time.
STEP = 1 << 20
CHUNK = "array<struct<text:string,index:int,char_start:int>>"


@dataclass(frozen=True)
class ChunkOptions:
    mode: str = "recursive"
    max_chars: int = 1000
    overlap_chars: int = 100

    def __post_init__(self):
        if self.mode not in ("recursive", "sentence", "markdown"):
            raise ValueError("mode is recursive, sentence or markdown")
        if self.max_chars < 1 or not 0 <= self.overlap_chars < self.max_chars:
            raise ValueError("the overlap is from 0 to less than the chunk's size")


def _merge(spans: list[Span], most: int) -> list[Span]:
    """Neighbours joined from left to right while they fit."""
    out: list[Span] = []
    for s, e in spans:
        if out and e - out[-1][0] <= most:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _cut_after(text: str, ends: list[int], start: int, end: int) -> list[Span]:
    marks = [start, *(x for x in ends if start < x < end), end]
    return list(zip(marks, marks[1:], strict=False))


def _recursive(text: str, start: int, end: int, most: int, level: int = 0) -> list[Span]:
    if end - start <= most:
        return [(start, end)] if end > start else []
    if level == len(SEPARATORS):
        return [(s, min(end, s + most)) for s in range(start, end, most)]
    parts = _cut_after(text, [start + m.end() for m in re.finditer(re.escape(SEPARATORS[level]), text[start:end])], start, end)
    if len(parts) == 1:
        return _recursive(text, start, end, most, level + 1)
    return _merge([x for s, e in parts for x in (_recursive(text, s, e, most, level + 1) if e - s > most else [(s, e)])], most)


def _sentences(text: str, most: int) -> list[Span]:
    parts = _cut_after(text, [m.end() for m in re.finditer(r"[.!?](?=\s|\Z)", text)], 0, len(text))
    return _merge([x for s, e in parts for x in (_recursive(text, s, e, most) if e - s > most else [(s, e)])], most)


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")


def _markdown(text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, start of the section): sections at headings; fenced code is never cut."""
    lines, fence, at = [], "", 0
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        m = _FENCE.match(line.rstrip("\r\n"))
        was = bool(fence)
        if m and not fence:
            fence = m[1]
        elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            fence = ""
        lines.append((at, at + len(line), not was and bool(_HEADING.match(line.rstrip("\r\n"))), was or bool(fence), bool(fence)))
        at += len(line)
    sections: list[list] = []
    for x in lines:
        if x[2] or not sections:
            sections.append([])
        sections[-1].append(x)
    out = []
    for sec in sections:
        start, end = sec[0][0], sec[-1][1]
        if end - start <= most:
            out.append((start, end, start))
            continue
        # Units that may be cut apart: single lines, or lines up to the end of their fence.
        units: list[tuple[int, int, bool]] = []
        opened = None
        for s, e, _, fenced, inside in sec:
            opened = (s if opened is None else opened) if inside or opened is not None else None
            if not inside:
                units.append((s if opened is None else opened, e, fenced))
                opened = None
        if opened is not None:
            units.append((opened, end, True))
        groups: list[tuple[int, int, bool]] = []
        for s, e, fenced in units:
            if groups and e - groups[-1][0] <= most:
                groups[-1] = (groups[-1][0], e, groups[-1][2] or fenced)
            else:
                groups.append((s, e, fenced))
        for s, e, fenced in groups:
            parts = [(s, e)] if fenced or e - s <= most else _recursive(text, s, e, most)
            out.extend((a, b, start) for a, b in parts)
    return out


def chunk(text: str | None, opts: ChunkOptions = ChunkOptions()) -> list[dict]:
    """Chunks {text, index, char_start}; every chunk is the slice of the text at its place. White space alone gives none."""
    if not text or not text.strip():
        return []
    if opts.mode == "markdown":
        spans = _markdown(text, opts.max_chars)
    else:
        spans = [(s, e, 0) for s, e in (_sentences(text, opts.max_chars) if opts.mode == "sentence" else _recursive(text, 0, len(text), opts.max_chars))]
    out, before = [], 0
    for i, (s, e, floor) in enumerate(spans):
        start = max(s - opts.overlap_chars, before, floor) if i and opts.overlap_chars else s
        out.append({"text": text[start:e], "index": i, "char_start": start})
        before = s
    return out


def chunked(col: pa.Array, opts: ChunkOptions, step: int = STEP) -> pa.Array:
    """Chunks of an Arrow column of strings; as Python objects there are those of about ``step`` bytes of text at a time."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("index", pa.int32()), ("char_start", pa.int32())]))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // step
    cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(col)]
    return pa.concat_arrays([pa.array([chunk(t, opts) for t in col.slice(a, b - a).to_pylist()], kind) for a, b in zip(cuts, cuts[1:], strict=False)])


def chunks(text: Column, opts: ChunkOptions = ChunkOptions()) -> Column:
    """Array of chunks of a string column."""

    @F.arrow_udf(CHUNK)
    def of(col: pa.Array) -> pa.Array:
        return chunked(col, opts)

    return of(text)
