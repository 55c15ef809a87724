"""Splitting oversized items at natural boundaries, by recursive bisection.

An item above the limit is cut at the strongest boundary near its midpoint, each half is cut again while it is longer
than the limit less the overlap, and every piece but the first is then extended backwards by the overlap, moved to the
nearest start of a word.

Near the midpoint means: of the strongest class that has a boundary leaving more than an overlap on either side, the
boundary nearest to the middle; if no class has one, any boundary inside. A hard cut is made only in a stretch without
white space longer than the limit; a shorter one stays whole and takes as much overlap as the limit leaves.

The boundary class of an item is found by the same bisection: run over the boundaries of one class and the stronger
ones, it fits if every part it cannot cut further is within the limit.

Boundaries, strongest first: ``paragraph`` (line end, then only spaces, tabs or CR, line end), ``sentence`` (white
space after one of ``.!?`` and before A-Z or ``(``), ``space`` (any white space), ``none`` (a hard cut). White space
is space, tab, CR and LF. Offsets count code points and pieces are exact slices of the text.

Defined results
* null, empty and short texts are not oversized and give no row;
* a text without white space is cut hard; a text of white space only is one gap and is cut hard too;
* ``level`` of an item is the first boundary class that leaves no stretch above the limit, white space at the ends
  of a stretch not counted;
* repeated rows count once; extra columns are ignored; texts of any length are processed whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1600, 160
LEVELS = ("paragraph", "sentence", "space", "none")
BLANK = " \t\r\n"
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n[ \t\r\n]*")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\n]+(?=[A-Z(])")
_SPACE = re.compile(r"[ \t\r\n]+")


def boundaries(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of the white-space gaps of each level; a level includes the gaps of the stronger ones."""
    paragraph = [m.span() for m in _PARAGRAPH.finditer(text)]
    sentence = [m.span() for m in _SENTENCE.finditer(text)]
    space = [m.span() for m in _SPACE.finditer(text)]
    return [paragraph, sorted({*paragraph, *sentence}), space]


def bisect(length: int, room: int, choose: Callable[[int, int], tuple[int, str] | None]) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """(cuts in order, parts longer than ``room`` that could not be cut) of a span of ``length``.

    Every part longer than ``room`` is cut where ``choose(lo, hi)`` says, until it says None.
    """
    cuts: list[tuple[int, str]] = []
    whole: list[tuple[int, int]] = []
    stack = [(0, length)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= room:
            continue
        found = choose(lo, hi)
        if found is None:
            whole.append((lo, hi))
            continue
        cuts.append(found)
        stack += [(lo, found[0]), (found[0], hi)]
    return sorted(cuts), sorted(whole)


def _nearest(ends: list[int], lo: int, hi: int) -> int | None:
    """The place in lo..hi nearest to their middle, the earlier of two; None if there is none."""
    i, j = bisect_left(ends, lo), bisect_right(ends, hi)
    if i >= j:
        return None
    k = bisect_left(ends, (lo + hi + 1) // 2, i, j)
    return min((ends[x] for x in (k - 1, k) if i <= x < j), key=lambda e: (abs(2 * e - lo - hi), e))


def level_of(text: str, limit: int = LIMIT) -> str:
    """The first boundary class whose bisection leaves no part above the limit, white space at its ends not counted."""
    for name, gaps in zip(LEVELS, boundaries(text)):
        ends = [b for _, b in gaps]

        def choose(lo: int, hi: int, ends: list[int] = ends, name: str = name) -> tuple[int, str] | None:
            at = _nearest(ends, lo + 1, hi - 1)
            return None if at is None else (at, name)

        _, whole = bisect(len(text), limit, choose)
        if all(len(text[lo:hi].strip(BLANK)) <= limit for lo, hi in whole):
            return name
    return "none"


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(offset, boundary class) of the cuts, in order. Pieces between cuts are at most limit - overlap long, or at most
    the limit where they have no boundary inside."""
    room = limit - overlap
    levels = boundaries(text)
    ends, heads = ([[gap[side] for gap in gaps] for gaps in levels] for side in (1, 0))

    def choose(lo: int, hi: int) -> tuple[int, str] | None:
        # first ends of gaps that leave much on either side, then any, then starts of gaps that reach to the end
        for margin, places in ((min(overlap, (hi - lo) // 4) + 1, ends), (1, ends), (1, heads)):
            if places is heads and hi - lo <= limit:
                break
            for name, own in zip(LEVELS, places):
                at = _nearest(own, lo + margin, hi - margin)
                if at is not None:
                    return at, name
        return None if hi - lo <= limit else ((lo + hi) // 2, "none")

    return bisect(len(text), room, choose)[0]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, class of the cut at its start) of the pieces, offsets into ``text``; [] if it is not oversized."""
    if len(text) <= limit:
        return []
    starts = [(0, "start"), *cut_points(text, limit, overlap)]
    words = [m.end() for m in _SPACE.finditer(text)]
    pieces: list[tuple[int, int, str]] = []
    for i, (start, kind) in enumerate(starts):
        end = starts[i + 1][0] if i + 1 < len(starts) else len(text)
        if i:
            # a word start within half an overlap of the wanted place, after the start of the piece before
            first = max(pieces[-1][0] + 1, end - limit)
            want = max(first, start - overlap)
            at = _nearest_to(words, want, max(first, want - overlap // 2), min(start - 1, want + overlap // 2))
            start = want if at is None else at
        pieces.append((start, end, kind))
    return pieces


def _nearest_to(ends: list[int], want: int, lo: int, hi: int) -> int | None:
    i, j = bisect_left(ends, lo), bisect_right(ends, hi)
    return min(ends[i:j], key=lambda e: (abs(e - want), e), default=None)


_PIECES = pa.schema([("chunk_id", pa.string()), ("section", pa.string()), ("piece", pa.int32()), ("cut", pa.string()), ("level", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("text", pa.string())])
PIECES_DDL = "chunk_id string, section string, piece int, cut string, level string, start_char long, end_char long, text string"


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The items above the limit, each once; the filter runs in the JVM before any shuffle or Python."""
    slim = chunks.where(F.char_length("text") > limit).select("chunk_id", "section", "start_char", "text")
    return slim.distinct()


def split_items(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, section, piece, cut, level, start_char, end_char, text of every piece of every oversized item.

    start_char and end_char of a piece are offsets into the whole section: the item's start_char (0 if null) plus
    the place of the piece in the item's text.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _PIECES]
            for row in batch.to_pylist():
                text, base = row["text"], row["start_char"] or 0
                level = level_of(text, limit)
                for n, (a, b, kind) in enumerate(split_text(text, limit, overlap)):
                    for column, value in zip(out, (row["chunk_id"], row["section"], n, kind, level, base + a, base + b, text[a:b])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _PIECES)], schema=_PIECES)

    return oversized(chunks, limit).mapInArrow(pieces, PIECES_DDL)
