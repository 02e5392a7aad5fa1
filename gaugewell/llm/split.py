"""Cutting oversized texts into overlapping pieces at natural boundaries, by recursive bisection.

The text is encoded once; a piece is a range of its tokens.  A range longer than limit - overlap is cut at the strongest
boundary near its midpoint and its halves are cut on, then every piece but the first gets the last ``overlap`` tokens of
the one before it.  Strengths, from the top: between cells, between paragraphs (after a blank line), between lines,
between words, between characters.  Near the midpoint is the middle half of the range; where that has no cell, paragraph
or line boundary, one outside it is taken, the nearest of the strongest kind, so that no line is cut while the range
could still be cut between lines.  That can leave pieces of a few tokens beside a long line; a piece of less than an eighth
of what is allowed is joined to a neighbour, over the weaker of its two cuts, if both fit together.  A cut is always a token boundary, and inside a character only if nothing else is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.llm.tokens import BYTE_BPE_50K

KINDS = ("byte", "character", "word", "line", "paragraph", "cell")
_LINE = 3


def strengths(data: bytes, ends: np.ndarray, cell_chars: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each token boundary (0, then the end of each token): its strength, and its offset in characters."""
    b = np.frombuffer(data, np.uint8)
    starts = (b & 0xC0) != 0x80
    chars_before = np.concatenate([[0], np.cumsum(starts)])
    at = np.concatenate([[0], ends])
    whole = np.append(starts, True)[at]
    power = whole.astype(np.int8)
    before = np.concatenate([[0], b])[at]  # the byte on the left of each boundary
    after = np.append(b, 0)[at]
    space_after = (after == 32) | ((after >= 9) & (after <= 13))
    space_before = (before == 32) | ((before >= 9) & (before <= 13))
    power[whole & (space_after | space_before)] = 2
    line_end = (b == 10) | ((b == 13) & (np.append(b[1:], 0) != 10))
    power[np.concatenate([[False], line_end])[at]] = _LINE
    # A line is blank if the last byte before its end that isn't white space belongs to an earlier line.
    index = np.arange(len(b))
    solid = np.where((b != 32) & ~((b >= 9) & (b <= 13)), index, -1)
    last_solid = np.maximum.accumulate(solid) if len(b) else solid
    last_line_end = np.concatenate([[-1], np.maximum.accumulate(np.where(line_end, index, -1))[:-1]]) if len(b) else solid
    blank = line_end & (last_line_end > last_solid)
    power[np.concatenate([[False], blank])[at]] = 4
    if cell_chars:
        power[whole & np.isin(chars_before[at], np.array(cell_chars))] = 5
    return power, chars_before[at]


def bisect(power: np.ndarray, most: int) -> list[int]:
    """The cuts, as token offsets from 0 to the number of tokens, with at most ``most`` tokens between two of them."""
    n = len(power) - 1
    cuts, todo = {0, n}, [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            continue
        mid = (a + b) / 2
        near = max((b - a) // 4, 1)
        lo, hi = max(a + 1, int(mid) - near), min(b - 1, int(mid) + near)
        k = _strongest(power, lo, hi, mid)
        if power[k] < _LINE:
            other = _strongest(power, a + 1, b - 1, mid)
            if power[other] >= _LINE:
                k = other
        cuts.add(k)
        todo += [(a, k), (k, b)]
    return _joined(sorted(cuts), power, most)


def _joined(cuts: list[int], power: np.ndarray, most: int) -> list[int]:
    """The cuts without those that part a very small piece from a neighbour it fits together with."""
    k = 0
    while k < len(cuts) - 1:
        if cuts[k + 1] - cuts[k] < most // 8:
            inner = [c for c in (k, k + 1) if 0 < c < len(cuts) - 1 and cuts[c + 1] - cuts[c - 1] <= most]
            if inner:
                del cuts[min(inner, key=lambda c: power[cuts[c]])]
                k = max(k - 1, 0)
                continue
        k += 1
    return cuts


def _strongest(power: np.ndarray, lo: int, hi: int, mid: float) -> int:
    part = power[lo : hi + 1]
    best = lo + np.flatnonzero(part == part.max())
    return int(best[np.argmin(np.abs(best - mid))])


def pieces_of(ids: np.ndarray, sizes: np.ndarray, data: bytes, cell_chars: list[int], limit: int, overlap: int) -> list[tuple]:
    """(start token, end token, overlap, start char, end char, kind of the cut at the end) of each piece."""
    power, chars = strengths(data, np.cumsum(sizes[ids]), cell_chars)
    cuts = bisect(power, limit - overlap)
    return [
        (a, b, min(overlap, a), int(chars[a]), int(chars[b]), "end" if b == len(ids) else KINDS[power[b]])
        for a, b in zip(cuts, cuts[1:])
    ]


def split_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_col: str | None = "cells",
    limit: int = 2048, overlap: int = 64, path: str = BYTE_BPE_50K, with_ids: bool = True,
) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens.

    One row a piece: id, piece_no (from 0), n_pieces, start_token and end_token (its own tokens, without the overlap),
    overlap (tokens repeated from the piece before), n_tokens (own and repeated), start_char and end_char (code points of
    its own part), cut (what it was cut at) and, with ``with_ids``, its token ids, repeated ones first.

    Null, empty and shorter texts have no rows; a text of at most ``limit`` bytes has at most that many tokens and isn't
    encoded.  Null, odd (bounds outside the text) and missing
    cells give no cell boundaries.  Repeated rows give repeated pieces.
    Other columns are not read.  One text is held by one task, whole; the plan has no shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    fields = [T.StructField(id_col, df.schema[id_col].dataType)]
    fields += [T.StructField(n, T.IntegerType()) for n in ("piece_no", "n_pieces", "start_token", "end_token", "overlap", "n_tokens", "start_char", "end_char")]
    fields += [T.StructField("cut", T.StringType())] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gaugewell.llm.bpe import vocabulary

        v = vocabulary(path)
        sizes = np.zeros(max(v.bytes) + 1, np.int64)
        for i, t in v.bytes.items():
            sizes[i] = len(t)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            owner, held = [], 0

            def flush() -> pa.RecordBatch:
                arrays = [batch.column(0).take(pa.array(owner, pa.int64()))]
                arrays += [pa.array(c, pa.int32()) for c in rows[1:9]] + [pa.array(rows[9], pa.string())]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows[10]])]).astype("<i4")
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows[10]))))
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                ids = v.encode(text)
                if len(ids) <= limit:
                    continue
                cells = batch.column(2)[k].as_py() or []
                found = pieces_of(ids, sizes, text.encode(), [c for c in cells if c is not None], limit, overlap)
                for no, (a, b, o, ca, cb, cut) in enumerate(found):
                    owner.append(k)
                    for c, x in zip(rows[1:], (no, len(found), a, b, o, b - a + o, ca, cb, cut)):
                        c.append(x)
                    if with_ids:
                        rows[10].append(ids[a - o : b])
                        held += b - a + o
                if held > 1 << 20:
                    yield flush()
                    rows, owner, held = [[] for _ in names], [], 0
            if owner:
                yield flush()

    if cells_col and cells_col in df.columns:
        bounds = F.concat(F.col(f"{cells_col}.start_char"), F.col(f"{cells_col}.end_char")).cast("array<int>")
    else:
        bounds = F.lit(None).cast("array<int>")
    text = F.col(text_col).cast("string")
    return df.where(F.octet_length(text) > limit).select(F.col(id_col), text.alias("_text"), bounds.alias("_bounds")).mapInArrow(run, T.StructType(fields))
