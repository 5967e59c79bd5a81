"""Vectorised text primitives over Arrow string columns.

Every function works on the raw UTF-8 buffer of a whole batch at once, so the
cost per byte is a few numpy passes and no Python object is made per document
or per word.  Batches are cut by bytes, not rows, which keeps the memory of a
worker flat whatever the length of single documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled by one round of numpy passes.
BLOCK_BYTES = 1 << 20
#: Rows of one round, for what is kept per row.
BLOCK_ROWS = 1024

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_INV = _U64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection that spreads every input bit."""
    x = np.asarray(x, dtype=_U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: is it part of a word, and its hash value after ASCII case folding."""
    b = np.arange(256)
    fold = np.where((b >= 65) & (b <= 90), b + 32, b)
    word = (b >= 128) | ((fold >= 97) & (fold <= 122)) | ((b >= 48) & (b <= 57))
    return word, mix64(fold.astype(_U64) + _U64(0x1234567))


IS_WORD, BYTE_HASH = _word_table()
_POWERS = np.ones(1, dtype=_U64)
_INVERSES = np.ones(1, dtype=_U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, BLOCK_BYTES)
        pair = []
        for base in (_BASE, _INV):
            p = np.full(size, base, dtype=_U64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        if size > 8 * BLOCK_BYTES:  # one long word; not kept
            return pair[0][:n], pair[1][:n]
        _POWERS, _INVERSES = pair
    return _POWERS[:n], _INVERSES[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``most`` bytes of text and ``rows`` rows at most; a longer row is a part of its own."""
    if batch.num_rows == 0:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(batch.num_rows, start + rows, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def _letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(is a byte part of a word, does a character that is a word of its own begin there or end just before it).

    Characters of scripts written without blanks (Chinese, Japanese kana, Thai,
    Lao, Khmer, Burmese) are words of one character; the no-break space, general
    punctuation and the ideographic and full-width punctuation separate words.
    """
    inside = IS_WORD[raw]
    if not (raw >= 0xC2).any():
        return inside, None
    inside = inside.copy()
    lead2 = np.flatnonzero(raw == 0xC2)
    lead2 = lead2[lead2 + 1 < len(raw)]
    gap = lead2[raw[lead2 + 1] == 0xA0]
    inside[gap] = inside[gap + 1] = False
    lead = np.flatnonzero((raw >= 0xE0) & (raw < 0xF0))
    lead = lead[lead + 2 < len(raw)]
    if not len(lead):
        return inside, None
    a, b, c = (raw[lead + k].astype(np.int64) for k in range(3))
    point = ((a & 15) << 12) | ((b & 63) << 6) | (c & 63)
    gap = lead[((point >= 0x2000) & (point < 0x2070)) | ((point >= 0x3000) & (point < 0x3021)) | ((point >= 0xFF01) & (point < 0xFF10)) | ((point >= 0xFF1A) & (point < 0xFF21)) | (point == 0xFEFF)]
    for k in range(3):
        inside[gap + k] = False
    alone = lead[((point >= 0x3041) & (point < 0xA000)) | ((point >= 0xE01) & (point < 0xF00)) | ((point >= 0x1000) & (point < 0x10A0)) | ((point >= 0x1780) & (point < 0x1800)) | ((point >= 0xF900) & (point < 0xFB00))]
    if not len(alone):
        return inside, None
    edge = np.zeros(len(raw) + 1, bool)
    edge[alone] = edge[alone + 3] = True
    return inside, edge[: len(raw)]


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    inside, edge = _letters(raw)
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a row's first byte opens a word even after a word byte
    first = first[:n]
    if edge is not None:
        first |= edge
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    if len(starts) == 0:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    ends_mask = np.empty(n, bool)
    ends_mask[-1] = inside[-1]
    ends_mask[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    ends = np.flatnonzero(ends_mask) + 1
    power, inverse = _powers(n)
    total = np.empty(n + 1, _U64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_HASH[raw] * power, out=total[1:])
        value = (total[ends] - total[starts]) * inverse[starts]
    row = np.searchsorted(offsets, starts, side="right") - 1
    return mix64(value), row


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word in reading order.

    A word is a maximal run of ASCII letters, digits and non-ASCII characters,
    or one character of a script without blanks (see _letters); ASCII case is
    folded.  Words never reach over a row's end.  A word's hash doesn't depend on its place, so
    that a long text is worked through in pieces, cut at bytes that belong to no
    word, and only the words' hashes are kept of it; only a single run of more
    than BLOCK_BYTES word bytes makes a longer piece.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    if n <= 2 * BLOCK_BYTES:
        return _words(raw, offsets)
    value, row, start = [], [], 0
    while start < n:
        stop = min(n, start + BLOCK_BYTES)
        while stop < n:
            gap = np.flatnonzero(raw[stop : stop + 4096] < 0x30)  # white space and ASCII marks, in no word and in no character
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(n, stop + 4096)
        lo, hi = np.searchsorted(offsets, [start, stop], side="right")
        inner = np.concatenate([[0], offsets[lo:hi] - start, [stop - start]])
        v, r = _words(raw[start:stop], inner)
        value.append(v)
        row.append(r + lo - 1)
        start = stop
    return np.concatenate(value), np.concatenate(row)


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word n-gram, repeats included.

    A row with at least one word but fewer than n of them has one n-gram, made
    of all its words; a row without words has none.
    """
    w, row = words(raw, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    if len(w) == 0:
        return w, row
    at = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        salt = [mix64(np.array([17 + k], _U64))[0] | _U64(1) for k in range(n)]
        h = np.zeros(len(w), _U64)
        for k in range(min(n, len(w))):
            h[: len(w) - k] += w[k:] * salt[k]
        last = at[row + 1] - np.arange(len(w))
        keep = last >= n
        for r in np.flatnonzero((count > 0) & (count < n)):  # short rows
            a, b = at[r], at[r + 1]
            h[a] = (w[a:b] * np.array(salt[: b - a])).sum() + _U64(b - a)
            keep[a] = True
    return mix64(h[keep]), row[keep]


def pieces(raw: np.ndarray, over: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, bytes) of the pieces of a buffer, each with the first ``over`` bytes of the next, so that every run of over + 1 bytes lies in one."""
    for start in range(0, max(1, len(raw) - over), BLOCK_BYTES):
        yield start, raw[start : start + BLOCK_BYTES + over]


def rows_of(offsets: np.ndarray, start: int, n: int) -> np.ndarray:
    """The row of each of ``n`` bytes from ``start`` on."""
    inner = np.clip(offsets - start, 0, n)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(inner))


def distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's distinct hashes in ascending order."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[keep], row[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])


def squeeze(a: np.ndarray) -> bytes:
    """The array's bytes, compressed."""
    return zlib.compress(a.tobytes(), 1)


def spread(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype)
