"""Vectorised scans of many texts at once: words, lines and rolling hashes over one byte buffer.

Every function takes the UTF-8 bytes of a slice of rows (``data``) and the rows' byte offsets
(``offs``, one more than rows). A slice holds at most ``slice_bytes`` unless a single text is
longer, so memory follows the slice or the longest text, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII capitals to small letters, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd bases, 3 modulo 8, of the byte and the word hash, and their inverses modulo 2**64.
_BASE = (0x9E3779B97F4A7C1B, 0xC2B2AE3D27D4EB4B)


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (_BASE[which], _inverse(_BASE[which])):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the usual xor-shift-multiply finish)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    if off is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, slice_bytes: int):
    """Row ranges of at most ``slice_bytes`` bytes, or of one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + slice_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_slices(col: pa.Array, slice_bytes: int = 1 << 20):
    """(first row, end row, data, offs) of each slice of a string column."""
    data, offs = buffers(col)
    for lo, hi in slices(offs, slice_bytes):
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word (a run of bytes other than ASCII white space)."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs, start, side="right") - 1


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(0, len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever the span lies."""
    return mix((prefix[end] - prefix[start]) * powers(0, len(prefix))[1][start])


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of n consecutive words of one row (a rolling hash)."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, inv = powers(1, len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * p[:-1], out=prefix[1:])
    start = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    return start, mix((prefix[start + n] - prefix[start]) * inv[start] + np.uint64(n))


def words_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans (none overlapping) as one Arrow string array, without a loop over words."""
    size = end - start
    offs = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    take = np.zeros(len(data) + 1, np.int8)
    take[start] = 1
    take[end] -= 1  # where a word of the next row begins, the two cancel
    body = np.ascontiguousarray(data[np.cumsum(take[:-1], dtype=np.int8).astype(bool)])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offs), pa.py_buffer(body))


def char_prefix(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
