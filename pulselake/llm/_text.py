"""Vectorised word, shingle and hash primitives over Arrow text columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The six bytes that separate words: space and 0x09-0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_WORD = np.ones(256, bool)
_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p)])) for p in (_P, _P_INV))
    return _powers


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each (one row at least): arrays of eight bytes for each byte of text then stay in a core's cache."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = bytes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; rows never share a word."""
    inside = _WORD[buf]
    border = np.zeros(len(buf) + 1, bool)
    border[off] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | border))
    ends = np.flatnonzero(before & (~after | border))
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every byte span; equal spans have equal hashes at any place."""
    p, inv = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(mix(buf.astype(np.uint64) + np.uint64(1 + seed * 1000)) * p[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def case_folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``bytes_of``, with the case of every script folded and composed and compatibility forms made one (NFKC)."""
    buf, off = bytes_of(column)
    if not len(buf) or buf.max() < 128:
        return lowered(buf), off
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    return bytes_of(pa.array([t.lower() if t.isascii() else nfkc(nfkc(t).casefold()) for t in column.fill_null("").to_pylist()], pa.large_string()))


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every row, with n_rows + 1 offsets.

    A row with fewer than k words gives its whole sequence as one shingle, or none with
    ``whole_if_short=False``; a row without words gives none.
    """
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    coef = [mix(np.uint64([0x1234567 + 77 * j]))[0] | np.uint64(1) for j in range(k)]
    acc = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        acc += mix(words[j : j + len(acc)] + np.uint64(j)) * coef[j]
    ok = rows[: len(acc)] == rows[k - 1 : k - 1 + len(acc)]
    hashes, at = mix(acc[ok] + np.uint64(k)), rows[: len(acc)][ok]
    if whole_if_short:
        extra_h, extra_r = [], []
        for r in np.flatnonzero((count > 0) & (count < k)):
            h = np.uint64(count[r])
            for w in words[first[r] : first[r + 1]]:
                h = mix(h * np.uint64(0x100000001B3) ^ w)
            extra_h.append(h)
            extra_r.append(r)
        if extra_r:
            hashes, at = np.concatenate([hashes, np.array(extra_h, np.uint64)]), np.concatenate([at, np.array(extra_r)])
            order = np.argsort(at, kind="stable")
            hashes, at = hashes[order], at[order]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n_rows))])


def text_shingles(column: pa.Array, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased k-word shingles of a text column."""
    buf, off = bytes_of(column)
    buf = lowered(buf)
    starts, ends, rows = word_spans(buf, off)
    with np.errstate(over="ignore"):
        return shingles(span_hashes(buf, starts, ends), rows, len(column), k, whole_if_short)
