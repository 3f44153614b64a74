"""Word and shingle hashes of whole Arrow columns of text, in numpy.

A word is a run of bytes other than ASCII white space (space, 0x09-0x0D) and any further separators asked for. Each byte is
replaced by a 64-bit random number; a word's hash is a polynomial in these modulo 2^64, read off running sums, and
mixed. A shingle's hash is the same over its words' hashes. Work goes piece by piece, so memory is bounded by the piece and
the longest text, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
#: Bytes hashed at a time.
PIECE = 1 << 20
#: Rows and bytes of text handed out together.
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (its three constants are fixed values)."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BASE = 0x2545F4914F6CDD1D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=U) * U(0x51_7C_C1_B7))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(1, n), dtype=U)
    have = 1
    with np.errstate(over="ignore"):
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * U(pow(base, have, 1 << 64))
            have += more
    return out


_POW, _INV = _powers(_BASE, PIECE + 1), _powers(_BASE_INVERSE, PIECE + 1)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Power tables of at least n entries; long ones aren't kept."""
    return (_POW, _INV) if n <= len(_POW) else (_powers(_BASE, n), _powers(_BASE_INVERSE, n))


class Words:
    """How texts are cut and folded: ``lower`` folds A-Z, ``punctuation`` makes ASCII punctuation separate words too."""

    def __init__(self, lower: bool = False, punctuation: bool = False):
        space = np.zeros(256, dtype=bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        if punctuation:
            space[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
        fold = np.arange(256)
        if lower:
            fold[ord("A") : ord("Z") + 1] += 32
        self.inside, self.values = ~space, _BYTE_VALUES[fold]

    def hashes(self, data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every word; no word crosses the start of a text."""
        inside = self.inside[data]
        n = len(data)
        if not n:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(0, dtype=U)
        cut = np.zeros(n + 1, dtype=bool)
        cut[starts_of_texts] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:n]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        out = np.empty(len(begin), dtype=U)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(begin):
                j = int(np.searchsorted(end, begin[i] + PIECE, side="right"))
                if j <= i:  # one word longer than a piece
                    value, at = U(0), int(begin[i])
                    for k in range(at, int(end[i]), PIECE):
                        part = self.values[data[k : min(k + PIECE, int(end[i]))]]
                        value = value + (part * _POW[: len(part)]).sum(dtype=U) * U(pow(_BASE, k - at, 1 << 64))
                    out[i] = value
                    i += 1
                    continue
                low = begin[i]
                part = self.values[data[low : end[j - 1]]]
                sums = np.zeros(len(part) + 1, dtype=U)
                np.cumsum(part * _POW[: len(part)], out=sums[1:])
                out[i:j] = (sums[end[i:j] - low] - sums[begin[i:j] - low]) * _INV[begin[i:j] - low]
                i = j
        return begin, end, mix64(out + (end - begin).astype(U))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U)
    with np.errstate(over="ignore"):
        if n <= 8:
            total = np.zeros(len(hashes) - n + 1, dtype=U)
            for k in range(n):
                total += hashes[k : len(hashes) - n + 1 + k] * U(pow(_BASE, k, 1 << 64))
            return mix64(total)
        power, inverse = _grown(len(hashes))
        sums = np.zeros(len(hashes) + 1, dtype=U)
        np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
        return mix64((sums[n:] - sums[:-n]) * inverse[: len(hashes) - n + 1])


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of a text's n-word shingles in order; the whole sequence is one if it has fewer words, none if it has none."""
    if not len(hashes):
        return np.zeros(0, dtype=U)
    if len(hashes) < n:
        with np.errstate(over="ignore"):
            return mix64(rolling(hashes, len(hashes)) + U(len(hashes)))
    return rolling(hashes, n)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its texts; null is empty."""
    if pa.types.is_string(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return body, at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES; a longer text is a chunk of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def each_text(column: pa.Array, cut: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its row, its bytes, and start and end (in these bytes) and hash of its words."""
    data, offsets = text_buffer(column)
    for i, j in chunks(data, offsets):
        part = data[offsets[i] : offsets[j]]
        begin, end, value = cut.hashes(part, offsets[i:j] - offsets[i])
        at = np.searchsorted(begin, offsets[i : j + 1] - offsets[i])
        for row in range(i, j):
            low, high = at[row - i], at[row - i + 1]
            base = offsets[row] - offsets[i]
            yield row, part[base : offsets[row + 1] - offsets[i]], begin[low:high] - base, end[low:high] - base, value[low:high]
