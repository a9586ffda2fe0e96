"""Vectorised work on the bytes of many texts at once, for use inside Arrow tasks.

A text is its UTF-8 bytes; null counts as empty. Spans are hashed eight bytes at a time, with
a mix of all bits after each step (longer ones by BLAKE2), so no pattern of bytes makes
texts collide; spans of equal length up to eight bytes never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_SPAN = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string column, and len + 1 offsets into them."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = 1 << 18, docs: int = 4000) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text is a range of its own."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = min(max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1), n, a + docs)
        yield a, b
        a = b


def windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    size = np.asarray(end - start)
    if not len(size):
        return np.zeros(0, np.uint64)
    eight = windows(data if len(data) else np.zeros(1, np.uint8))
    h = mix(size.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019))
    h = mix(h ^ (eight[np.minimum(start, len(eight) - 1)] & LOW_BYTES[np.minimum(size, 8)]))
    live, at = np.flatnonzero(size > 8), 8
    while len(live) and at < LONG_SPAN:
        left = size[live] - at
        h[live] = mix(h[live] * U(0xC2B2AE3D27D4EB4F) + (eight[start[live] + at] & LOW_BYTES[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    if len(live):
        raw = memoryview(np.ascontiguousarray(data))
        ends = zip(start[live].tolist(), end[live].tolist(), strict=True)
        h[live] = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in ends]), np.uint64)
    return h


def ragged(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the indices first[i] .. first[i] + size[i] - 1: their i, and they."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[row]


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each i, whether the size[i] bytes at a_start[i] of a are those at b_start[i] of b."""
    row, at = ragged(a_start, size)
    differ = a[at] != b[at + (b_start - a_start)[row]]
    return np.bincount(row[differ], minlength=len(size)) == 0


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each span's text, first span and hash of each distinct text.

    Hashes only propose: every span is compared with the first of its hash, and those that
    differ are told apart by their bytes.
    """
    import pandas as pd

    h = span_hash(data, start, end)
    code, _ = pd.factorize(h)
    first = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    if not len(code):
        return code, first, h
    size, model = end - start, first[code]
    eight, mask = windows(data if len(data) else np.zeros(1, np.uint8)), LOW_BYTES[np.minimum(size, 8)]
    at = np.minimum(start, len(eight) - 1)
    wrong = (size != size[model]) | (((eight[at] ^ eight[at[model]]) & mask) != 0)
    check = np.flatnonzero(~wrong & (size > 8) & (model != np.arange(len(code))))
    wrong[check] = ~same_bytes(data, start[check], data, start[model[check]], size[check])
    if wrong.any():
        more: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(wrong):
            code[i] = more.setdefault((int(code[i]), data[start[i] : end[i]].tobytes()), len(first) + len(more))
        found = np.full(len(more), len(code))
        np.minimum.at(found, code[wrong] - len(first), np.flatnonzero(wrong))
        first = np.append(first, found)
    return code, first, h[first]


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes within texts: start, end, and number of the text."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offs, s, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: hash, start, end, number of the text."""
    s, e, doc = spans(WORD[data], offs)
    return span_hash(data, s, e), s, e, doc


def shingles(h: np.ndarray, doc: np.ndarray, n: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and their texts, in order of the text.

    A text of fewer words but one at least has its whole sequence as its only shingle.
    """
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    length = np.clip(count, 0, n)
    made = np.where(count >= n, count - n + 1, count > 0).astype(np.int64)
    at = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(made.sum())
    out, owner = np.zeros(len(at), np.uint64), np.repeat(np.arange(n_docs), made)
    size = length[owner]
    for k in range(n):
        has = size > k
        out[has] = mix(out[has] * U(0x100000001B3) + h[at[has] + k])
    return out, owner
