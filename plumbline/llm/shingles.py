"""Word shingles of whole texts as sorted sets of 64-bit hashes, computed over blocks of bytes at once."""

from __future__ import annotations

import numpy as np

from plumbline.llm.common import mixed

#: Bytes between words (blank, and tab to carriage return).
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: A hash of each byte value, so that a word's hash depends on every bit of its bytes.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the row of each. Rows lie end to end; a word never crosses two rows."""
    base = int(at[0])
    x = LOWER[data[base : at[-1]]]
    n = len(x)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~SPACE[x]
    edge = np.zeros(n, bool)  # a row begins here
    starts_at = at[:-1] - base
    edge[starts_at[starts_at < n]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:]
    first, last = np.nonzero(begin)[0], np.nonzero(end)[0] + 1
    if not first.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # sums of byte hash times a power of the place, over each word; then the place is taken out of the sum
    w = np.where(inside, BYTE[x], np.uint64(0))
    size = last - first
    power = _powers(int(size.max()))
    inner = np.arange(n) - np.repeat(first, np.diff(np.append(first, n))) if first[0] == 0 else np.arange(n) - np.concatenate([np.zeros(first[0], np.int64), np.repeat(first, np.diff(np.append(first, n)))])
    w *= power[np.minimum(inner, len(power) - 1)]
    sums = np.add.reduceat(w, first)
    row = np.searchsorted(starts_at, first, "right") - 1
    return mixed(sums ^ (size.astype(np.uint64) << np.uint64(48))), row


def shingle_hashes(at: np.ndarray, data: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle, and the row of each, in text order and with repeats. Rows of fewer words have one
    shingle of all their words; rows without words have none."""
    n_rows = len(at) - 1
    h, row = word_hashes(at, data)
    if not h.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=n_rows)
    out, rows = [], []
    n = len(h)
    if n >= words:
        acc = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            acc = mixed(acc + h[k : n - words + 1 + k] + np.uint64(k + 1))
        whole = row[: n - words + 1] == row[words - 1 :]
        out.append(acc[whole])
        rows.append(row[: n - words + 1][whole])
    short = np.nonzero((count > 0) & (count < words))[0]
    if short.size:
        start = np.concatenate([[0], np.cumsum(count)])[short]
        acc = np.full(len(short), 0x5348, np.uint64)
        for k in range(words - 1):
            has = count[short] > k
            acc[has] = mixed(acc[has] + h[start[has] + k] + np.uint64(k + 101))
        out.append(acc)
        rows.append(short)
    out, rows = np.concatenate(out), np.concatenate(rows)
    return out, rows


def shingle_sets(at: np.ndarray, data: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and where each row's set begins (one more than rows)."""
    h, row = shingle_hashes(at, data, words)
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at) - 1))])
