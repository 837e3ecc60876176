"""Words and word shingles of whole texts as 64-bit fingerprints, computed for a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandline.llm.common import blob_of, mix64

#: Texts are taken in slices of about so many bytes, and their words in blocks, so that the arrays of each stay small.
SLICE_BYTES, BLOCK_BYTES = 512 << 10, 256 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """_BASE^i and its inverse for i < n, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def text_slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of consecutive texts, null as empty, about limit bytes at a time; a longer text stays whole."""
    if not len(texts):
        return
    flat, offsets = blob_of(pc.fill_null(texts, ""))
    cuts = np.flatnonzero(np.diff(offsets[1:] // limit)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        yield ids.slice(a, b - a), flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, text index) of each word [^\\x20\\x09-\\x0D]+ in order, with A-Z as a-z."""
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(_SPACE[flat])
    cuts = gaps[np.searchsorted(gaps, np.arange(BLOCK_BYTES, len(flat), BLOCK_BYTES)).clip(max=max(0, len(gaps) - 1))] if len(gaps) else gaps
    cuts = np.unique(np.concatenate([[0], cuts, [len(flat)]]))
    found = [_words(flat, offsets, a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _words(flat: np.ndarray, offsets: np.ndarray, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """words() of flat[begin:stop], where no word lies across begin or stop."""
    part, low, high = flat[begin:stop], *np.searchsorted(offsets, [begin, stop + 1])
    edge = np.zeros(len(part) + 1, bool)
    edge[0] = edge[-1] = True
    edge[offsets[low:high] - begin] = True
    word = ~_SPACE[part]
    starts = np.flatnonzero(word & (edge[:-1] | np.append(True, ~word[:-1])))
    ends = np.flatnonzero(word & (edge[1:] | np.append(~word[1:], True))) + 1
    up, down = _powers(len(part) + 1)
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_LETTER[part] * up[: len(part)], out=total[1:])
    marks = (total[ends] - total[starts]) * down[starts]
    return mix64(marks + (ends - starts).astype(np.uint64)), np.searchsorted(offsets, starts + begin, side="right") - 1


def sort_each(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """values with each part between neighbouring bounds sorted in place."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    return values


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bounds): the distinct shingles of text i, sorted, are fingerprints[bounds[i]:bounds[i + 1]].

    A text of fewer than size words has its whole sequence as the only shingle; a text without words has none.
    """
    n = len(offsets) - 1
    w, text = words(flat, offsets)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    many = np.where(count >= size, count - size + 1, count > 0)
    bounds = np.append(0, np.cumsum(many))
    marks = np.zeros(bounds[-1], np.uint64)
    if len(w) >= size:
        whole = np.flatnonzero(text[: len(w) - size + 1] == text[size - 1 :])
        long = np.zeros(len(whole), np.uint64)
        for k in range(size):
            long = long * np.uint64(_STEP) + w[whole + k]
        marks[whole - first[text[whole]] + bounds[text[whole]]] = mix64(long + np.uint64(size))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = count[short] > k
            extra[more] = extra[more] * np.uint64(_STEP) + w[first[short[more]] + k]
        marks[bounds[short]] = mix64(extra + count[short].astype(np.uint64))
    sort_each(marks, bounds)
    fresh = np.ones(len(marks), bool)
    fresh[1:] = marks[1:] != marks[:-1]
    fresh[bounds[:-1][many > 0]] = True
    return marks[fresh], np.append(0, np.cumsum(fresh))[bounds]


def set_prints(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One signed 64-bit fingerprint of each set."""
    total = np.append(np.uint64(0), np.cumsum(mix64(marks ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64))
    size = np.diff(bounds).astype(np.uint64)
    return mix64((total[bounds[1:]] - total[bounds[:-1]]) * np.uint64(_STEP) + size).view(np.int64)
