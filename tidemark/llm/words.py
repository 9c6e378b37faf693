"""Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts and 64-bit hashes of them, with numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case of A-Z alone.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a chunk of documents, and each document's first word (n + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_WHITE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    starts = np.flatnonzero(word & (~before | border[:-1]))
    ends = np.flatnonzero(word & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(x))]), dtype=np.uint64) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial of its bytes by differences of prefix sums, then mixed."""
    up, down = _power(len(raw))
    ahead = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    h = (ahead[ends] - ahead[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)
