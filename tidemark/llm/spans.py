"""Splitting UTF-8 text into pre-tokens with numpy and a bounded worker cache keyed by their bytes.

``gpt_spans`` gives the pieces of the byte-level pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``; ``space_spans`` the pieces that begin
at a run of blanks. Both cover every byte of every document, in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from tokenizers.pre_tokenizers import ByteLevel

from tidemark.llm.common import ragged

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
_WHITE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_UNKNOWN = 255
_classes: np.ndarray | None = None
_by_library = ByteLevel(add_prefix_space=False, use_regex=True)


def _classes_of(codes: np.ndarray) -> np.ndarray:
    """Classes of distinct code points as the tokenizers library has them: its Unicode version is neither that of the
    standard library nor that of other packages. A character is a letter if it joins one, a number if it joins one."""
    out = np.full(len(codes), OTHER, np.uint8)
    for probe, kind in (("a", LETTER), ("1", NUMBER)):
        text = "".join(f"{probe}{chr(c)}\n\n" for c in codes.tolist())
        joined = [start // 4 for _, (start, end) in _by_library.pre_tokenize_str(text) if end - start == 2 and start % 4 == 0]
        out[joined] = kind
    out[np.isin(codes, list(_WHITE))] = WHITE
    return out


def char_classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point; the table is filled for the code points that occur."""
    global _classes
    if _classes is None:
        _classes = np.full(0x110000, _UNKNOWN, np.uint8)
        _classes[:256] = _classes_of(np.arange(256))
    found = _classes[codes]
    if (found == _UNKNOWN).any():
        new = np.unique(codes[found == _UNKNOWN])
        _classes[new] = _classes_of(new)
        found = _classes[codes]
    return found


def _code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and the byte at which each starts."""
    if not len(raw) or raw.max() < 0x80:
        return raw.astype(np.uint32), np.arange(len(raw))
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return codes, np.flatnonzero((raw & 0xC0) != 0x80)


def gpt_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens of a chunk of documents, and the index of each document's first one (n + 1).

    Documents are the byte ranges between ``offsets``. An empty document has no pre-token.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    codes, at = _code_points(raw)
    kind = char_classes(codes)
    n = len(codes)
    doc_first = np.searchsorted(at, offsets)  # code point index of each document's start
    begins = np.zeros(n + 1, bool)
    begins[doc_first] = True
    begins[n] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= begins[:n]
    cut = change.copy()
    # a blank or other white space before a run of the same document
    last_white = (kind == WHITE) & np.append(change[1:], True) & ~begins[1:]
    w = np.flatnonzero(last_white)
    cut[w] = True  # a run of white space leaves its last one to what follows
    cut[w[codes[w] == 0x20] + 1] = False  # which a blank joins
    # contractions
    q = np.flatnonzero((codes == 0x27) & cut)
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == LETTER) & ~begins[q + 1]]
    if len(q):
        second = codes[q + 1]
        third = codes[np.minimum(q + 2, n - 1)]
        third = np.where((q + 2 < n) & ~begins[np.minimum(q + 2, n)], third, 0)
        one = np.isin(second, [ord(c) for c in "stmd"])
        two = ((second == ord("r")) | (second == ord("v"))) & (third == ord("e")) | (second == ord("l")) & (third == ord("l"))
        cut[q[one | two] + 1] = False
        end = np.concatenate([q[one] + 2, q[two] + 3])
        end = end[end < n]
        cut[end[kind[end] == LETTER]] = True
    starts = np.flatnonzero(cut)
    return at[starts], np.searchsorted(starts, doc_first)


def space_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pieces that begin at a document's start or at a blank after a non-blank, and each document's
    first one (n + 1). U+2581 is a blank too: sentencepiece writes blanks so."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = raw == 0x20
    marks = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81))
    for k in range(3):
        blank[marks + k] = True
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


class SpanCache:
    """Values of pre-tokens by their bytes: a bounded number of integer arrays in one flat array.

    ``encode`` maps a list of distinct byte strings to a list of integer sequences. Spans of up to 16 bytes are found by
    those bytes and their length in an open-addressed numpy table, longer ones in a dictionary. When the cache is full,
    the half that was asked for longest ago gives way, so memory is bounded and results never depend on what it holds.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], entries: int = 600_000):
        self.encode, self.entries, self.tick = encode, entries, 0
        self.bits = int(2 * entries - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.n = 0
        room = 1 << 12
        self.one, self.two = np.zeros(room, np.uint64), np.zeros(room, np.uint64)
        self.size, self.asked = np.zeros(room, np.int32), np.zeros(room, np.int32)
        self.start, self.length = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0
        self.long: dict[bytes, int] = {}

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(array):
            return array
        grown = np.zeros(max(2 * len(array), used + more), array.dtype)
        grown[:used] = array[:used]
        return grown

    @staticmethod
    def _mix(one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        mixed = one * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= (two + size.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return mixed

    def _place(self, slots: np.ndarray) -> None:
        """Enter slots, whose keys are not in the table yet."""
        at = (self._mix(self.one[slots], self.two[slots], self.size[slots]) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(slots):
            free = np.flatnonzero(self.table[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            done = free[first]
            self.table[at[done]] = slots[done]
            left = np.ones(len(slots), bool)
            left[done] = False
            slots, at = slots[left], (at[left] + 1) & (len(self.table) - 1)

    def _store(self, values: list) -> np.ndarray:
        """New slots for ``values``; their keys are the caller's to enter."""
        lengths = np.fromiter(map(len, values), np.int64, len(values))
        more, new = int(lengths.sum()), np.arange(self.n, self.n + len(values))
        for name in ("one", "two", "size", "asked", "start", "length"):
            setattr(self, name, self._room(getattr(self, name), self.n, len(values)))
        self.flat = self._room(self.flat, self.used, more)
        if more:
            alike = bool((lengths == lengths[0]).all())  # as rows of one array, which is faster
            self.flat[self.used : self.used + more] = np.array(values, np.int32).ravel() if alike else np.concatenate([np.asarray(v, np.int32) for v in values])
        self.start[new] = self.used + np.cumsum(lengths) - lengths
        self.length[new], self.asked[new] = lengths, self.tick
        self.n += len(new)
        self.used += more
        return new

    def _halve(self) -> None:
        slots = np.argsort(-self.asked[: self.n], kind="stable")[: self.entries // 2]
        old = {name: getattr(self, name)[slots] for name in ("one", "two", "size", "asked")}
        moved = np.full(self.n, -1, np.int64)
        moved[slots] = np.arange(len(slots))
        values = np.split(self.flat[ragged(self.start[slots], self.length[slots])], np.cumsum(self.length[slots])[:-1])
        long = {k: int(moved[s]) for k, s in self.long.items() if moved[s] >= 0}
        self._clear()
        new = self._store(values)
        for name, x in old.items():
            getattr(self, name)[new] = x
        self.long = long
        self._place(new[self.size[new] <= 16])

    def _find(self, one: np.ndarray, two: np.ndarray, size: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        at = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(one), -1, np.int64)
        todo = np.arange(len(one))
        while len(todo):
            slot = self.table[at]
            there = slot >= 0
            hit = there & (self.one[slot] == one[todo]) & (self.two[slot] == two[todo]) & (self.size[slot] == size[todo])
            out[todo[hit]] = slot[hit]
            there &= ~hit
            todo, at = todo[there], (at[there] + 1) & (len(self.table) - 1)
        return out

    def lookup(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in ``flat`` and length of each span's value; both hold until the next call."""
        n, self.tick = len(starts), self.tick + 1
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = (ends - starts).astype(np.int32)
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        words = np.ndarray((len(raw) + 9,), np.uint64, padded, 0, (1,))  # the 8 bytes from each position on
        masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        one = words[starts] & masks[np.minimum(size, 8)]
        two = words[np.minimum(starts + 8, len(raw))] & masks[np.clip(size - 8, 0, 8)]
        mixed = self._mix(one, two, size)
        short = size <= 16
        all_short = bool(short.all())
        data = None
        for turn in range(2):  # a second time after the older half gave way
            slot = np.full(n, -1, np.int64)
            room = self.entries - self.n
            if all_short:
                slot = self._find(one, two, size, mixed)
            else:
                s = np.flatnonzero(short)
                slot[s] = self._find(one[s], two[s], size[s], mixed[s])
                data = data or raw.tobytes()
                far = np.flatnonzero(~short)
                spelled = [data[a:b] for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
                slot[far] = [self.long.get(k, -1) for k in spelled]
            have = slot >= 0
            self.asked[slot[have]] = self.tick
            missing = np.flatnonzero(~have)
            if turn or len(missing) <= room or not self.n:
                break
            self._halve()
        data = data or (raw.tobytes() if len(missing) else b"")
        while len(new := missing[short[missing]]):
            codes, distinct = pd.factorize(mixed[new])
            shown = np.zeros(len(distinct), np.int64)
            shown[codes] = new
            made = self._store(self.encode([data[a:b] for a, b in zip(starts[shown].tolist(), ends[shown].tolist(), strict=True)]))
            self.one[made], self.two[made], self.size[made] = one[shown], two[shown], size[shown]
            if self.n > len(self.table) * 3 // 4:  # one chunk with more distinct spans than the cache was made for
                self.bits += 1
                self.table = np.full(1 << self.bits, -1, np.int32)
                self._place(np.flatnonzero(self.size[: self.n] <= 16))
            else:
                self._place(made)
            slot[new] = self._find(one[new], two[new], size[new], mixed[new])
            missing = np.flatnonzero(slot < 0)  # spans of the same mixed value but other bytes go again
        if len(missing):
            spelled = [data[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            fresh = [k for k in dict.fromkeys(spelled) if k not in self.long]
            made = self._store(self.encode(fresh))
            self.size[made] = 17
            self.long.update(zip(fresh, made.tolist(), strict=True))
            slot[missing] = [self.long[k] for k in spelled]
        self.slots = slot
        return self.start[slot], self.length[slot]

    def counted(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> list[tuple[bytes, int]]:
        """The most frequent spans of the last lookup and how often they occur."""
        if not len(starts):
            return []
        counts = np.bincount(self.slots)
        shown = np.zeros(len(counts), np.int64)
        shown[self.slots] = np.arange(len(starts))
        top = np.argsort(-counts, kind="stable")[:most]
        top = top[counts[top] > 0]
        return [(raw[starts[i] : ends[i]].tobytes(), int(n)) for i, n in zip(shown[top].tolist(), counts[top].tolist(), strict=True)]

    def spelled(self) -> tuple[np.ndarray, pa.Array]:
        """All keys as bytes, and their slots."""
        long = {s: k for k, s in self.long.items()}
        short = np.flatnonzero(self.size[: self.n] <= 16)
        pairs = np.stack([self.one[short], self.two[short]], 1).astype("<u8").view(np.uint8).reshape(-1, 16)
        flat = pairs[np.arange(16) < self.size[short, None]]
        offsets = np.concatenate([[0], np.cumsum(self.size[short])]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(short), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        return np.concatenate([short, np.array(list(long), np.int64)]), pa.concat_arrays([words, pa.array(list(long.values()), pa.binary())])

    def ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values one after another, and each span's length."""
        first, lengths = self.lookup(raw, starts, ends)
        return self.flat[ragged(first, lengths)], lengths
