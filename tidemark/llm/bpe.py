"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token is a row of leaves; leaf ``i`` holds the rank of the pair that starts at symbol ``i`` and inner nodes
the least rank below. The root gives the lowest rank, the walk down (left child first) its leftmost place; a merge
changes three leaves and their ancestors. numpy runs this for many pre-tokens of like length at once, one merge each
per step, so a pre-token of n bytes takes O(n log n) and a batch no Python work per symbol.

Cases: a null or empty text has no ids and decodes to the empty text; ties of rank go to the leftmost pair; strings of
special tokens inside a text become their ids, as the library does by default; texts of any length are whole; repeated
rows give repeated results; other columns pass by unread.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, chunks, ragged, text_buffer, whole_text, worker_state
from tidemark.llm.spans import SpanCache, gpt_spans

#: No pair to merge.
NONE = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Rank and merged symbol of a pair of symbols: an open-addressed numpy hash table looked up for many pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(left)) - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1), np.uint64)
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = self._key(left, right)
        todo, self.probes = np.arange(len(keys)), 0
        slots = self._slot(keys)
        while len(todo):
            self.probes += 1
            free = self.keys[slots[todo]] == np.uint64(2**64 - 1)
            _, firsts = np.unique(slots[todo][free], return_index=True)
            placed = todo[free][firsts]
            self.keys[slots[placed]], self.rank[slots[placed]], self.merged[slots[placed]] = keys[placed], placed, merged[placed]
            todo = np.setdiff1d(todo, placed)
            slots[todo] = (slots[todo] + 1) & (size - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 where it is none; a negative symbol makes no pair."""
        keys = self._key(np.maximum(left, 0), np.maximum(right, 0))
        slots, out = self._slot(keys), np.full(len(keys), -1, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes + 1):
            if not len(todo):
                break
            at = slots[todo]
            here = self.keys[at]
            hit = here == keys[todo]
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (here != np.uint64(2**64 - 1))]
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slots = self.find(left, right)
        return np.where(slots >= 0, self.rank[slots], NONE)


class SegmentTreeBpe:
    """The merges of a byte-level ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab = said["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])], np.int32)
        ids = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], np.int32).reshape(-1, 3)
        self.pairs = PairTable(ids[:, 0], ids[:, 1], ids[:, 2])
        self.special = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        pieces = {i: bytes(symbols[c] for c in t) if all(c in symbols for c in t) else t.encode() for t, i in vocab.items()}
        pieces |= {i: t.encode() for t, i in self.special.items()}
        self.piece = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_length = np.array([len(p) for p in self.piece], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(self.piece), np.uint8)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        out: list = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        sizes = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for size in np.unique(sizes):
            step = max(1, (1 << 19) // int(size))
            rows = np.flatnonzero(sizes == size)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                ids, kept = self._encode_rows([pieces[i] for i in part], lengths[part], int(size))
                for i, piece in zip(part.tolist(), np.split(ids, np.cumsum(kept)[:-1]), strict=True):
                    out[i] = piece
        return out

    def _encode_rows(self, pieces: list[bytes], lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        n, wide = len(pieces), size + 2  # two spare columns: -1 marks the end, and the place before the start
        symbol = np.full((n, wide), -1, np.int32)
        held = np.arange(size)[None, :] < lengths[:, None]
        symbol[:, :size][held] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.minimum(np.arange(1, wide + 1), size), (n, 1))
        before = np.tile(np.arange(-1, wide - 1), (n, 1))
        before[:, 0] = size + 1
        tree = np.full((n, 2 * size), NONE, np.int32)
        if size > 1:
            tree[:, size : 2 * size - 1] = self.pairs.ranks(symbol[:, : size - 1].ravel(), symbol[:, 1:size].ravel()).reshape(n, -1)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < NONE) if size > 1 else np.zeros(0, np.int64)
        while len(live):
            least = tree[live, 1]
            node = np.ones(len(live), np.int64)
            while node[0] < size:
                node *= 2
                node += tree[live, node] != least
            i = node - size
            j = after[live, i]
            k = after[live, j]
            p = before[live, i]
            symbol[live, i] = self.pairs.merged[self.pairs.find(symbol[live, i], symbol[live, j])]
            symbol[live, j] = -1
            after[live, i] = k
            before[live, k] = i
            self._set(tree, live, j, size, np.full(len(live), NONE, np.int32))
            self._set(tree, live, i, size, self.pairs.ranks(symbol[live, i], symbol[live, k]))
            has = p < size
            self._set(tree, live[has], p[has], size, self.pairs.ranks(symbol[live[has], p[has]], symbol[live[has], i[has]]))
            live = live[tree[live, 1] < NONE]
        left = symbol[:, :size] >= 0
        return symbol[:, :size][left], left.sum(1)

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, size: int, value: np.ndarray) -> None:
        node = leaf + size
        tree[rows, node] = value
        while len(node) and node[0] > 1:
            node = node // 2
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after another, and each id's number of bytes."""
        lengths = self.piece_length[ids]
        return self.piece_bytes[ragged(self.piece_start[ids], lengths)], lengths


def with_specials(raw: np.ndarray, offsets: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut documents at the strings of special tokens: offsets of the parts, each part's special id or -1, and the
    first part of each document (n + 1). Leftmost first, then longest."""
    data = raw.tobytes()
    found = []
    names = sorted(((t.encode(), i) for t, i in special.items()), key=lambda x: -len(x[0]))
    if any(t in data for t, _ in names):
        import re

        rule, ids = re.compile(b"|".join(re.escape(t) for t, _ in names)), dict(names)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found += [(a + m.start(), a + m.end(), ids[m.group()]) for m in rule.finditer(data[a:b])]
    if not found:
        return offsets, np.full(len(offsets) - 1, -1, np.int64), np.arange(len(offsets))
    parts, kinds, first = [], [], [0]
    k = 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        at = a
        while k < len(found) and found[k][0] < b:
            parts += [at, found[k][0]]
            kinds += [-1, found[k][2]]
            at = found[k][1]
            k += 1
        parts.append(at)
        kinds.append(-1)
        first.append(len(parts))
    return np.array([*parts, offsets[-1]], np.int64), np.array(kinds, np.int64), np.array(first, np.int64)


def encode_documents(cache: SpanCache, special: dict[str, int], raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk of documents one after another, and where each document's begin (n + 1)."""
    parts, kinds, first = with_specials(raw, offsets, special)
    starts, span_of_part = gpt_spans(raw, parts)
    ends = np.append(starts[1:], len(raw))
    if (kinds < 0).all():
        ids, lengths = cache.ids(raw, starts, ends)
        at = np.concatenate([[0], np.cumsum(lengths)])
        return ids, at[span_of_part[first]]
    whole = kinds >= 0  # a special string's spans give way to its one id
    spans = np.diff(span_of_part)
    drop = np.repeat(whole, spans)
    flat_start, lengths = cache.lookup(raw, starts, ends)
    lengths = np.where(drop, 0, lengths)
    lead = span_of_part[:-1][whole]
    lengths[lead] = 1
    ids = cache.flat[ragged(flat_start, lengths)]
    at = np.concatenate([[0], np.cumsum(lengths)])
    ids[at[lead]] = kinds[whole]
    return ids, at[span_of_part[first]]


def tokenizer(path: str) -> tuple[SegmentTreeBpe, SpanCache]:
    """This worker's tables and cache."""

    def make() -> tuple[SegmentTreeBpe, SpanCache]:
        model = SegmentTreeBpe(path)
        return model, SpanCache(model.encode_pieces, entries=400_000)

    return worker_state(("segment tree", path), make)


def encode_column(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an array column of ids (long texts give long arrays). A column already named ``out`` is replaced."""
    kept = docs.drop(out).withColumn(text, F.col(text))
    schema = kept.withColumn(out, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = tokenizer(path)
        for b in chunks(batches, text):
            raw, offsets = text_buffer(b.column(b.schema.get_field_index(text)))
            ids, at = encode_documents(cache, model.special, raw, offsets)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out])

    return kept.transform(arrow, run, schema)


def decode_column(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of an array column of ids; null ids give the empty text."""
    kept = rows.drop(out)
    schema = kept.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = tokenizer(path)
        for b in batches:
            texts = [b"".join(model.piece[i] for i in x or ()).decode("utf-8", "replace") for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return kept.transform(arrow, run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256 (the ids decoded, UTF-8),
    round_trip (the decoded text is the text) of every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = tokenizer(path)
        for b in chunks(batches):
            raw, offsets = text_buffer(b.column(1))
            ids, at = encode_documents(cache, model.special, raw, offsets)
            decoded, lengths = model.decode_bytes(ids)
            cut = np.concatenate([[0], np.cumsum(lengths)])[at]
            id_bytes, text_bytes, own = ids.astype("<u4").tobytes(), decoded.tobytes(), raw.tobytes()
            rows = []
            for k in range(b.num_rows):
                text = text_bytes[cut[k] : cut[k + 1]]
                back = text.decode("utf-8", "replace").encode()
                rows.append((hashlib.sha256(id_bytes[4 * at[k] : 4 * at[k + 1]]).hexdigest(), hashlib.sha256(back).hexdigest(), back == own[offsets[k] : offsets[k + 1]]))
            shas, decoded_shas, same = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), pa.array(shas), pa.array(decoded_shas), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).transform(arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
