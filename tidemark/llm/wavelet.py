"""Token ids as one wavelet matrix per shard.

A wavelet matrix keeps a sequence of ids as bit-planes, highest bit first; after each plane the ids are dealt stably by
that bit, zeros before ones. With a directory of ones before every 512 bits it answers access, rank (counting) and select
(occurrence lookup) without unpacking. File layout, little-endian: magic ``WVM1``; levels (1 byte), 3 zero bytes; n
(8 bytes); zeros of each level (8 bytes each); then for each level the plane (64-bit words) and its directory (32-bit
counts). Shards are rows of a zstd-compressed Parquet file in the shared folder, so Spark's commit protocol covers lost
executors and any store that Spark writes will do.

Cases: a null or empty text holds the end id alone; documents are in ascending doc_id order, null ids first and equal ids
ordered by a hash of the text; a text is never split between shards; an empty table gives no shard and no row; other
columns pass by unread.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_symbols, encode_documents
from tidemark.llm.common import arrow, chunks, text_buffer, whole_text, worker_state, written
from tidemark.llm.spans import SpanCache

MAGIC = b"WVM1"
#: A shard is closed once it holds this many ids.
SHARD_IDS = 1 << 20
BLOCK = 512


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], directories: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.directories = n, zeros, planes, directories

    @classmethod
    def build(cls, ids: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        n = len(ids)
        levels = levels or max(1, int(ids.max()).bit_length() if n else 1)
        if n and int(ids.max()) >> levels:
            raise ValueError(f"id {int(ids.max())} has more than {levels} bits")
        current = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes, directories = [], [], []
        words = -(-n // BLOCK) * (BLOCK // 64)
        for level in range(levels - 1, -1, -1):
            bit = (current >> level) & 1 != 0
            packed = np.zeros(words * 8, np.uint8)
            part = np.packbits(bit, bitorder="little")
            packed[: len(part)] = part
            plane = packed.view("<u8")
            counts = np.bitwise_count(plane).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            directories.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4"))
            planes.append(plane)
            low = current[~bit]
            zeros.append(len(low))
            current = np.concatenate([low, current[bit]])
        return cls(n, zeros, planes, directories)

    def to_bytes(self) -> bytes:
        head = [MAGIC, struct.pack("<B3xQ", len(self.planes), self.n), np.array(self.zeros, "<u8").tobytes()]
        return b"".join([*head, *(x.tobytes() for pair in zip(self.planes, self.directories, strict=True) for x in pair)])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        levels, n = struct.unpack_from("<B3xQ", data, 4)
        at = 16
        zeros = np.frombuffer(data, "<u8", levels, at).tolist()
        at += 8 * levels
        blocks = -(-n // BLOCK)
        planes, directories = [], []
        for _ in range(levels):
            planes.append(np.frombuffer(data, "<u8", blocks * (BLOCK // 64), at))
            at += blocks * BLOCK // 8
            directories.append(np.frombuffer(data, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
        return cls(n, zeros, planes, directories)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, word = i // BLOCK, i // 64
        plane, first = self.planes[level], i // BLOCK * (BLOCK // 64)
        found = int(self.directories[level][block]) + int(np.bitwise_count(plane[first:word]).sum())
        return found + (int(plane[word] & np.uint64((1 << (i % 64)) - 1)).bit_count() if i % 64 else 0)

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i // 64] >> np.uint64(i % 64)) & 1
            ones = self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the ids equal to ``symbol`` among the first ``end`` lie after the last level."""
        if symbol < 0 or symbol >> len(self.planes):
            return 0, 0
        low, high = 0, end
        for level in range(len(self.planes)):
            one, two = self._ones(level, low), self._ones(level, high)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + one, self.zeros[level] + two
            else:
                low, high = low - one, high - two
        return low, high

    def rank(self, symbol: int, end: int) -> int:
        """How often ``symbol`` is among the first ``end`` ids."""
        low, high = self._range(symbol, min(max(end, 0), self.n))
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the bit number ``k`` (from 0) of that kind."""
        directory, plane = self.directories[level], self.planes[level]
        before = directory.astype(np.int64) if bit else np.arange(len(directory), dtype=np.int64) * BLOCK - directory
        block = int(np.searchsorted(before, k, "right")) - 1
        words = plane[block * (BLOCK // 64) : (block + 1) * (BLOCK // 64)]
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, symbol: int, k: int) -> int:
        """Place of the occurrence number ``k`` (from 0) of ``symbol``."""
        low, high = self._range(symbol, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids: from the last level up, ids go back to the places their bits say."""
        levels = len(self.planes)
        current = np.zeros(self.n, np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(current)
            above[~bit] = current[: self.zeros[level]]
            above[bit] = current[self.zeros[level] :] | current.dtype.type(1 << (levels - 1 - level))
            current = above
        return current


def library_cache(path: str) -> tuple[SpanCache, dict[str, int]]:
    """This worker's cache of the tokenizers library's ids of pre-tokens."""
    return worker_state(("library", path), lambda: _library(path))


def _library(path: str) -> tuple[SpanCache, dict[str, int]]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    # the library's own model, on what its byte-level step makes of a pre-token: whole Encoding objects cost thrice as much
    marks, model = {b: c for c, b in byte_symbols().items()}, library.model
    return SpanCache(lambda keys: [[t.id for t in model.tokenize(k.decode("latin-1").translate(marks))] for k in keys], entries=1_200_000), special


def levels_of(path: str, end_id: int) -> int:
    """Bits of the highest id of a tokenizer's file, 1 at least."""
    from tokenizers import Tokenizer

    return max(1, max([end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()]).bit_length())


def write_shards(docs: DataFrame, path: str, end_id: int, levels: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text, append ``end_id``, and write shards in doc_id order. Returns the written shards:
    part, seq, before (ids of the part before the shard), n_ids, doc_ids, lengths, matrix. Without ``levels`` the
    tokenizer's highest id tells them."""
    levels = levels or levels_of(path, end_id)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    names = ["part", "seq", "before", "n_ids", "doc_ids", "lengths", "matrix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, special = library_cache(path)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            values = np.concatenate(ids)
            row = [part, seq, before, len(values), pa.concat_arrays(doc_ids).to_pylist(), np.concatenate(lengths).tolist(), WaveletMatrix.build(values, levels).to_bytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=names)

        for b in chunks(batches):
            raw, offsets = text_buffer(b.column(1))
            own, at = encode_documents(cache, special, raw, offsets)
            own = np.insert(own, at[1:], end_id)
            doc_ids.append(b.column(0))
            lengths.append(np.diff(at) + 1)
            ids.append(own)
            held += len(own)
            if held >= shard_ids:
                yield shard()
                seq, before = seq + 1, before + held
                doc_ids, lengths, ids, held = [], [], [], 0
        if held:
            yield shard()

    return written(rows.transform(arrow, run, "part int, seq int, before long, n_ids long, doc_ids array<long>, lengths array<long>, matrix binary"), "wavelet")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards' planes."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(F.struct("seq", F.col("doc_ids")[0].alias("first"))).alias("lead"))
    ahead = Window.orderBy(F.col("lead.first").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_start"))
    # one row for each task that wrote: small, and a shuffle here would move the matrices
    rows = shards.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("before")).alias("start"), "doc_ids", "lengths", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                doc_ids, lengths = b.column(1)[k].values, b.column(2)[k].values.to_numpy()
                ids = WaveletMatrix.from_bytes(b.column(3)[k].as_buffer().to_pybytes()).decode()
                at = np.concatenate([[0], np.cumsum(lengths)])
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(at[:-1] + b.column(0)[k].as_py(), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.transform(arrow, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
