"""Telephony audio columns: mu-law, A-law and IMA ADPCM, and resampled PCM.

mu-law and A-law bytes expand to 16-bit samples by lookup tables built from their rules. IMA ADPCM blocks hold a 16-bit
first sample, a step index and 4-bit steps; numpy decodes all blocks of a batch together, one sample of each at a time.
PCM is resampled from 8 to 16 kHz by linear interpolation, the last sample repeated (a filter of four samples makes stored files a
quarter larger).

Stored form: a WAV file of 16 kHz 16-bit PCM, one channel: the payload's bytes, taken as A-law telephony at 8 kHz, are
expanded and resampled. Every second sample is one of the expanded ones, and the 256 codes of A-law have 256 values, so the
payload comes back from the file whole, whatever its bytes. Files are binary values of a zstd-compressed Parquet table in the
shared folder.

Cases: null and empty texts are 192 blanks; equal texts have equal values; repeated rows are repeated; texts of any length
are whole (a file of 2 GB, half a GB of text, is the most a value holds); ADPCM step indices over the table's end count as its
last; an empty table gives no row; other columns pass by unread in :func:`store`, and are all kept in :func:`pcm_column`,
which raises where there is one of the name it makes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import CHUNK_BYTES, arrow, chunks, text_buffer, whole_text, written

#: Bytes of an ADPCM block; payloads are padded to a multiple.
BLOCK = 192
# Fixed values of IMA ADPCM: change of the step index by the low three bits of a step, and the steps.
INDEX_CHANGE = [-1, -1, -1, -1, 2, 4, 6, 8]
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]


def _mu_law() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, low = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, low + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MU_LAW, A_LAW = _mu_law(), _a_law()
#: Code of each A-law value, by the value as an unsigned number.
A_CODE = np.zeros(1 << 16, np.uint8)
A_CODE[A_LAW.view(np.uint16)] = np.arange(256)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + 2 * (size - 4)) of IMA ADPCM blocks (n, size) of bytes."""
    n, size = blocks.shape
    change, steps = np.array(INDEX_CHANGE, np.int32), np.array(STEPS, np.int32)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    by_time = np.ascontiguousarray(blocks[:, 4:].T)
    for t in range(2 * (size - 4)):
        code = by_time[t >> 1] >> 4 if t & 1 else by_time[t >> 1] & 15
        step = steps[index]
        low = (code & 7).astype(np.int32)
        # step/8 + step/4, step/2 and step by the code's bits, each rounded down as decoders do
        delta = (step >> 3) + np.where(low & 1, step >> 2, 0) + np.where(low & 2, step >> 1, 0) + np.where(low & 4, step, 0)
        value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
        index = np.clip(index + change[low], 0, len(STEPS) - 1)
        out[t + 1] = value
    return out.T


def resample_twice(samples: np.ndarray) -> np.ndarray:
    """8 kHz 16-bit samples at 16 kHz."""
    x = np.append(samples, samples[-1:]).astype(np.int32)
    return np.stack([x[:-1], x[:-1] + x[1:] >> 1], 1).astype(np.int16).ravel()


def wav(data: bytes, kind: int, rate: int, bits: int) -> bytes:
    """A WAV file of one channel. kind: 1 (PCM), 6 (A-law), 7 (mu-law)."""
    n = len(data)
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHHH", 18, kind, 1, rate, rate * bits // 8, bits // 8, bits, 0) + b"fact" + struct.pack("<II", 4, 8 * n // bits) + b"data" + struct.pack("<I", n) + data + b"\0" * (n % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[int, int, memoryview]:
    """Format, rate and data of a WAV file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate = 12, 0, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", data, at + 8)
        elif name == b"data":
            return kind, rate, memoryview(data)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the WAV file")


def pcm_column(media: DataFrame, column: str = "media", out: str = "pcm") -> DataFrame:
    """``media`` with 16 kHz little-endian PCM of a column of WAV files: mu-law (format 7), A-law (6) or IMA ADPCM (17, in
    blocks of BLOCK bytes). A null file gives null; a column of the name ``out`` raises ValueError."""
    if out.lower() in {c.lower() for c in media.columns}:
        raise ValueError(f"there is a column {out}")
    kept = media
    schema = kept.withColumn(out, F.lit(None).cast("binary")).schema

    def pcm(data: bytes | None) -> bytes | None:
        if data is None:
            return None
        kind, _, body = read_wav(data)
        raw = np.frombuffer(body, np.uint8)
        if kind == 17:
            samples = decode_adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
        else:
            samples = {7: MU_LAW, 6: A_LAW}[kind][raw]
        return resample_twice(samples).astype("<i2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([pcm(one.column(b.schema.get_field_index(column))[0].as_py())], pa.binary())], names=[*b.schema.names, out])

    return kept.transform(arrow, run, schema)


def store(docs: DataFrame) -> DataFrame:
    """Write each text as a file of resampled PCM: doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            raw, offsets = text_buffer(b.column(1))
            data, media = raw.tobytes(), []
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                payload = np.frombuffer(data[x:y] + b" " * ((-(y - x)) % BLOCK if y > x else BLOCK), np.uint8)
                media.append(wav(resample_twice(A_LAW[payload]).astype("<i2").tobytes(), 1, 16000, 16))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return written(rows.transform(arrow, run, "doc_id long, n_bytes long, media binary"), "media", level=9)


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of stored files.
    feature: sums of squares of the payload as mu-law, as A-law and as ADPCM, sign changes of the mu-law samples, and the
    CRC-32 of its 16 kHz PCM, joined by ":". All come from the files: the payload from every second sample."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def measured(column: pa.Array) -> list[pa.Array]:
        files = column.to_pylist()
        bodies = [read_wav(f)[2] for f in files]
        payloads = [A_CODE[np.frombuffer(x, "<u2")[::2]].tobytes() for x in bodies]
        at = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
        raw = np.frombuffer(b"".join(payloads), np.uint8)
        mu = MU_LAW[raw]
        energy = lambda x, cut: np.add.reduceat(x.astype(np.int64) ** 2, cut)
        adpcm = decode_adpcm(raw.reshape(-1, BLOCK)).astype(np.int64)
        by_block = (adpcm * adpcm).sum(1)
        turns = np.concatenate([[False], (mu[1:] < 0) != (mu[:-1] < 0)])
        turns[at[:-1]] = False
        columns = [energy(mu, at[:-1]), energy(A_LAW[raw], at[:-1]), np.add.reduceat(by_block, at[:-1] // BLOCK), np.add.reduceat(turns.astype(np.int64), at[:-1])]
        pcm = [zlib.crc32(x) for x in bodies]
        said = [":".join(map(str, x)) for x in zip(*(c.tolist() for c in columns), pcm, strict=True)]
        return [
            pa.array([len(p) for p in payloads], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
            pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
            pa.array([len(f) for f in files], pa.int64()),
            pa.array([hashlib.sha256(f).hexdigest() for f in files]),
            pa.array(said),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "media", 4 * CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *measured(b.column(2))], names=names)

    return media.transform(arrow, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
