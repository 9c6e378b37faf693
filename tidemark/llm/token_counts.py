"""Token counts by a map-side two-tier lookup.

A first pass keeps, in each task, a bounded summary of the most frequent pre-tokens; the summaries' sums give a compact
table of pre-token lengths that is broadcast (at most ``frequent`` entries, whatever the corpus). The second pass looks
every pre-token up in that table and in the worker's own cache, and asks the sentencepiece library for the rest. Only the
summaries are shuffled, never the pre-tokens.

A pre-token begins at a blank after a non-blank (or at the document's start). No piece of the model holds a blank mark
after another character, so no merge crosses these places; :func:`check_model` makes sure of it.

Cases: null and empty texts have no token; texts of any length are whole; repeated rows and equal ids count each for
itself; an empty table gives no row; other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, chunks, level_of, text_buffer, whole_text, worker_state, written
from tidemark.llm.spans import SpanCache, space_spans

MARK = "▁"
_models: dict = {}


def processor(path: str):
    """The library's model, small enough to stay."""
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def check_model(path: str) -> None:
    """Raise if pre-tokens could merge across their borders."""
    model = processor(path)
    inner = [p for i in range(model.get_piece_size()) if MARK in (p := model.id_to_piece(i)).lstrip(MARK)]
    if inner or model.encode("a b", out_type=str)[0] != model.encode("a", out_type=str)[0]:
        raise ValueError(f"{path}: pieces cross blanks")


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, span starts and ends, and each document's first span. A document that begins with a blank gets one more,
    as the library puts one before every text."""
    raw, offsets = text_buffer(column)
    filled = offsets[:-1] < offsets[1:]
    if len(raw) and np.isin(raw[offsets[:-1][filled]], (0x20, 0xE2)).any():
        texts = [f" {t}" if t.startswith((" ", MARK)) else t for t in column.fill_null("").to_pylist()]
        raw, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, first = space_spans(raw, offsets)
    return raw, starts, np.append(starts[1:], len(raw)), first


def _plain(key: bytes) -> str:
    """The text whose encoding is the pre-token's: the library puts the leading blank itself."""
    text = key.decode("utf-8")
    return text[1:] if text.startswith((" ", MARK)) else text


def _lengths(model, keys: list[bytes]) -> list[int]:
    """Numbers of tokens of pre-tokens. A lone blank at a text's end has no text of its own to encode."""
    if not keys:
        return []
    blank = len(model.encode("a ")) - len(model.encode("a"))
    return [blank if k in (b" ", MARK.encode()) else n for k, n in zip(keys, map(len, model.encode([_plain(k) for k in keys], num_threads=1)), strict=True)]


def frequent_lengths(texts: DataFrame, path: str, frequent: int, kept: int) -> dict[bytes, int]:
    """Numbers of tokens of at most ``frequent`` pre-tokens. Each task offers its ``kept`` most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in chunks(batches):
            raw, starts, ends, _ = _spans(b.column(0))
            own = SpanCache(lambda keys: [()] * len(keys), entries=1 << 17)
            own.lookup(raw, starts, ends)
            for key, n in own.counted(raw, starts, ends, kept):
                counts[key] = counts.get(key, 0) + n
            if len(counts) > 16 * kept:
                counts = dict(sorted(counts.items(), key=lambda x: -x[1])[: 8 * kept])
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:kept]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    offered = written(texts.transform(arrow, run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    keys = [bytes(r.piece) for r in offered.filter(F.col("n") >= level_of(offered, "n", frequent)).collect()]
    return dict(zip(keys, _lengths(processor(path), keys), strict=True))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, frequent: int = 16_384, kept: int = 2_048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every document."""
    check_model(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    first_tier = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows.select("text"), path, frequent, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = first_tier.value, processor(path)

        def encode(keys: list[bytes]) -> list[tuple[int]]:
            rare = [k for k in keys if k not in known]
            found = dict(zip(rare, _lengths(model, rare), strict=True))
            return [(known[k] if k in known else found[k],) for k in keys]

        cache = worker_state(("lengths", path), lambda: SpanCache(encode))
        cache.encode = encode
        for b in chunks(batches):
            _, plain = text_buffer(b.column(1))
            raw, starts, ends, first = _spans(b.column(1))
            at, _ = cache.lookup(raw, starts, ends)
            sums = np.concatenate([[0], np.cumsum(cache.flat[at], dtype=np.int64)])
            n = sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(plain), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.transform(arrow, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
