"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of all documents and one of the labelled good ones, give each document a log
importance weight: for words, pairs of neighbouring words and byte trigrams, each hashed to ``BUCKETS``, the sum over its
n-grams of log p_target - log p_raw, over their number plus the kind's ``PRIORS`` (short documents tend to 0). A word after
itself is one pair, whatever the word. A document's key is ``scale`` times
its weight plus Gumbel noise from a hash of doc_id, and the documents of the k largest keys are taken: a sample without
replacement in proportion to the weights to the power ``scale``. At scale 1 that is a random sample; at ``SCALE`` the noise
decides only between documents of almost equal weight, as a filter wants it.

k is a parameter. Where it is not given, it is the number of keys at or over a level that parts good from bad best on the
labelled rows that the target model has not seen, halfway between the two keys it parts.

The raw model counts every n-gram of every document. Labels: at most ``sample`` labelled rows, in order of a hash of
doc_id, are used; three quarters of them for the target model and the rest for the level. This bound is the only one.

Cases: null and empty texts have weight 0 and so are near the level of ordinary text; ties of key stay or go together, so
they may make the taken more than k; repeated rows get one key and one decision; a doc_id with two labels is bad if one of
them is; without labels of both kinds nothing is rejected; an empty table gives no row; texts of any length are whole; extra
columns pass by unread in :func:`scores`, and are all kept in :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, chunks, text_buffer, whole_text, written
from tidemark.llm.words import word_hashes, word_spans

#: Buckets of each kind of n-gram, by the highest bits of their hashes.
BITS = 17
BUCKETS = 1 << BITS
#: Of words, pairs of words, byte trigrams.
PRIORS = (100, 100, 1000)
KINDS = len(PRIORS)
#: Added to every count.
SMOOTH = 4
SCALE = 1000.0
#: Of the labelled rows, one in so many is for the level and not for the target model.
HELD = 4


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    level: float
    scale: float = SCALE


def _ngrams(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: buckets of all n-grams in order, and where each document's begin (n + 1)."""
    starts, ends, first = word_spans(raw, offsets)
    hashes, top = word_hashes(raw, starts, ends), np.uint64(64 - BITS)
    inner = np.ones(max(len(hashes) - 1, 0), bool)  # pairs within a document
    borders = first[1:-1]
    inner[borders[(borders > 0) & (borders < len(hashes))] - 1] = False
    pairs = hashes[:-1] * np.uint64(31) + hashes[1:] * np.uint64(0x9E3779B97F4A7C15)
    pairs[hashes[:-1] == hashes[1:]] = 0
    at = np.concatenate([[0], np.cumsum(inner), [inner.sum()]])
    wide = raw.astype(np.uint64)
    mixed = ((wide[:-2] << np.uint64(16)) + (wide[1:-1] << np.uint64(8)) + wide[2:]) * np.uint64(0x9E3779B97F4A7C15)
    valid = np.ones(len(raw), bool)  # trigrams within a document
    for back in (1, 2):
        ends_at = offsets[1:] - back
        valid[ends_at[ends_at >= offsets[:-1]]] = False
    return [
        ((hashes >> top).astype(np.int64), first),
        ((pairs[inner] >> top).astype(np.int64) + BUCKETS, at[np.minimum(first, len(at) - 1)]),
        ((mixed >> top).astype(np.int64)[valid[: len(mixed)]] + 2 * BUCKETS, np.concatenate([[0], np.cumsum(valid)])[offsets]),
    ]


def _sums(weights: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weight and number of n-grams of each document."""
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
    for (grams, at), prior in zip(_ngrams(raw, offsets), PRIORS, strict=True):
        n = np.diff(at)
        ahead = np.concatenate([[0.0], np.cumsum(weights[grams])])
        total += (ahead[at[1:]] - ahead[at[:-1]]) / (n + prior)
        count += n
    return np.round(total, 9), count


def gumbel(doc_id: int | None) -> float:
    u = ((xxhash.xxh64_intdigest(str(doc_id).encode(), 7) >> 11) + 0.5) / (1 << 53)
    return float(-np.log(-np.log(u)))


def labelled_sample(labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, quality, held (whether for the level) of at most ``sample`` labelled rows: the first in order of a hash of
    doc_id. Rows that cannot be among them by that hash are left out before the rest meet in one place."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    share = min(1.0, (2.0 * sample + 1000) / max(rows.count(), 1))
    rows = rows.filter(F.col("place") < int(share * (1 << 40)))
    found = rows.orderBy("place", "doc_id", "quality").limit(sample).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return found.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD)) == 0)


def _count_model(rows: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of every bucket. rows: doc_id, text, target (whether of the target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, KINDS * BUCKETS), np.int64)
        for b in chunks(batches):
            raw, offsets = text_buffer(b.column(1))
            good = np.array(b.column(2).to_pylist(), bool)
            for grams, at in _ngrams(raw, offsets):
                counts[0] += np.bincount(grams, minlength=counts.shape[1])
                counts[1] += np.bincount(grams[np.repeat(good, np.diff(at))], minlength=counts.shape[1])
        held = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[0][held]), pa.array(counts[1][held])], names=["bucket", "raw", "target"])

    # at most KINDS * BUCKETS rows
    found = rows.transform(arrow, run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.zeros((2, KINDS * BUCKETS))
    buckets = found["bucket"].to_numpy()
    for row, name in enumerate(("raw", "target")):
        counts[row, buckets] = found[name].to_numpy()
    weights = np.zeros(KINDS * BUCKETS)
    for kind in range(KINDS):
        part = slice(kind * BUCKETS, (kind + 1) * BUCKETS)
        raw, target = counts[0, part], counts[1, part]
        # raw counts at the target's size, so that few occurrences count alike in both
        weights[part] = np.log(target + SMOOTH) - np.log(raw * (target.sum() / max(raw.sum(), 1)) + SMOOTH)
    return weights


def _parting(keys: np.ndarray, good: np.ndarray) -> float:
    """The level with the greatest share of good keys over it less that of bad ones, halfway between two keys."""
    if not len(keys) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(keys, kind="stable")
    keys, good = keys[order], good[order]
    below_bad = np.cumsum(~good) / (~good).sum()
    below_good = np.cumsum(good) / good.sum()
    gain = below_bad - below_good
    gain[:-1][keys[:-1] == keys[1:]] = -1
    k = int(np.argmax(gain))
    if gain[k] <= 0:
        return -np.inf
    return float(keys[k] + keys[k + 1]) / 2 if k + 1 < len(keys) else float(keys[k])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 50_000, scale: float = SCALE) -> Model:
    """Both models over all of ``docs`` and the level on at most ``sample`` labelled rows."""
    chosen = F.broadcast(labelled_sample(labels, sample))  # at most ``sample`` rows of 13 bytes
    target = F.coalesce((F.col("quality") == 1) & ~F.col("held"), F.lit(False))
    weights = _count_model(_rows(docs).join(chosen, "doc_id", "left").select("doc_id", "text", target.alias("target")))
    known = _score(_rows(docs).join(chosen.filter("held"), "doc_id").select("doc_id", "text", "quality"), Model(weights, -np.inf, scale), ["quality"])
    found = known.select("key", "quality").collect()
    return Model(weights, _parting(np.array([r.key for r in found]), np.array([r.quality == 1 for r in found], bool)), scale)


def kth_largest(keys: DataFrame, k: int, bins: int = 1024, few: int = 10_000) -> float:
    """The k-th largest ``key`` of all rows: histograms of ever smaller ranges find it, so at most ``few`` keys, or the
    histogram, are collected; -inf if there are no more than k rows."""
    total, low, high = keys.agg(F.count("key"), F.min("key"), F.max("key")).first()
    if k >= total or k <= 0:
        return -np.inf if k > 0 else np.inf
    left = k
    while low < high:
        at = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1))
        found = keys.filter(F.col("key").between(low, high)).groupBy(at.alias("at")).agg(F.count("key").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r["at"]):
            if r["n"] >= left:
                break
            left -= r["n"]
        low, high = r["low"], r["high"]
        if r["n"] <= few:
            return sorted((x.key for x in keys.filter(F.col("key").between(low, high)).select("key").collect()), reverse=True)[left - 1]
    return low


def _score(rows: DataFrame, model: Model, more: list[str]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_grams long, log_weight double, key double, kept boolean" + "".join(f", {c} int" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            sums, count = _sums(held.value.weights, *text_buffer(b.column(1)))
            keys = held.value.scale * sums + np.array([gumbel(d) for d in b.column(0).to_pylist()])
            columns = [b.column(0), pa.array(count), pa.array(sums), pa.array(keys), pa.array(keys >= held.value.level), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_grams", "log_weight", "key", "kept", *more])

    return rows.transform(arrow, run, schema)


def at_most(docs: DataFrame, model: Model, k: int | None) -> Model:
    """``model`` with the level at which k rows of ``docs`` are taken (None: its own)."""
    if k is None:
        return model
    keys = written(_score(_rows(docs), model, []).select("key"), "keys")
    return Model(model.weights, kth_largest(keys, k), model.scale)


def scores(docs: DataFrame, model: Model, k: int | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept of every row."""
    return _score(_rows(docs), at_most(docs, model, k), [])


def keep_good(docs: DataFrame, model: Model, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose key is among the k largest, with all their columns."""
    model = at_most(docs, model, k)
    names = docs.columns
    own = docs.toDF(*(f"c{k}" for k in range(len(names))))
    of = {n.lower(): k for k, n in enumerate(names)}
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, f"c{of['text']}"):
            sums, _ = _sums(held.value.weights, *text_buffer(b.column(of["text"])))
            keys = held.value.scale * sums + np.array([gumbel(None if d is None else int(d)) for d in b.column(of["doc_id"]).to_pylist()])
            yield b.filter(pa.array(keys >= held.value.level))

    return own.transform(arrow, run, own.schema).toDF(*names)
