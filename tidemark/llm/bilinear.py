"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

The model predicts a token in two steps, both log-bilinear in the last ``CONTEXT`` tokens, whose vectors a matrix for each
place maps to the predicted one. First its class: each of the
``HEAD`` most frequent words is a class, the end of text is one, and all other words fall into ``TAIL`` classes by a hash of
their last two bytes. Then the word within its class, among those with vectors of their own and one outcome for all the
others. Words have vectors, as targets and as contexts, from a count of ``LEAST`` on, at most ``VECTORS`` of them, so the
vocabulary grows with the corpus up to that bound. What is left without context: the words without vectors share their
outcome's probability by add-one counts ((count + 1) over their counts + types + 1, the 1 being any unknown word), and stand
for each other as contexts. All tokens together sum to one.

Training: all positions of every training document are targets, in minibatches of strips of text, so what is trained on grows
with the corpus. Classes are told from noise classes, and words of tail classes from noise words of all of these; within a
class, the words' scores are then normalised. Each partition trains from common parameters, and each vector becomes its mean over the partitions by how
often they changed it: a short round from the start, then a round over everything. The means are made in ``SLICES`` slices
of the parameters, so neither a task nor the driver gets more than the model's own size from all partitions at once.

Counts are exact and cover all training documents. The words most frequent are broadcast (``KNOWN`` at most); counts of
the others reach documents by a join on the word, never by a broadcast. Texts are read twice, to count words and to write
each document's units (words with vectors and outcomes); training and scoring read the units.

Cases: null and empty texts are one end token; a null doc_id counts as the empty text for the split; ties of frequency go
by the word's bytes; repeated rows count each and score alike; without training documents every token is unknown and the
model stays as it starts; an empty table gives no row; texts of any length are whole; other columns pass by unread.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, chunks, level_of, ragged, text_buffer, whole_text, worker_state, written
from tidemark.llm.spans import SpanCache
from tidemark.llm.words import LOWER, word_spans

HEAD, TAIL, CONTEXT, WIDTH = 31, 96, 4, 16
KNOWN, VECTORS, LEAST = 1 << 17, 1 << 14, 10
#: Strips of text side by side in a minibatch, tokens of each, noise classes and noise words of a minibatch.
STRIPS, STEP, NOISE, OTHERS, RATE = 16, 128, 32, 128, 0.05
#: Minibatches of each partition's first round.
WARM = 100
#: Slices of the parameters that are averaged apart.
SLICES = 16
#: Tokens scored at once.
PIECE = 1 << 16
END, CLASSES = HEAD, HEAD + 1 + TAIL


def is_training(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def tail_class(word: bytes) -> int:
    return HEAD + 1 + zlib.crc32(word[-2:]) % TAIL


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_buffer(column)
    return LOWER[raw], offsets


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), c over all training documents, the null word counting their ends. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts, ends = SpanCache(lambda keys: [()] * len(keys), entries=1 << 21), np.zeros(0, np.int64), 0

        def out() -> pa.RecordBatch:
            slots, words = cache.spelled()
            return pa.RecordBatch.from_arrays([words, pa.array(counts[slots])], names=["word", "c"])

        for b in chunks(batches):
            b = b.filter(pa.array([is_training(d) for d in b.column(0).to_pylist()], pa.bool_()))
            if not b.num_rows:
                continue
            raw, offsets = _lowered(b.column(1))
            starts, ends_at, _ = word_spans(raw, offsets)
            cache.lookup(raw, starts, ends_at)
            if len(starts):
                more = np.bincount(cache.slots, minlength=cache.n)
                more[: len(counts)] += counts
                counts = more
            ends += b.num_rows
            if cache.n > 400_000:
                yield out()
                cache._clear()
                counts = np.zeros(0, np.int64)
        if len(counts):
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"])

    return _rows(docs).transform(arrow, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every task needs of the counts; its size is bounded by KNOWN, VECTORS and TAIL. Units are the head words, the end,
    and of each tail class its words with vectors and then the outcome of its others; the unit after the last is padding."""

    tokens: int  # N
    types: int  # V
    ends: int
    known: dict  # word: (unit, count) of the most frequent words
    mass: np.ndarray  # counts + types (+ 1 for unknown words) of each unit
    kind: np.ndarray  # class of each unit
    first: np.ndarray  # first unit of each class (n + 1)

    @property
    def units(self) -> int:
        return len(self.mass)

    def other(self, kind: int) -> int:
        """The unit of the words without vectors of a tail class."""
        return int(self.first[kind + 1]) - 1

    def others(self) -> np.ndarray:
        """Whether each unit is that of words without vectors."""
        out = np.zeros(self.units, bool)
        out[self.first[END + 2 :] - 1] = True
        return out


def vocabulary(counts: DataFrame, vectors: int = VECTORS, least: int = LEAST) -> Vocabulary:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([tail_class(w) for w in words], pa.int32()), b.column(1)], names=["kind", "c"])

    words = counts.filter("word is not null")
    level = level_of(words, "c", KNOWN)
    top = sorted(((bytes(r.word), r.c) for r in words.filter(F.col("c") >= level).collect()), key=lambda x: (-x[1], x[0]))
    masses = {r.kind: r.c + r.v for r in words.transform(arrow, run, "kind int, c long").groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}
    total = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word").isNull(), F.col("c")))).first()
    ends = total[2] or 0
    members: list[list[tuple[bytes, int]]] = [[] for _ in range(CLASSES)]
    for k, (w, c) in enumerate(top):
        if k < HEAD:
            members[k].append((w, c))
        elif c >= least and k < HEAD + vectors:
            members[tail_class(w)].append((w, c))
    mass: list[float] = []
    kind: list[int] = []
    first, known = [0], {w: (-tail_class(w), c) for w, c in top}
    for c in range(CLASSES):
        for w, n in members[c]:
            known[w] = (len(mass), n)
            mass.append(n + 1.0)
            if c <= END:
                masses[tail_class(w)] -= n + 1
        if c == END:
            mass.append(ends + 1.0)
        elif c < HEAD and not members[c]:  # fewer words than head classes: a class that never occurs
            mass.append(0.0)
        elif c > END:
            mass.append(masses.get(c, 0) - sum(n + 1 for _, n in members[c]) + 1.0)
        first.append(len(mass))
        kind += [c] * (len(mass) - first[-2])
    known = {w: (u if u >= 0 else first[1 - u] - 1, c) for w, (u, c) in known.items()}
    return Vocabulary(total[0] or 0, total[1], ends, known, np.array(mass), np.array(kind, np.int32), np.array(first))


class Units:
    """Unit and count of words: known ones from the vocabulary, others by their last bytes."""

    def __init__(self, vocab: Vocabulary):
        known, other = vocab.known, [vocab.other(k) if k > END else 0 for k in range(CLASSES)]
        self.cache = SpanCache(lambda keys: [known[k] if k in known else (other[tail_class(k)], -1) for k in keys], entries=300_000)
        self.vocab = vocab
        self.end = int(vocab.first[END])
        rest = vocab.others()
        self.log_rest = np.where(rest, np.log10(np.where(rest, vocab.mass, 1.0)), 0.0)
        self.rest = rest

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Unit of every token and its count (-1: not among the known words; ends have theirs), each document's first
        token (n + 1), and the words' byte starts and ends with their token places."""
        starts, ends, first = word_spans(raw, offsets)
        at, _ = self.cache.lookup(raw, starts, ends)
        place = np.arange(len(starts)) + np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        bounds = first + np.arange(len(offsets))
        units, counts = np.full(bounds[-1], self.end, np.int32), np.full(bounds[-1], self.vocab.ends, np.int64)
        if len(starts):
            units[place], counts[place] = self.cache.flat[at], self.cache.flat[at + 1]
        return units, counts, bounds, starts, ends, place


def strip(units: np.ndarray, bounds: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents one after another with CONTEXT paddings before each, and where their tokens are in it."""
    place = np.arange(len(units)) + CONTEXT * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    out = np.full(len(units) + CONTEXT * (len(bounds) - 1), pad, np.int32)
    out[place] = units
    return out, place


def windows(vectors: np.ndarray) -> np.ndarray:
    """A view of contiguous vectors (CONTEXT + n, WIDTH): the CONTEXT before each of the last n, side by side."""
    return np.lib.stride_tricks.as_strided(vectors, (len(vectors) - CONTEXT, CONTEXT * WIDTH), vectors.strides, writeable=False)


class LogBilinear:
    """One matrix of parameters, by rows: vectors of the units as contexts (padding last), output vectors of the classes and of
    the units within their classes, each with its bias in the last place, and the matrices of the context's places, farthest
    first."""

    def __init__(self, vocab: Vocabulary, seed: int = 5):
        rng, n = np.random.default_rng(seed), vocab.units
        by_class = np.add.reduceat(vocab.mass, vocab.first[:-1])
        self.vocab = vocab
        self.rows = np.zeros((2 * n + 1 + CLASSES + CONTEXT * WIDTH, WIDTH), np.float32)
        self.at = np.cumsum([0, n + 1, CLASSES, n, CONTEXT * WIDTH])
        self.R, self.Q, self.W, self.C = (self.rows[x:y] for x, y in zip(self.at[:-1], self.at[1:], strict=True))
        self.R[...] = rng.normal(0, 0.3, (n + 1, WIDTH))
        self.C[...] = np.tile(0.5 * np.eye(WIDTH), (CONTEXT, 1))
        self.Q[:, :-1] = rng.normal(0, 0.05, (CLASSES, WIDTH - 1))
        self.Q[:, -1] = np.log(np.maximum(by_class / by_class.sum(), 1e-12))
        self.W[:, -1] = np.log(np.maximum(vocab.mass / max(vocab.mass[vocab.first[END + 1] :].sum(), 1e-12), 1e-12))

    def load(self, rows: np.ndarray) -> LogBilinear:
        self.rows[...] = rows
        return self

    def predicted(self, vectors: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Predicted vectors of the tokens after the first CONTEXT ones of ``vectors``, with 1 for the bias in the last place;
        by batches that fit the cache."""
        out = np.empty((len(vectors) - CONTEXT, WIDTH), np.float32)
        views = windows(vectors)
        for a in range(0, len(out), rows):
            np.matmul(np.ascontiguousarray(views[a : a + rows]), self.C, out=out[a : a + rows])
        out[:, -1] = 1
        return out

    @staticmethod
    def _normalised(hat: np.ndarray, vectors: np.ndarray, own: np.ndarray, rows: int = 512) -> np.ndarray:
        """Log of the softmax of hat's products with the rows of ``vectors``, at the row ``own``; by batches that fit the cache."""
        out, table, ones = np.empty(len(own)), np.ascontiguousarray(vectors.T), np.ones(len(vectors), np.float32)
        place = np.arange(rows)
        # products this small need no shift before the exponentials
        safe = np.einsum("nw,nw->n", hat, hat).max(initial=0) * np.einsum("nw,nw->n", vectors, vectors).max(initial=0) < 60.0**2
        for a in range(0, len(own), rows):
            logits = hat[a : a + rows] @ table
            if not safe:
                logits -= logits.max(1, keepdims=True)
            picked = logits[place[: len(logits)], own[a : a + rows]].astype(np.float64)
            np.exp(logits, out=logits)
            out[a : a + rows] = picked - np.log((logits @ ones).astype(np.float64))
        return out

    def log_probabilities(self, units: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log of each token's unit's normalised probability: its class's, by its unit's within the class."""
        laid, place = strip(units, bounds, self.vocab.units)
        out, first = np.empty(len(laid)), self.vocab.first
        for a in range(0, len(laid), PIECE):
            piece = laid[max(a - CONTEXT, 0) : a + PIECE]
            if a < CONTEXT:
                piece = np.concatenate([np.full(CONTEXT, self.vocab.units, np.int32), piece])
            target = piece[CONTEXT:]
            real = np.flatnonzero(target < self.vocab.units)
            hat, target = self.predicted(self.R.take(piece, 0)).take(real, 0), target[real]
            kind = self.vocab.kind[target]
            found = self._normalised(hat, self.Q, kind)
            order = np.argsort(kind.astype(np.uint16), kind="stable")
            cuts = np.searchsorted(kind[order], np.arange(END + 1, CLASSES + 1))
            for c, x, y in zip(range(END + 1, CLASSES), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if x < y and first[c + 1] - first[c] > 1:
                    at = order[x:y]
                    found[at] += self._normalised(hat.take(at, 0), self.W[first[c] : first[c + 1]], target[at] - first[c])
            out[a + real] = found
        return out[place]


def _put(matrix: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """matrix[rows] = values, a row at a time."""
    whole = f"V{4 * WIDTH}"
    matrix.view(whole)[rows, 0] = values.view(whole)[:, 0]


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps; noise is shared within a minibatch."""

    def __init__(self, model: LogBilinear, seed: int):
        self.model, self.rng, vocab = model, np.random.default_rng(seed), model.vocab
        classes, words = np.add.reduceat(vocab.mass, vocab.first[:-1]), vocab.mass.copy()
        words[: vocab.first[END + 1]] = 0
        self.running = [np.cumsum(m / max(m.sum(), 1e-12)) for m in (classes, words)]
        self.log_noise = [np.log(np.maximum(n * m / max(m.sum(), 1e-12), 1e-12)).astype(np.float32) for n, m in ((NOISE, classes), (OTHERS, words))]
        self.squares = np.full(model.rows.shape, 1e-6, np.float32)
        self.changed = np.zeros(len(model.rows), np.float32)
        self.seen = 0

    def _change(self, first: int, rows: np.ndarray, grads: np.ndarray) -> None:
        """An AdaGrad step of the parameters' rows from ``first`` on, which may repeat (16-bit numbers)."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        ends = np.flatnonzero(np.append(rows[1:] != rows[:-1], True))
        sums = np.cumsum(grads.take(order, 0), axis=0, dtype=np.float64).take(ends, 0)
        sums[1:] -= sums[:-1].copy()
        sums, rows = sums.astype(np.float32), rows[ends].astype(np.int64) + first
        squares = self.squares.take(rows, 0)
        squares += sums * sums
        _put(self.squares, rows, squares)
        sums /= np.sqrt(squares)
        sums *= np.float32(RATE)
        _put(self.model.rows, rows, self.model.rows.take(rows, 0) - sums)
        self.changed[rows] += np.diff(ends, prepend=-1)

    def _contrast(self, level: int, first: int, vectors: np.ndarray, hat: np.ndarray, target: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The step of one level's output vectors; the gradients of hat. share: what each row of hat counts."""
        running, log_noise, n = self.running[level], self.log_noise[level], (NOISE, OTHERS)[level]
        noise = np.minimum(np.searchsorted(running, self.rng.random(n), "right"), len(running) - 1)
        own, others = vectors.take(target, 0), vectors[noise]
        g_own = (1 / (1 + np.exp(log_noise.take(target) - np.einsum("nw,nw->n", hat, own))) - 1) * share
        g_others = hat @ -others.T
        g_others += log_noise[noise]
        np.exp(g_others, out=g_others)
        g_others += 1
        np.divide(share[:, None], g_others, out=g_others)
        own *= g_own[:, None]
        own += g_others @ others
        self._change(first, np.concatenate([target, noise]).astype(np.uint16), np.concatenate([hat * g_own[:, None], g_others.T @ hat]))
        return own

    def step(self, units: np.ndarray) -> None:
        """One minibatch: strips (s, CONTEXT + n) of units, whose last n columns are targets where they are no padding."""
        m, vocab = self.model, self.model.vocab
        real = units < vocab.units
        real[:, :CONTEXT] = False
        flat, real = units.ravel(), real.ravel()[CONTEXT:]
        n = int(real.sum())
        if not n:
            return
        share = real / np.float32(n)
        target = np.where(real, flat[CONTEXT:], 0)
        vectors = m.R.take(flat, 0)
        before = np.ascontiguousarray(windows(vectors))
        hat = before @ m.C
        hat[:, -1] = 1
        kind = vocab.kind.take(target)
        tail = np.flatnonzero(kind > END)
        g_words = self._contrast(1, m.at[2], m.W, hat.take(tail, 0), target[tail], share[tail]) if len(tail) else 0
        g_hat = self._contrast(0, m.at[1], m.Q, hat, kind, share)
        g_hat[tail] += g_words
        g_hat[:, -1] = 0
        g_vectors = np.zeros(vectors.shape, np.float32)
        for k, part in enumerate(np.matmul(g_hat, m.C.reshape(CONTEXT, WIDTH, WIDTH).transpose(0, 2, 1))):
            g_vectors[k : k + len(part)] += part
        g_places = before.T @ g_hat
        self._change(0, flat.astype(np.uint16), g_vectors)
        self.squares[m.at[3] :] += g_places * g_places
        m.C -= np.float32(RATE) * g_places / np.sqrt(self.squares[m.at[3] :])
        self.seen += n
        self.changed[m.at[3] :] = self.seen

    def steps(self, units: np.ndarray, bounds: np.ndarray, most: int | None = None) -> int:
        """Minibatches over all tokens of a chunk of documents, in STRIPS strips side by side; how many there were."""
        pad = self.model.vocab.units
        order = self.rng.permutation(len(bounds) - 1)
        sizes = np.diff(bounds)[order]
        laid, _ = strip(units[ragged(bounds[:-1][order], sizes)], np.concatenate([[0], np.cumsum(sizes)]), pad)
        long = -(-len(laid) // STRIPS)
        laid = np.concatenate([laid, np.full(long * STRIPS - len(laid), pad, np.int32)]).reshape(STRIPS, long)
        before = np.concatenate([np.full((1, CONTEXT), pad, np.int32), laid[:-1, -CONTEXT:]]) if long >= CONTEXT else np.full((STRIPS, CONTEXT), pad, np.int32)
        laid = np.concatenate([before, laid], 1)
        count = 0
        for a in range(0, long, STEP):
            if most is not None and count >= most:
                break
            self.step(laid[:, a : a + CONTEXT + STEP])
            count += 1
        return count


def _units_of(vocab) -> Units:
    return worker_state(("units", id(vocab)), lambda: Units(vocab))


def classified(docs: DataFrame, vocab) -> DataFrame:
    """What later passes read of each document: row_key, doc_id, held_out, units (16-bit), n_known and base (log10) over the
    known words, share (log10 of the shares of words without vectors, of the known ones, less their outcomes' masses), and
    its rare words with their numbers."""
    types = "row_key long, doc_id long, held_out boolean, units binary, n_known long, base double, share double, rare array<struct<word:binary,n:int>>"
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
    names = ["row_key", "doc_id", "held_out", "units", "n_known", "base", "share", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        units_of, key = _units_of(v), TaskContext.get().partitionId() << 36
        log_all = math.log10(v.tokens + v.types + 1)
        for b in chunks(batches):
            raw, offsets = _lowered(b.column(1))
            units, seen, bounds, starts, ends, place = units_of(raw, offsets)
            log_share = np.log10(np.maximum(seen, 0) + 1)
            share = np.where(units_of.rest[units], log_share - units_of.log_rest[units], 0.0)
            rare = np.flatnonzero(seen[place] < 0) if len(place) else np.zeros(0, np.int64)
            docs_of = np.searchsorted(bounds, place[rare], "right") - 1 if len(rare) else rare
            slots = units_of.cache.slots[rare] if len(rare) else rare
            _, shown, times = np.unique(docs_of << 32 | slots, return_index=True, return_counts=True)
            sizes = ends[rare[shown]] - starts[rare[shown]]
            spelled = pa.Array.from_buffers(
                pa.binary(), len(shown), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(raw[ragged(starts[rare[shown]], sizes)])]
            )
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(docs_of[shown], np.arange(b.num_rows + 1)), pa.int32()),
                pa.StructArray.from_arrays([spelled, pa.array(times, pa.int32())], names=["word", "n"]),
            )
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(units.astype("<u2"))])
            sums = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: B023, E731  every document has its end token
            columns = [key + np.arange(b.num_rows), b.column(0), [not is_training(d) for d in b.column(0).to_pylist()], packed, sums((seen > 0).astype(np.int64)), sums(log_share) - np.diff(bounds) * log_all, sums(share), lists.cast(rare_type)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
            key += b.num_rows

    return written(_rows(docs).transform(arrow, run, types), "units")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_buffer(column)
    return raw.view("<u2").astype(np.int32), offsets // 2


def trained_parts(rows: DataFrame, vocab, most: int | None, start) -> DataFrame:
    """slice, weights (how often each row of the slice's parameters was changed), sums (those rows times their weights) and
    seen (positions; in slice 0 alone) of each partition of rows with held_out and units, after ``most`` minibatches or all.
    vocab, start: broadcasts, of the vocabulary and of the parameters to start from (None: as a model starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LogBilinear(vocab.value)
        if start is not None:
            model.load(start.value)
        trainer, count = Trainer(model, TaskContext.get().partitionId()), 0
        for b in chunks(batches, "units"):
            if most is None or count < most:
                count += trainer.steps(*_unpacked(b.column(0)), None if most is None else most - count)
        if not trainer.seen:
            return
        sums = model.rows * trainer.changed[:, None]
        for k, part in enumerate(_slices(len(model.rows))):
            yield _blob(k, trainer.changed[part].astype(np.float64), sums[part].astype(np.float64), trainer.seen if not k else 0)

    return rows.filter("not held_out").select("units").transform(arrow, run, "slice int, weights binary, sums binary, seen long")


def _slices(n: int) -> list[slice]:
    cuts = [n * k // SLICES for k in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def train(rows: DataFrame, vocab, most: int | None, start) -> np.ndarray:
    """Parameters after a round over the partitions of rows: each row's mean, by how often partitions changed it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for b in batches:
            for k, weights, sums, seen in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine = totals.setdefault(k, [0.0, 0.0, 0])
                mine[0], mine[1], mine[2] = mine[0] + np.frombuffer(weights), mine[1] + np.frombuffer(sums), mine[2] + seen
        for k, mine in totals.items():
            yield _blob(k, *mine)

    out = LogBilinear(vocab.value).rows if start is None else start.value.copy()
    for r in trained_parts(rows, vocab, most, start).repartition(SLICES, "slice").transform(arrow, add, "slice int, weights binary, sums binary, seen long").collect():
        part = _slices(len(out))[r.slice]
        weights, sums = np.frombuffer(r.weights), np.frombuffer(r.sums).reshape(-1, WIDTH)
        out[part] = np.where(weights[:, None] > 0, sums / np.maximum(weights, 1)[:, None], out[part])
    return out


def _blob(k: int, weights: np.ndarray, sums: np.ndarray, seen: int) -> pa.RecordBatch:
    columns = [pa.array([k], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()), pa.array([seen], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "weights", "sums", "seen"])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    context = docs.sparkSession.sparkContext
    counts = written(word_counts(docs), "word-counts")
    vocab = context.broadcast(vocabulary(counts))
    rows = classified(docs, vocab)
    parameters = context.broadcast(train(rows, vocab, None, context.broadcast(train(rows, vocab, WARM, None))))
    names = ["row_key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LogBilinear(vocab.value).load(parameters.value)
        for b in chunks(batches, "units"):
            units, bounds = _unpacked(b.column(3))
            own = model.log_probabilities(units, bounds) / math.log(10)
            total = np.add.reduceat(own, bounds[:-1]) + b.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(bounds)), b.column(4), b.column(5), pa.array(total)], names=names)

    scored = rows.drop("rare").transform(arrow, run, "row_key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = rows.select("row_key", F.inline("rare")).join(counts.filter("word is not null"), "word")
    more = rare.groupBy("row_key").agg(F.sum("n").alias("also_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_share"))
    both = scored.join(more, "row_key", "left").fillna({"also_known": 0, "log_share": 0.0})
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("also_known")).alias("n_known"), F.lit(vocab.value.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("log_share")).alias("base_score"), (F.col("score") + F.col("log_share")).alias("score"),
    )
