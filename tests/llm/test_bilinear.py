"""Language-model scores: counts and base by brute force, normalised probabilities, held-out gain."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import bilinear

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[tuple]:
    rng = random.Random(1)
    tongues = [[f"{c}{k}{c}" for k in range(60)] for c in "abc"]
    made = []
    for k in range(240):
        own = rng.choice(tongues)
        made.append((k, " ".join(own[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randrange(0, 120)))))
    return [*made, (240, None), (241, "Only ONCE"), (None, "a1a unseen"), (3, made[3][1])]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(*r, "x") for r in texts()], "doc_id long, text string, score string").repartition(3)
    return bilinear.score(docs).collect()


def tokens(text):
    return [w.lower() for w in WORD.findall(text or "")] + [None]


def test_base_scores_by_brute_force(found):
    train = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2
    counts = Counter(t for d, x in texts() if train(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, x in texts():
        own = tokens(x)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        want.append((str(d), not train(d), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got) == sorted(want)


def test_the_model_beats_the_base_on_held_out_texts(found):
    held = [r for r in found if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def small_vocabulary(seed: int = 0) -> bilinear.Vocabulary:
    rng = np.random.default_rng(seed)
    sizes = [1] * (bilinear.HEAD + 1) + rng.integers(1, 6, bilinear.TAIL).tolist()
    first = np.concatenate([[0], np.cumsum(sizes)])
    return bilinear.Vocabulary(100, 50, 9, {}, rng.integers(1, 50, first[-1]).astype(float), np.repeat(np.arange(bilinear.CLASSES), sizes).astype(np.int32), first)


def random_model(vocab: bilinear.Vocabulary) -> bilinear.LogBilinear:
    model = bilinear.LogBilinear(vocab)
    return model.load(np.random.default_rng(1).normal(0, 0.4, model.rows.shape))


def plain_probability(model: bilinear.LogBilinear, before: list[int], unit: int) -> float:
    """Log probability of a unit after the CONTEXT units before it (farthest first), by the definition in float64."""
    v, w = model.vocab, bilinear.WIDTH
    R, Q, W, C = (x.astype(np.float64) for x in (model.R, model.Q, model.W, model.C))
    hat = sum(R[u] @ C[k * w : (k + 1) * w] for k, u in enumerate(before))
    hat[-1] = 1
    kind = int(v.kind[unit])
    own = Q @ hat
    found = own[kind] - math.log(np.exp(own).sum())
    if kind > bilinear.END:
        words = W[v.first[kind] : v.first[kind + 1]] @ hat
        found += words[unit - v.first[kind]] - math.log(np.exp(words).sum())
    return found


def test_probabilities_sum_to_one():
    vocab = small_vocabulary()
    model = random_model(vocab)
    rng = np.random.default_rng(0)
    for n in (0, 3, bilinear.CONTEXT + 2):
        before = rng.integers(0, vocab.units, n)
        units = np.concatenate([np.append(before, u) for u in range(vocab.units)]).astype(np.int32)
        bounds = np.arange(vocab.units + 1) * (n + 1)
        assert np.exp(model.log_probabilities(units, bounds)[n :: n + 1]).sum() == pytest.approx(1, abs=1e-4)


def test_log_probabilities_by_the_definition(monkeypatch):
    monkeypatch.setattr(bilinear, "PIECE", 37)  # documents over several pieces
    vocab = small_vocabulary()
    model = random_model(vocab)
    rng = np.random.default_rng(3)
    sizes = [1, 5, 90, 2, 40]
    units, bounds = rng.integers(0, vocab.units, sum(sizes)).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
    got = model.log_probabilities(units, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        for t in range(a, b):
            before = [vocab.units] * max(0, bilinear.CONTEXT - (t - a)) + units[max(a, t - bilinear.CONTEXT) : t].tolist()
            assert got[t] == pytest.approx(plain_probability(model, before, units[t]), abs=2e-4)


def test_a_step_follows_the_gradient_of_the_contrastive_loss(monkeypatch):
    monkeypatch.setattr(bilinear, "RATE", 0.0)
    vocab = small_vocabulary()
    model = random_model(vocab)
    trainer = bilinear.Trainer(model, 7)
    trainer.squares[...] = 1e-20
    units = np.random.default_rng(4).integers(0, vocab.units + 1, (3, bilinear.CONTEXT + 8)).astype(np.int32)
    noise = np.random.default_rng(7)
    drawn = []
    for level, n in ((1, bilinear.OTHERS), (0, bilinear.NOISE)):
        drawn.append(np.minimum(np.searchsorted(trainer.running[level], noise.random(n), "right"), len(trainer.running[level]) - 1))
    trainer.step(units)
    rows = model.rows.astype(np.float64)

    def loss(rows: np.ndarray) -> float:
        R, Q, W, C = (rows[x:y] for x, y in zip(model.at[:-1], model.at[1:]))
        total, n = 0.0, 0
        for row in units:
            for t in range(bilinear.CONTEXT, len(row)):
                if row[t] == vocab.units:
                    continue
                n += 1
                hat = sum(R[u] @ C[k * bilinear.WIDTH : (k + 1) * bilinear.WIDTH] for k, u in enumerate(row[t - bilinear.CONTEXT : t]))
                hat[-1] = 1
                kind = vocab.kind[row[t]]
                for own, vectors, level, others in ((row[t], W, 1, drawn[0]), (kind, Q, 0, drawn[1])):
                    if level and kind <= bilinear.END:
                        continue
                    total += np.log1p(np.exp(trainer.log_noise[level][own] - vectors[own] @ hat))
                    total += np.log1p(np.exp(vectors[others] @ hat - trainer.log_noise[level][others])).sum()
        return total / n

    rng = np.random.default_rng(5)
    used = np.flatnonzero(trainer.changed)
    for k in [*rng.choice(used, 40), *range(len(rows) - 3, len(rows))]:
        c = rng.integers(0, bilinear.WIDTH)
        if k >= model.at[3] and c == bilinear.WIDTH - 1:
            continue  # the bias's place has no matrix
        up, down = rows.copy(), rows.copy()
        up[k, c] += 1e-5
        down[k, c] -= 1e-5
        assert trainer.squares[k, c] == pytest.approx(((loss(up) - loss(down)) / 2e-5) ** 2, rel=2e-2, abs=1e-9)


def test_tokens_of_a_unit_share_its_probability(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    counts = bilinear.word_counts(docs)
    vocab = bilinear.vocabulary(counts, least=30)
    rest, total, shares = vocab.others(), 0.0, Counter()
    assert rest.sum() == bilinear.TAIL and vocab.units == len(vocab.kind) == vocab.first[-1]
    own = Counter()
    for r in counts.collect():
        unit = vocab.first[bilinear.END] if r.word is None else vocab.known[bytes(r.word)][0]
        total += r.c + 1
        if rest[unit]:
            assert vocab.kind[unit] == bilinear.tail_class(bytes(r.word)) and r.c < 30
            shares[unit] += r.c + 1
        else:
            own[unit] += 1
            assert vocab.mass[unit] == r.c + 1
    assert set(own.values()) == {1} and len(own) > bilinear.HEAD + 10
    for unit in np.flatnonzero(rest):
        assert shares[unit] + 1 == vocab.mass[unit]
    assert vocab.mass.sum() == total + bilinear.TAIL


def test_scores_by_the_definition(spark, monkeypatch):
    """Whole scores from random parameters: each token's unit by the definition, times the word's share of it."""
    least = 25
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    vocab = bilinear.vocabulary(bilinear.word_counts(docs), least=least)
    model = random_model(vocab)
    whole = bilinear.vocabulary
    monkeypatch.setattr(bilinear, "KNOWN", 60)  # most words reach documents by the join
    monkeypatch.setattr(bilinear, "vocabulary", lambda counts: whole(counts, least=least))
    monkeypatch.setattr(bilinear, "train", lambda *_: small.rows)
    small = random_model(whole(bilinear.word_counts(docs), least=least))
    counts = Counter(t for d, x in texts() if bilinear.is_training(d) for t in tokens(x))
    v, rest, want = small.vocab, small.vocab.others(), []
    for d, x in texts():
        units, share = [], 0.0
        for t in tokens(x):
            word = None if t is None else t.encode()
            units.append(int(v.first[bilinear.END]) if t is None else v.known[word][0] if word in v.known else v.other(bilinear.tail_class(word)))
            if rest[units[-1]]:
                share += math.log10((counts[t] + 1) / v.mass[units[-1]])
        padded = [v.units] * bilinear.CONTEXT + units
        logs = [plain_probability(small, padded[k : k + bilinear.CONTEXT], u) for k, u in enumerate(units)]
        want.append((str(d), len(units), round(sum(logs) / math.log(10) + share, 2)))
    got = [(str(r.doc_id), r.n_tokens, r.score) for r in bilinear.score(docs).collect()]
    assert len(model.rows) != len(small.rows)
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=0.05)


def test_every_position_of_training_documents_is_a_target(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    vocab = spark.sparkContext.broadcast(bilinear.vocabulary(bilinear.word_counts(docs)))
    rows = bilinear.classified(docs, vocab)
    seen = sum(r.seen for r in bilinear.trained_parts(rows, vocab, None, None).collect())
    assert seen == vocab.value.tokens == sum(len(tokens(x)) for d, x in texts() if bilinear.is_training(d))


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bilinear.score(empty).count() == 0
    held = next(k for k in range(100) if not bilinear.is_training(k))
    one = bilinear.score(spark.createDataFrame([(held, "x y")], "doc_id long, text string")).first()
    assert one.n_tokens == 3 and one.n_known == 0 and one.train_tokens == 0 and math.isfinite(one.score) and one.base_score == pytest.approx(0)
