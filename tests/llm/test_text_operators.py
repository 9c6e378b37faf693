"""The operators on text against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, content_sort, importance, mixing, pii, simhash, spans, telephony, token_counts, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key long, fp string"


def rows() -> list[tuple]:
    rng = random.Random(3)
    words = ["the", "of", "and", "Stone", "ñandú", "über", "x1", "don't", "we'll", "--", "日本語", "a", "THE"]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts = [None, "", " ", "\t\n", "a", " a", "a  b ", "<|endoftext|>x<|endoftext|>", "x" * 5000, "é " * 3000, "\x00a\x1cb", "'s 's ''s", *plain, *plain[:7]]
    texts += [plain[0] + " ", plain[0].replace(" ", "\n"), "word " * 9000]
    made = [(k, t, "en", [None, "s1", "s2", "s0"][k % 4], 0, k, "clash") for k, t in enumerate(texts)]
    return [*made, made[20], (None, plain[3], None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def by_row(found, *columns):
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)


def test_spans_split_as_the_pattern_does():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(1)
    pool = [*"abstrevelldm'\"  \n\t\r\x0b12é中Ⅷ!.　  ", "'s", "'re", "'ll", " '", "don't", "  "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(3000)] + ["", "'", " ", "'l", "x'", "'ll"]
    raw, offsets = common.text_buffer(pa.array(texts))
    starts, first = spans.gpt_spans(raw, offsets)
    data, ends = raw.tobytes(), np.append(starts[1:], len(raw))
    for k, text in enumerate(texts):
        got = [data[a:b].decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
        assert got == pattern.findall(text), text


def test_span_cache_gives_way_and_keeps_results():
    asked = []

    def encode(keys):
        asked.extend(keys)
        return [[len(k), k[0]] for k in keys]

    cache = spans.SpanCache(encode, entries=50)
    rng = random.Random(2)
    for _ in range(30):
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 25))) for _ in range(40)]
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        ids, lengths = cache.ids(raw, ends - [len(w) for w in words], ends)
        assert ids.reshape(-1, 2).tolist() == [[len(w), w[0]] for w in words] and (lengths == 2).all()
    assert len(asked) > 50


def test_bpe_equals_the_library(docs, nothing, library):
    want = []
    for doc_id, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert by_row(bpe.round_trip(docs, BYTE_BPE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.round_trip(nothing, BYTE_BPE).count() == 0
    texts = bpe.decode_column(bpe.encode_column(docs, BYTE_BPE).drop("text"), BYTE_BPE)
    assert by_row(texts, "doc_id", "text") == sorted(((r[0], r[1] or "") for r in rows()), key=str)
    assert "fp" in texts.columns


def test_segment_tree_takes_the_leftmost_lowest_pair(tmp_path):
    import json

    marks = {b: c for c, b in bpe.byte_symbols().items()}
    vocab = {marks[b]: b for b in range(256)} | {"aa": 256, "ab": 257, "aab": 258, "aaaa": 259}
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": [["a", "a"], ["a", "b"], ["aa", "b"], ["aa", "aa"]]}}))
    model = bpe.SegmentTreeBpe(str(path))
    ranks = {("a", "a"): 0, ("a", "b"): 1, ("aa", "b"): 2, ("aa", "aa"): 3}
    rng = random.Random(4)
    pieces = ["".join(rng.choice("aab") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    for text, ids in zip(pieces, model.encode_pieces([p.encode() for p in pieces]), strict=True):
        symbols = list(text)
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]:
            i = min(pairs)[1]
            symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
        assert [vocab[s] for s in symbols] == ids.tolist()


def test_wavelet_shards(docs, nothing, library):
    found = {}
    for r in wavelet.read_documents(wavelet.write_shards(docs, BYTE_BPE, 2, shard_ids=700)).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    total = 0
    for doc_id in dict.fromkeys(r[0] for r in ordered):
        same = [library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in ordered if r[0] == doc_id]
        got = sorted(found[doc_id])
        assert sorted(g[1:] for g in got) == sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in same)
        for g in got:
            assert g[0] == total
            total += g[1]
    assert wavelet.read_documents(wavelet.write_shards(nothing, BYTE_BPE, 2)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 9, n), rng.integers(0, 50257, n))
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes())
    assert (matrix.decode() == ids).all()
    assert [matrix.access(i) for i in range(0, n, 17)] == ids[::17].tolist()
    for s in (0, 8, 50256, 65535, 70000):
        assert matrix.count(s) == (ids == s).sum()
        assert matrix.occurrences(s) == np.flatnonzero(ids == s).tolist()
        assert matrix.rank(s, n // 2) == (ids[: n // 2] == s).sum()
    with pytest.raises(IndexError):
        matrix.access(n)


def test_content_groups(docs, nothing):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict[str, list] = {}
    for doc_id, text, *_ in rows():
        groups.setdefault(norm(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = []
    for text, members in groups.items():
        members.sort()
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    got = by_row(content_sort.content_groups(docs), *columns)
    assert got == sorted(want, key=str)
    assert content_sort.content_groups(nothing).count() == 0
    kept = content_sort.drop_duplicates_by_content(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[3])
    assert content_sort.drop_duplicates_by_content(nothing).count() == 0


def fingerprint(text: str | None, size: int) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def connected(values: list[int], radius: int) -> dict[int, int]:
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_simhash_groups(docs, nothing):
    prints = [(r[0], fingerprint(r[1], 3)) for r in rows()]
    roots = connected(sorted({f for _, f in prints}), 3)
    least: dict[int, int] = {}
    for doc_id, f in prints:
        if doc_id is not None:
            least[roots[f]] = min(doc_id, least.get(roots[f], doc_id))
    want = sorted(((d, f, least[roots[f]]) for d, f in prints), key=str)
    found = simhash.near_groups(docs).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found), key=str) == want
    assert simhash.near_groups(nothing).count() == 0


def test_simhash_links_of_crowded_blocks(spark):
    rng = random.Random(0)
    base, values = rng.getrandbits(64), set()
    while len(values) < 500:
        x = base
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(40)
        values.add(x)
    values = sorted(values | {rng.getrandbits(64) for _ in range(100)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(x),) for x in values], "node long")
    root = {r.node: r.root for r in simhash.components(simhash.links(rows, 3, tile=64)).collect()}
    want, got = {}, {}
    for x, r in connected(values, 3).items():
        want.setdefault(r, set()).add(x)
    for x in values:
        got.setdefault(root.get(signed(x), signed(x)), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_block_masks_lose_no_pair():
    rng = random.Random(5)
    for n in (10, 1 << 27):
        masks = simhash.block_masks(n, 3)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 3):
                b ^= 1 << bit
            assert any((a & m) == (b & m) for m in (m % (1 << 64) for m in masks))


def test_near_duplicates_leave_one_of_each_group(spark, nothing):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = []
    for k in range(20):
        own = [rng.choice(words) for _ in range(300)]
        texts.append(" ".join(own))
        for _ in range(k % 3):
            near = list(own)
            near[rng.randrange(300)] = "changed"
            texts.append(" ".join(near))
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, row_key string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    firsts = {t.split()[2] + t.split()[150]: None for t in texts}
    assert 20 <= kept.count() <= 22 and len(firsts) >= 20
    assert simhash.drop_near_duplicates(nothing).count() == 0


def jaccard_roots(texts: list[str], size: int, least: float) -> dict[int, int]:
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return {i: find(i) for i in range(len(texts))}


def template_texts(n: int, share: float, seed: int) -> list[str]:
    """Texts that have a passage in common and words of their own."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    same = [rng.choice(words) for _ in range(int(300 * share))]
    return [" ".join([*same, *(rng.choice(words) for _ in range(300 - len(same)))]) for _ in range(n)]


def test_bit_counts_by_brute_force():
    rng = random.Random(14)
    for n in (0, 1, 254, 255, 256, 3000):
        raw = " ".join(str(rng.randrange(10**6)) for _ in range(n)).encode()
        counts, found = simhash.bit_counts(raw, 1, 3, block=1000)
        hashes = np.concatenate([np.zeros(0, "<u8"), *simhash.shingle_hashes(raw, 1)])
        assert found == n
        for s in range(3):
            assert counts[s].tolist() == [int((simhash.segments_of(hashes, s) >> np.uint64(k) & np.uint64(1)).sum()) for k in range(64)]


def test_block_keys_turn_the_bits_nearest_to_half():
    counts, n = np.array([[9, 5, 1, 0, 10, 6, 4, 10] + [0] * 56]), 10
    keys = simhash.block_keys(counts, n, 4, 2)
    assert keys.tolist() == [[0b0001, 0b0011, 0b0000, 0b0010], [0b1011, 0b1001, 0b1111, 0b1101]]


def test_near_copies_at_the_limit_are_found(spark):
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = []
    for _ in range(150):
        own = [rng.choice(words) for _ in range(400)]
        texts.append(" ".join(own))
        near = list(own)
        for at in rng.sample(range(8), 7):
            near[at * 48 + rng.randrange(40)] = "changed"
        texts.append(" ".join(near))  # 35 of 396 shingles differ: 0.84
    roots = jaccard_roots(texts, 5, 0.8)
    assert len(set(roots.values())) == 150
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {2 * k for k in range(150)} <= kept and len(kept) <= 165


def test_hot_keys_are_looked_up(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 7 ELSE id END AS k", "id")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = simhash.looked_up(rows, values, "k", 5000)
    assert found.count() == 5000 and found.filter("k = 7 AND least = 0").count() == 4000 and found.filter("k <> 7 AND least <> id").count() == 0


def test_pages_on_one_template_are_not_near_duplicates(spark):
    texts = template_texts(150, 0.83, 7)  # about 0.7 each with each
    assert len(set(jaccard_roots(texts, 5, 0.8).values())) == 150
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert kept.count() == 150


def test_similar_edges_by_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for t in template_texts(12, 0.6, 8):
        texts.append(t)
        for _ in range(rng.randrange(6)):
            near = rng.choice(texts).split()
            near[rng.randrange(len(near))] = "other"
            near[rng.randrange(len(near)) :] = near[: rng.randrange(40)]
            texts.append(" ".join(near))
    frame = spark.createDataFrame([(1, len(texts), k, t) for k, t in enumerate(texts)], "root long, n long, node long, text string")
    for tile in (5, 512):
        root = {r.node: r.root for r in simhash.components(simhash.similar_edges(frame, 5, 0.8, tile)).collect()}
        groups = lambda of: sorted(sorted(k for k in range(len(texts)) if of(k) == r) for r in {of(k) for k in range(len(texts))})
        assert groups(lambda k: root.get(k, k)) == groups(jaccard_roots(texts, 5, 0.8).get)


def test_token_counts(docs, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 50) for r in rows()), key=str)
    for frequent in (0, 5, 1000):
        found = token_counts.token_counts(docs, PIECES, limit=50, frequent=max(frequent, 1), kept=frequent or 1)
        assert by_row(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(nothing, PIECES).count() == 0


def test_token_counts_of_texts_with_marks(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(13)
    texts = ["a▁ b", "a▁ ", "▁", "▁a", " ▁a", "▁ ", "a▁", "é▁▁ x", *("".join(rng.choice("ab ▁é日") for _ in range(rng.randrange(1, 12))) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PIECES).collect()}
    assert [(t, got[k]) for k, t in enumerate(texts)] == [(t, len(model.encode(t))) for t in texts]


def test_wavelet_levels_hold_every_id():
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(np.array([1, 70_000]), 16)
    assert wavelet.levels_of(BYTE_BPE, 2) == 16 and wavelet.levels_of(BYTE_BPE, 70_000) == 17


def reshared(sizes: dict, cap: float = 3.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1.0 for k, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        want = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if want[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | want
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(docs, nothing):
    found = mixing.mix(docs, bins=8).collect()
    sizes: dict = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    goal = reshared(sizes)
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in rows())
    taken: dict = {}
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, target in goal.items():
        assert abs(taken[s] - target) <= 1
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs.repartition(5), bins=8).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in found}
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.mixed_documents(docs, bins=8)
    assert mixed.columns == docs.columns
    words: dict = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text))
    assert words == {s: n for s, n in taken.items() if n}
    assert mixing.mixed_documents(nothing).count() == 0


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(12)}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        for s, t in reshared(sizes).items():
            assert got[s] == pytest.approx(t)


def test_telephony(docs, nothing):
    stored = telephony.store(docs)
    found = telephony.features(stored).collect()
    want = []
    for doc_id, text, *_ in rows():
        body = (text or "").encode()
        payload = body + b" " * (-len(body) % 192 if body else 192)
        want.append((doc_id, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found), key=str) == sorted(want, key=str)
    same: dict = {}
    for r in found:
        assert same.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
    assert telephony.features(telephony.store(nothing)).count() == 0
    one = stored.filter("doc_id = 4").first()
    kind, rate, body = telephony.read_wav(one.media)
    expanded = telephony.A_LAW[np.frombuffer(b"a" + b" " * 191, np.uint8)]
    assert (kind, rate) == (1, 16000) and np.frombuffer(body, "<i2").tolist() == telephony.resample_twice(expanded).tolist()


def test_pcm_columns_of_telephony_files(spark):
    codes = np.arange(256, dtype=np.uint8)
    blocks = np.random.default_rng(6).integers(0, 256, (3, telephony.BLOCK), dtype=np.uint8)
    files = [telephony.wav(codes.tobytes(), 7, 8000, 8), telephony.wav(codes.tobytes(), 6, 8000, 8), telephony.wav(blocks.tobytes(), 17, 8000, 4), None]
    media = spark.createDataFrame([(k, f, "x") for k, f in enumerate(files)], "id int, media binary, doc_id string")
    found = {r.id: r.pcm for r in telephony.pcm_column(media).collect()}
    for k, samples in enumerate((telephony.MU_LAW, telephony.A_LAW, telephony.decode_adpcm(blocks).ravel())):
        pcm = np.frombuffer(found[k], "<i2")
        assert (pcm[::2] == samples).all() and len(pcm) == 2 * len(samples)
        x = samples.astype(int)
        assert (pcm[1:-1:2] == (x[:-1] + x[1:]) // 2).all() and pcm[-1] == x[-1]
    assert found[3] is None
    assert (telephony.A_CODE[telephony.A_LAW.view(np.uint16)] == codes).all() and len(set(telephony.A_LAW.tolist())) == 256
    with pytest.raises(ValueError):
        telephony.pcm_column(media, out="doc_id")


def test_law_tables():
    # fixed points of G.711: silence, the extremes and one step
    assert telephony.MU_LAW[0xFF] == 0 and telephony.MU_LAW[0x7F] == 0 and telephony.MU_LAW[0x00] == -32124 and telephony.MU_LAW[0x80] == 32124
    assert telephony.A_LAW[0xD5] == 8 and telephony.A_LAW[0x55] == -8 and telephony.A_LAW[0x2A] == -32256 and telephony.A_LAW[0xAA] == 32256


def test_adpcm_equals_sample_by_sample():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, 36), dtype=np.uint8)
    got = telephony.decode_adpcm(blocks)
    for block, samples in zip(blocks, got, strict=True):
        value, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = telephony.STEPS[index]
                delta = step >> 3
                for bit, shift in ((1, 2), (2, 1), (4, 0)):
                    delta += step >> shift if code & bit else 0
                value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
                index = max(0, min(88, index + telephony.INDEX_CHANGE[code & 7]))
                want.append(value)
        assert samples.tolist() == want


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found)


def spelled(found) -> str:
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)


def pii_texts() -> list[str | None]:
    rng = random.Random(9)
    parts = ["a.b@c.de", "a@b.c_d@e.fg", "x@y", "a@b.c..x@y.z", "1.2.3.4", "300.1.1.1", "0001.2.3.004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111"]
    parts += ["+1 (415) 555-2671", "+49 30 1234567.", "+1", "+12345678", "word", "ñandú", "@", "+", ".", "555", "\n", " ", "_", "-", "日本", "12 345 6789 0123"]
    random_texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(0, 14))) for _ in range(250)]
    return [None, "", "no data here", "1" * 30_000, "a" * 30_000, "+1" + " (" * 5_000, "a@b.c " * 2_000, *random_texts]


def test_pii_base_spans(spark, nothing):
    texts = pii_texts()
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, row_key int")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    for k, t in enumerate(texts):
        want = base_spans(t or "")
        assert found[k].base_sha256 == hashlib.sha256(spelled(want).encode()).hexdigest(), t
        assert [found[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(s[1] == i for s in want) for i in range(4)]
        assert set(spelled(want).split(",")) - {""} <= set(found[k].spans.split(","))
    assert found[2].spans == ""
    assert pii.find(nothing).count() == 0


def test_pii_base_cards_of_short_groups(spark):
    number = "4539148803436467"
    texts = [f"card {sign.join(number[i : i + size] for i in range(0, 16, size))} thanks" for size in (1, 2) for sign in (" ", "-")]
    texts += ["4 53 9-14 88 03 43 64 6 7", "45 39 14 88 03 4", "45 39 14 88 03 43 64 68"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert [len(base_spans(t)) for t in texts] == [1] * 5 + [0] * 2
    for k, t in enumerate(texts):
        assert found[k].n_card == len(base_spans(t)), t
        assert found[k].base_sha256 == hashlib.sha256(spelled(base_spans(t)).encode()).hexdigest(), t


@pytest.fixture
def splits(spark, tmp_path):
    """A table of 40 texts in small row groups, and what makes its next scan split its files differently."""
    texts = [f"{k} of 40 " + "word " * 300 + (f"a{k}@b.org" if k % 3 == 0 else "none") for k in range(40)]
    made = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(2)
    made.write.option("parquet.block.size", 2048).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).parquet(f"{tmp_path}/docs")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield spark.read.parquet(f"{tmp_path}/docs"), texts, lambda size: spark.conf.set(key, size)
    spark.conf.set(key, before)


def test_row_keys_do_not_depend_on_splits(spark, splits):
    docs, texts, split = splits
    keyed, seen = common.numbered(docs, "rows"), []
    for size in ("128m", "1k", "300b"):
        split(size)
        again = keyed.select("*")
        seen.append(({(r.row_key, r.c0) for r in again.collect()}, again.rdd.getNumPartitions()))
    assert len({n for _, n in seen}) == 3
    assert seen[0][0] == seen[1][0] == seen[2][0] and len({k for k, _ in seen[0][0]}) == 40
    twice = common.numbered(spark.read.parquet(*docs.inputFiles(), *docs.inputFiles()), "rows").collect()
    assert len({r.row_key for r in twice}) == len(twice)


def test_pii_spans_stay_with_their_texts_when_splits_change(splits, monkeypatch):
    docs, texts, split = splits

    def written(df, name):
        out = common.written(df, name)
        split("300b")
        return out

    monkeypatch.setattr(pii, "written", written)
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert got == {k: f"email:{t.index('a' + str(k) + '@')}:{len(t)}" if "@" in t else "" for k, t in enumerate(texts)}


def test_pii_adds_and_redacts(spark):
    texts = ["please call (415) 555-2671 now", "order 415-555-2671 shipped", "write to jane.doe (at) example.org today", "version 10:20:30:40:50:60:70:80 is out"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert found[0] == "phone:12:26" and found[1] == "" and found[2].startswith("email:9:") and found[3] == ""
    mixed = spark.createDataFrame([(1, "a ñ x@y.org b 1.2.3.4", "k"), (2, "clean", "k"), (3, None, "k")], "doc_id long, text string, spans string")
    out = {r.doc_id: r.text for r in pii.redact(mixed).collect()}
    assert out == {1: "a ñ [email] b [ip]", 2: "clean", 3: None}


def test_luhn(spark):
    rows = spark.createDataFrame([("4111111111111111", True), ("4111111111111112", False), ("0", True), ("", False)], "d string, y boolean")
    assert all(r.got == r.y for r in rows.withColumn("got", pii.luhn(F.col("d"))).collect())


def test_importance(spark, nothing):
    rng = random.Random(10)
    words = ["stone", "river", "morning", "under", "light", "the", "of", "paper"]
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 200))) + "." for _ in range(150)]
    bad = ["".join(rng.choice("#$%&!") for _ in range(rng.randrange(200, 900))) for _ in range(40)] + ["STONE!! " * rng.randrange(50, 90) for _ in range(20)]
    texts = [None, "", *good, *bad]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(k, int(k < 152)) for k in range(2, len(texts), 2)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = importance.fit(docs, labels)
    found = importance.scores(docs, model).collect()
    assert {r.doc_id for r in found if r.kept} == set(range(152))
    kept = importance.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 152
    assert importance.scores(nothing, importance.fit(nothing, labels)).count() == 0
    assert importance.scores(docs, importance.fit(docs, labels.limit(0))).filter("not kept").count() == 0


def plain_hash(word: bytes) -> int:
    """The hash of words.py by its definition."""
    size = 1 << 64
    h = sum((b + 1) * pow(0x100000001B3, k, size) for k, b in enumerate(word)) % size
    h = (h ^ h >> 31) * 0x9E3779B97F4A7C15 % size
    return h ^ h >> 29


def plain_grams(text: str | None) -> list[tuple[int, int]]:
    """(kind, bucket) of all n-grams."""
    hashes = [plain_hash(w) for w in (text or "").encode().split()]
    pairs = [0 if a == b else (a * 31 + b * 0x9E3779B97F4A7C15) % (1 << 64) for a, b in zip(hashes, hashes[1:])]
    raw = (text or "").encode()
    trigrams = [int.from_bytes(raw[k : k + 3], "big") * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(len(raw) - 2)]
    return [(kind, h >> 64 - importance.BITS) for kind, found in enumerate((hashes, pairs, trigrams)) for h in found]


def test_importance_by_brute_force(spark):
    """Weights, keys and what is kept, with repeated rows, nulls, a very long text and k given."""
    from collections import Counter

    rng = random.Random(16)
    words = ["stone", "river", "Ñandú", "under", "light", "the", "x", "日本"]
    texts = [None, "", "  ", "x" * 70_000, "the " * 30_000] + [" ".join(rng.choice(words[: 3 + k % 6]) for _ in range(rng.randrange(1, 60))) for k in range(120)]
    made = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, texts[9])]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 6 > 2)) for k in range(125)] + [(8, 0), (8, 1)], "doc_id long, quality int")
    sample = {r.doc_id: r for r in importance.labelled_sample(labels, 50_000).collect()}
    assert len(sample) == 125 and sample[8].quality == 0 and 10 < sum(r.held for r in sample.values()) < 60
    raw, target = Counter(), Counter()
    for d, t in made:
        grams = plain_grams(t)
        raw.update(grams)
        if d in sample and sample[d].quality == 1 and not sample[d].held:
            target.update(grams)
    sums = lambda c, kind: sum(n for (k, _), n in c.items() if k == kind)
    share = [sums(target, k) / sums(raw, k) for k in range(3)]
    for scale in (1.0, 1000.0):
        model = importance.fit(docs, labels, scale=scale)
        want, keys = [], {}
        for d, t in made:
            weight = 0.0
            for kind, prior in enumerate(importance.PRIORS):
                own = [g for g in plain_grams(t) if g[0] == kind]
                weight += sum(np.log((target[g] + importance.SMOOTH) / (raw[g] * share[kind] + importance.SMOOTH)) for g in own) / (len(own) + prior)
            u = ((xxhash.xxh64_intdigest(str(d).encode(), 7) >> 11) + 0.5) / 2**53
            keys[d] = scale * weight - float(np.log(-np.log(u)))
            want.append((str(d), len(plain_grams(t)), weight, keys[d]))
        found = importance.scores(docs, model).collect()
        for g, w in zip(sorted((str(r.doc_id), r.n_grams, r.log_weight, r.key) for r in found), sorted(want), strict=True):
            assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=2e-9) and g[3] == pytest.approx(w[3], abs=1e-5)
        assert all(r.kept == (r.key >= model.level) for r in found)
        held = [(keys[d], r.quality) for d, r in sample.items() if r.held]
        gains = lambda level: sum(q for k, q in held if k >= level) / sum(q for _, q in held) - sum(1 - q for k, q in held if k >= level) / sum(1 - q for _, q in held)  # noqa: B023, E731
        assert gains(model.level) == pytest.approx(max(gains(k) for k, _ in held))
        ordered = sorted((keys[d] for d, _ in made), reverse=True)
        for k in (1, 40, 126, 500):
            level = ordered[k - 1] if k < len(ordered) else -np.inf
            kept = {str(r.doc_id) for r in importance.scores(docs, model, k).collect() if r.kept}
            assert kept == {str(d) for d, _ in made if keys[d] >= level - 1e-6}
        assert importance.keep_good(docs, model, 40).count() in (40, 41)


def test_kth_largest_of_many_ties(spark):
    values = [float(x) for x in [*range(300), *[7.5] * 200, 1e9, -1e9]]
    frame = spark.createDataFrame([(v,) for v in values], "key double").repartition(3)
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 290, 300, 500, 502):
        want = ordered[k - 1] if k < len(values) else -np.inf
        assert importance.kth_largest(frame, k, bins=8, few=5) == want
    assert importance.kth_largest(frame, 0) == np.inf

def test_components_of_few_edges_take_one_task_and_equal_those_of_the_rounds(spark, monkeypatch):
    rng = random.Random(12)
    chain = [(k, k + 1) for k in range(0, 300)]
    edges = [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(450)] + chain + [(-5, 7_000_000_000), (7_000_000_000, -(1 << 63)), (4, 4), (8888, 8888)]
    frame = spark.createDataFrame(edges, "u long, v long")
    writes, really = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: writes.append(name) or really(df, name))
    once = simhash.components(frame).collect()
    assert writes == ["edges"] and not simhash.components(frame.limit(0)).collect()
    monkeypatch.setattr(simhash, "TOGETHER", -1)
    rounds = simhash.components(frame).collect()
    monkeypatch.setattr(simhash, "TOGETHER", len({n for e in edges for n in e if e[0] != e[1]}) - 20)
    mixed = simhash.components(frame).collect()
    assert sorted(once) == sorted(rounds) == sorted(mixed) and len({r.node for r in once}) == len(once)
    root = {r.node: r.root for r in once}
    assert all(root[u] == root[v] for u, v in edges if u != v) and root[300] == 0 and root[-5] == -(1 << 63) and 8888 not in root and all(r.root <= r.node and root[r.root] == r.root for r in once)
