"""The pipeline against a plain version of its stages, on planted junk, copies and near copies."""

from __future__ import annotations

import hashlib
import importlib.util
import math
import random
import re

import public_tokenizers
import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)
import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SOURCES = ["a", "b", "c", None]


def planted() -> tuple[list[tuple], list[tuple], set[int]]:
    """Documents, labels, and the ids that quality, copies and near copies should leave."""
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(800)]
    docs, labels, stay = [], [], set()

    def add(text: str, good: bool, keeps: bool) -> None:
        k = len(docs)
        docs.append((k, text, "en", SOURCES[k % 4] if k % 5 else "a", len(text)))
        if k % 3:
            labels.append((k, int(good), 0))
        if keeps:
            stay.add(k)

    for k in range(120):
        own = [rng.choice(words) for _ in range(rng.randrange(150, 300))]
        text = " ".join(own) + "."
        add(text, True, True)
        if k % 10 == 0:
            add(text.replace(" ", "\n"), True, False)  # a copy but for white space: the earlier row stays
        if k % 10 == 5:
            near = list(own)
            near[len(near) // 2] = "other"
            add(" ".join(near) + ".", True, False)
        if k % 4 == 0:
            add("#$% " * rng.randrange(100, 300), False, False)
    return docs, labels, stay


def mixed(rows: list[tuple]) -> list[tuple[int, str]]:
    """(doc_id, text) of the mix by the definition: targets by repeated resharing, keys -ln(u) / w."""
    size = {d: len(WORD.findall(t)) for d, t, *_ in rows}
    totals: dict = {}
    for d, _, _, s, _ in rows:
        totals[s] = totals.get(s, 0) + size[d]
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight, fixed, goal = {s: k % 3 + 1.0 for k, s in enumerate(order)}, {}, {}
    while len(goal) < len(order):
        rest = sum(totals.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        want = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > 3 * totals[s]]
        fixed |= {s: 3.0 * totals[s] for s in over}
        goal = {} if over else fixed | want
    out = []
    for s in order:
        epochs = math.floor(goal[s] / totals[s])
        left = round(goal[s] - epochs * totals[s])

        def key(row):
            u = (int(hashlib.md5(str(row[0]).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            plain = len(re.sub(r"[\x21-\x2B\x2D\x2F-\x40\x5B-\x60\x7B-\x7E]", "", row[1]))
            return -math.log(u) / (max(1, math.floor(4 * plain / max(len(row[1]), 1))) / 4)

        for row in sorted((r for r in rows if r[3] == s), key=key):
            out += [(row[0], row[1])] * epochs
            take = min(size[row[0]], max(left, 0))
            if take:
                ends = [m.end() for m in WORD.finditer(row[1])]
                out.append((row[0], row[1] if take == size[row[0]] else row[1][: ends[take - 1]]))
            left -= take
    return out


def test_pipeline_equals_the_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels, stay = planted()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, current, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        current = spark.read.parquet(f"{tmp_path}/{k}")
        assert current.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r.doc_id for r in current.select("doc_id").collect()})
    assert seen[0] == {d[0] for d in docs if not d[1].startswith("#")}
    assert len(seen[1]) == len(seen[0]) - 12 and seen[2] == stay
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, text in mixed([r for r in docs if r[0] in stay]):
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and extra columns whose names operators use."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(500)]
    own = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(8)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, own[0], "a"), (1, own[0], "a"), (2, own[0], "b"), (None, own[0], None), (3, None, "a"), (4, "", None), (5, " \n", "b"), (6, long, "a"), (None, own[1], "b"), (7, own[2], None), (8, long + " more", "b"), (None, None, None), (9, "x" * 50_000, "a")]
    names = "doc_id long, text string, lang string, source string, n_chars long, row_key long, node string, key double, c0 string, size long, __file string"
    made = [(d, t, None, s, None, 5, "n", 1.5, "c", None, "f") for d, t, s in rows]
    spark.createDataFrame(made, names).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == [n.split()[0] for n in names.split(", ")]
        assert docs.filter("row_key <> 5 OR node <> 'n' OR key <> 1.5 OR c0 <> 'c' OR size IS NOT NULL").count() == 0
        counts.append(sorted((str(r.doc_id), len(r.text or "")) for r in docs.collect()))
    assert len(counts[0]) == len(rows)
    assert counts[1] == sorted([("1", len(own[0])), ("None", len(own[1])), ("7", len(own[2])), ("5", 2), ("6", len(long)), ("8", len(long) + 5), ("9", 50_000)])
    assert counts[2] == [c for c in counts[1] if c[0] != "8"]
    assert {c[0] for c in counts[3]} <= {"1", "None", "7", "6", "9"}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(counts[3])
