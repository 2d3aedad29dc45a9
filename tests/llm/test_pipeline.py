"""The quality draw and the whole pipeline against plain Python."""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, rows  # noqa: E402

pytest.importorskip("public_tokenizers")

B = 1 << 18


def features(text):
    h = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
    pairs = [0 if a == b else (((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64) >> 20) % B for a, b in zip(h, h[1:])]
    return [x % B for x in h], pairs


def quality_by_hand(data, labels):
    """{position: score}, and the kept positions."""
    known = {}
    for d, q, t in labels:
        if d is not None and q is not None:
            known.setdefault(d, []).append((q, t or 0))
    good = {d for d, v in known.items() if all(q == 1 and t == 0 for q, t in v)}
    bad = {d for d, v in known.items() if min(q for q, _ in v) != 1}
    feats = [features(r[1]) for r in data]
    ratio = []
    for part in (0, 1):
        raw, target = Counter(), Counter()
        for r, f in zip(data, feats):
            raw.update(f[part])
            if r[0] in good:
                target.update(f[part])
        share = sum(target.values()) / max(1, sum(raw.values()))
        ratio.append({k: float(np.float32(math.log((target[k] + 1) / (n * share + 1)))) for k, n in raw.items() if n * share >= 5})
    score = {i: sum(r.get(k, 0) for f, r in zip(fs, ratio) for k in f) for i, fs in enumerate(feats) if fs[0]}
    share = len(good) / (len(good) + len(bad)) if good and bad else 1.0
    key = {i: s - math.log(-math.log((zlib.crc32(f"42:{data[i][0]}".encode(), zlib.crc32(data[i][1].encode())) + 0.5) / 2**32)) for i, s in score.items()}
    k = round(share * len(score))
    last = sorted(key.values(), reverse=True)[k - 1] if k else math.inf
    return score, {i for i, x in key.items() if x >= last}


def corpus():
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(9999)}"
    good = ["the of and a to in " + " ".join(f"{word()} the of" for _ in range(60)) for _ in range(90)]
    bad = [" ".join(f"{word()} %%%" for _ in range(60)) for _ in range(30)]
    mixed = [" ".join(f"{word()} the" if rng.random() < i / 30 else f"{word()} %%%" for _ in range(60)) for i in range(30)]
    near = [good[3], good[4].replace("the of", "the OF"), good[5] + " end"]
    leaks = [g[:200] + " passage of ten words that is in the benchmark too " + g[200:] for g in good[10:13]]
    private = [g + f" mail me{i}@mail.example.com or +1 (203) 555-828{i}" for i, g in enumerate(good[20:24])]
    texts = good + bad + mixed + near + leaks + private
    data = [*rows(), *((1000 + i, t, "en", "s", len(t), *[None] * 5) for i, t in enumerate(texts))]
    labels = [(1000 + i, int(i < 90), 0) for i in range(0, 120, 2)] + [(1001, 1, 1), (None, 1, 0), (1003, None, 0)]
    bench = [(1, "passage of ten words that is in the benchmark too"), (2, "no such thing")]
    return data, labels, bench


def test_quality_draw(spark):
    from weftmap.llm.quality import quality_scores

    data, labels, _ = corpus()
    numbered = [(i, *r[1:]) for i, r in enumerate(data)]  # distinct ids, to match rows
    moved = {r[0]: i for i, r in enumerate(data)}
    labels = [(moved.get(d), q, t) for d, q, t in labels]
    score, kept = quality_by_hand(numbered, labels)
    found = {r.doc_id: r for r in quality_scores(docs(spark, numbered), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {i for i, r in found.items() if r.kept} == kept and 0 < len(kept) < len(score)
    assert all((r.score is None) == (i not in score) and (r.score is None or abs(r.score - score[i]) < 1e-5 * max(1, abs(score[i]))) for i, r in found.items())


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer
    from weftmap.llm.personal_data import redact
    from weftmap.llm.simhash_dedup import _fingerprints_of

    import public_tokenizers

    data, labels, bench = corpus()
    docs(spark, data).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    _, kept = quality_by_hand(data, labels)
    left = [data[i][:2] for i in sorted(kept)]
    prints = [int(x) for x in _fingerprints_of([t or "" for _, t in left])]
    label = list(range(len(left)))
    for _ in range(4):
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    first = {k: min((d is None, d or 0, i) for i, ((d, _), m) in enumerate(zip(left, label)) if m == k)[2] for k in set(label)}
    left = [left[i] for i in sorted(first.values())]
    bad = [d for d, t in left if "passage of ten words that is in the benchmark too" in (t or "")]
    left = [(d, None if t is None else redact(t)) for d, t in left if "passage of ten words that is in the benchmark too" not in (t or "")]
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in left:
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((d, s, min(1024, len(ids) - s), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    assert bad and len(left) < len(data) and any("<EMAIL>" in (t or "") for _, t in left)

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_stages_decide_rows_and_keep_columns_of_any_name(spark):
    from pyspark.sql import types as T

    from weftmap.llm.decontamination import decontaminate
    from weftmap.llm.personal_data import redact_documents
    from weftmap.llm.quality import keep_quality
    from weftmap.llm.simhash_dedup import simhash_dedup

    clash = ["_gone", "_bad", "_rejected", "_row", "_fp", "_doc", "_n", "_weight", "_draw", "_LABEL", "a.b"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in clash)])
    leak = "passage of ten words that is in the benchmark too"
    a, b, c = ("one text of its own about rivers and their long ways to the sea", "quite another one on mountains which nobody has ever climbed before", "a third text that tells of ships and harbours in the far north")
    rows = [(3, a), (7, a), (7, b), (None, a), (5, None), (5, ""), (8, f"it has a {leak} and more"), (8, c), (None, f"so does this {leak}"), (9, c), (9, c)]
    frame = spark.createDataFrame([(*r, *[i] * len(clash)) for i, r in enumerate(rows)], schema)
    kept = simhash_dedup(frame)
    assert kept.schema == frame.schema and sorted(r._gone for r in kept.collect()) == [0, 2, 4, 6, 7, 8]
    kept = decontaminate(frame, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert kept.schema == frame.schema and sorted(r._gone for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10]
    assert redact_documents(frame).schema == frame.schema
    labels = spark.createDataFrame([(3, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    kept = keep_quality(frame, labels)
    assert kept.schema == frame.schema and 4 <= kept.count() <= 5
    assert sorted(r._gone for r in keep_quality(frame, labels, keep_share=1.0).collect()) == [0, 1, 2, 3, 6, 7, 8, 9, 10]


def test_rejected_rows_are_joined_by_shuffle_if_many(spark, monkeypatch):
    from weftmap.llm import _rows

    monkeypatch.setattr(_rows, "SENT_ROWS", 3)
    stored = spark.range(20).selectExpr("id n", "id x")
    assert sorted(r.x for r in _rows.without_rows(stored, "n", spark.range(0, 20, 2)).collect()) == list(range(1, 20, 2))
    table = spark.createDataFrame([(k, k * 10, 100 * k) for k in range(4)], "k long, v long, w long")
    met = _rows.join_hot(spark.range(40).selectExpr("id % 4 k", "id"), table, "k", "w", hot=150)
    assert sorted((r.id, r.v) for r in met.collect()) == [(i, i % 4 * 10) for i in range(40)]


def test_stages_on_nothing(spark, tmp_path):
    import corpus_pipeline

    empty = docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
