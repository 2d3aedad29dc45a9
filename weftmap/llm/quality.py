"""Quality classification by importance resampling.

Two generative models over hashed word n-grams are compared: the target's, from a bounded sample of labelled good
documents, and the raw text's, from all documents. A document's weight is the log ratio of the two, summed over its n-grams;
buckets with too little evidence say nothing. A Gumbel top-k draw over the weights keeps k documents, that is, k are drawn one after another
without replacement with chances in proportion to the ratios. k is a share of the documents: a parameter, by default the share of good
ones among the labelled.

Insults in good prose hardly move the sum, so toxic documents have a model of their own: words in more of the
toxic labelled documents than of the others, from one half of the sample. A document's toxicity is the log ratio of its
most telling word; the threshold comes from the other half, and what lies beyond it is rejected before the draw.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batches import gathered, slices, texts_of
from ._rows import by_position, fresh_name
from ._store import materialize

#: Labelled rows used at most, those with the lowest hash of their id. All other statistics cover all documents.
LABEL_ROWS = 20_000
#: Hash buckets of words and of word pairs each.
BUCKETS = 1 << 18
#: Occurrences the raw model must predict in the target before a bucket counts.
EVIDENCE = 5.0
#: Toxic labelled documents a word must stand in before it counts.
TOXIC_DOCS = 5
#: Losing a clean document weighs as much as keeping this many toxic ones when the threshold is set.
GOOD_WEIGHT = 10.0

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, with the owner of each: (hash, text)."""
    of_chunk: dict[str, int] = {}
    mine, sizes = [], []
    for text in texts:
        chunks = text.lower().split()
        mine.append(np.fromiter((of_chunk.setdefault(c, len(of_chunk)) for c in chunks), dtype=np.int64, count=len(chunks)))
        sizes.append(len(chunks))
    hashes, edges = [], [0]
    for chunk in of_chunk:
        if chunk.isalnum():
            hashes.append(zlib.crc32(chunk.encode()))
        else:
            hashes += [zlib.crc32(t.encode()) for t in _TOKEN.findall(chunk)]
        edges.append(len(hashes))
    hashes, edges = np.array(hashes, dtype=np.uint64), np.array(edges, dtype=np.int64)
    at = np.concatenate(mine) if mine else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = np.diff(edges)[at]
    pick = np.repeat(edges[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return hashes[pick], np.repeat(owner, n)


def _features(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' n-grams, words first and pairs after them, with the owner of each: (bucket, text)."""
    a, b = h[:-1], h[1:]
    pair = ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)) % np.uint64(BUCKETS)
    pair[a == b] = 0  # a word said twice is one n-gram, whatever the word
    inside = owner[:-1] == owner[1:]
    bucket = np.concatenate([h % np.uint64(BUCKETS), pair[inside] + np.uint64(BUCKETS)]).astype(np.int64)
    return bucket, np.concatenate([owner, owner[:-1][inside]])


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two models by bucket, words' and pairs' buckets apart; 0 where the evidence is too thin."""
    out = np.zeros(2 * BUCKETS, dtype=np.float32)
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        expected = raw[part] * (target[part].sum() / max(1.0, raw[part].sum()))
        out[part] = np.where(expected >= EVIDENCE, np.log((target[part] + 1) / (expected + 1)), 0)
    return out


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the score interval that best parts good from bad; minus infinity without examples of both."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    edges = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[edges[0] - 1], (edges[:-1] + edges[1:]) / 2, [edges[-1] + 1]])
    gain = GOOD_WEIGHT * (1 - np.searchsorted(good, cuts) / len(good)) + np.searchsorted(bad, cuts) / len(bad)
    best = cuts[gain == gain.max()]
    return float((best[0] + best[-1]) / 2)


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column of finite doubles, by narrowing histograms; a bounded number of rows reaches the driver."""
    lo, hi, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0 or k <= 0:
        return np.inf
    if k >= n:
        return lo
    while True:
        inside = values.where(F.col(column).between(lo, hi))
        width = (hi - lo) / 1024
        if width <= 0 or lo + width == lo:
            return lo
        bin_of = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(1023))
        counts = {r["bin"]: r for r in inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b]["n"]:
                break
            k -= counts[b]["n"]
        lo, hi = counts[b]["lo"], counts[b]["hi"]
        if counts[b]["n"] == 1 or lo == hi or k == 1:
            return hi
        if k == counts[b]["n"]:
            return lo


def word_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log ratio of the shares of toxic and of clean documents that hold each word; 0 where few toxic ones do."""
    expected = clean * (n_toxic / max(1, n_clean))
    return np.where(toxic >= TOXIC_DOCS, np.log((toxic + 1) / (expected + 1)), 0).clip(0)


def _sample(labels: DataFrame, label_id: str, quality: str, toxic: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of at most ``rows`` labelled documents, and their classes: 1 bad, 2 good, 3 toxic. Conflicting labels make a document bad or toxic."""
    known = labels.where(F.col(label_id).isNotNull() & F.col(quality).isNotNull())
    insult = F.coalesce(F.col(toxic), F.lit(0)) != 0
    per_doc = known.groupBy(F.col(label_id).cast("long").alias("d")).agg(F.max(insult.cast("int")).alias("toxic"), F.min((F.col(quality) == 1).cast("int")).alias("good"))
    per_doc = per_doc.select("d", F.when(F.col("toxic") == 1, 3).when(F.col("good") == 1, 2).otherwise(1).alias("class"))
    found = gathered(per_doc.orderBy(F.xxhash64("d"), "d").limit(rows))
    order = np.argsort(found["d"])
    return found["d"][order], found["class"][order].astype(np.int8)


def _fits(ids: np.ndarray) -> np.ndarray:
    """Which ids the words of toxic documents are taken from; the others set the threshold."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63) == 0


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic", label_rows: int = LABEL_ROWS, keep_share: float | None = None, seed: int = 42, whole: bool = True) -> tuple[DataFrame, list[str], Column]:
    """``docs`` stored with further columns (id, n-grams, weight, key of the draw, toxicity, label), or those alone without ``whole``; their names, and the condition for being kept."""
    ids, classes = _sample(labels, label_id, quality, toxic, label_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    names = [fresh_name(docs.columns, x) for x in ("doc", "n", "weight", "draw", "toxicity", "label")]
    every = docs.withColumn(names[0], F.col(id_col).cast("long"))

    def labelled(column: pa.Array) -> np.ndarray:
        """0: not in the sample, 1: bad, 2: good, 3: toxic."""
        d = column.fill_null(-1).to_numpy(zero_copy_only=False)
        if not len(ids):
            return np.zeros(len(d), dtype=np.int8)
        at = np.minimum(np.searchsorted(ids, d), len(ids) - 1)
        own = (ids[at] == d) & column.is_valid().to_numpy(zero_copy_only=False)
        return np.where(own, classes[at], 0).astype(np.int8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * BUCKETS, dtype=np.int64), np.zeros(2 * BUCKETS, dtype=np.int64)
        held: list[np.ndarray] = []  # each word once a labelled document, toxic ones' as odd numbers
        for batch in batches:
            for piece in slices(batch, "t"):
                h, of = _words(texts_of(piece, "t"))
                bucket, owner = _features(h, of)
                label = labelled(piece.column(0))
                raw += np.bincount(bucket, minlength=2 * BUCKETS)
                target += np.bincount(bucket[label[owner] == 2], minlength=2 * BUCKETS)
                use = np.flatnonzero((label > 0) & _fits(piece.column(0).fill_null(0).to_numpy(zero_copy_only=False)))
                for i in use.tolist():
                    own = np.unique(h[np.searchsorted(of, i) : np.searchsorted(of, i, "right")]).astype(np.int64)
                    held.append(np.concatenate([[0], own + 1]) * 2 + (label[i] == 3))  # 0 counts the documents
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["at", "raw", "target"])
        if held:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            odd = word % 2 == 1
            yield pa.RecordBatch.from_arrays([pa.array(-1 - word // 2), pa.array(np.where(odd, 0, n)), pa.array(np.where(odd, n, 0))], names=["at", "raw", "target"])

    total = rows.mapInArrow(count, "at long, raw long, target long").groupBy("at").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    total = gathered(total.where((F.col("at") >= -1) | (F.col("target") >= TOXIC_DOCS)))  # a row a bucket, and those of words in toxic labelled documents
    raw, target = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    at, order = total["at"], np.argsort(-total["at"])
    raw[at[at >= 0]], target[at[at >= 0]] = total["raw"][at >= 0], total["target"][at >= 0]
    ratio = log_ratio(target, raw)
    words, docs_of = order[at[order] < -1], at == -1
    said = (-2 - at[words]).astype(np.uint64)
    telling = word_ratio(total["target"][words], total["raw"][words], int(total["target"][docs_of].sum()), int(total["raw"][docs_of].sum()))
    said, telling = said[telling > 0], telling[telling > 0]

    kept_fields = every.schema.fields if whole else every.schema.fields[-1:]
    columns = [*(f.name for f in kept_fields), *names[1:]]
    carried = len(kept_fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                texts, doc = texts_of(piece, text_col), piece.column(piece.num_columns - 1)
                h, of = _words(texts)
                toxicity = np.zeros(len(texts))
                if len(said):
                    at = np.minimum(np.searchsorted(said, h), len(said) - 1)
                    hit = said[at] == h
                    np.maximum.at(toxicity, of[hit], telling[at[hit]])
                bucket, owner = _features(h, of)
                n = np.bincount(owner, minlength=len(texts))
                weight = np.bincount(owner, weights=ratio[bucket], minlength=len(texts))
                noise = np.array([zlib.crc32(f"{seed}:{d}".encode(), zlib.crc32(t.encode())) for d, t in zip(doc.to_pylist(), texts)])
                draw = weight - np.log(-np.log((noise + 0.5) / 2**32))
                made = [pa.array(n.astype(np.int64)), pa.array(weight, mask=n == 0), pa.array(draw, mask=n == 0), pa.array(toxicity), pa.array(labelled(doc))]
                yield pa.RecordBatch.from_arrays([*piece.columns[-carried:], *made], names=columns)

    schema = T.StructType([*kept_fields, *(T.StructField(c, t) for c, t in zip(names[1:], (T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.ByteType())))])
    scored = materialize(every.mapInArrow(score, schema), "scores")
    doc, n, weight, draw, toxicity, label = names
    known = gathered(scored.where((F.col(label) > 0) & F.col(weight).isNotNull()).groupBy(doc).agg(F.max(toxicity).alias("toxicity"), F.max(label).alias("label")))  # label_rows at most
    apart, insulting = ~_fits(known[doc]), known["label"] == 3
    most = -threshold(-known["toxicity"][apart & ~insulting], -known["toxicity"][apart & insulting])
    if keep_share is None:
        good, bad = int((classes == 2).sum()), int((classes == 1).sum())
        keep_share = good / (good + bad) if good and bad else 1.0
    clean = scored.where((F.col(toxicity) <= F.lit(float(most))) & F.col(draw).isNotNull())
    last = kth_largest(clean, draw, round(keep_share * clean.count()))
    kept = (F.col(toxicity) <= F.lit(float(most))) & (F.col(draw) >= F.lit(float(last)))
    return scored, names, F.coalesce(kept, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, score (the log importance weight, summed over n-grams), kept.

    A text without words (or null) has score null and is not kept. Without good and bad labelled documents, or a ``keep_share``, all others are kept.
    Rows with equal keys in the draw stay or go together, so repeated rows do. Null ids are scored like others; other columns
    are ignored; an empty table gives no row. At most ``label_rows`` labelled documents are used. Toxic documents are not kept
    once the labels show which words make them so. Options: label_id, quality, toxic (columns of ``labels``), label_rows, keep_share, seed.
    """
    only = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored, (doc, n, weight, *_), kept = _scored(only, labels, "id", "text", whole=False, **options)
    return scored.select(F.col(doc).alias("doc_id"), F.col(n).alias("n_features"), F.col(weight).alias("score"), kept.alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rejected rows, all columns as they are. Each row is decided by itself, whatever its id: of rows that share one some may
    stay, and rows with a null id are rejected like others. An empty table stays empty. The documents are written once to the shared folder, with their scores."""

    def drawn(rows: DataFrame, own_id: str, text: str) -> DataFrame:
        scored, names, kept = _scored(rows, labels, own_id, text, **options)
        return scored.where(kept).drop(*names)

    return by_position(docs, drawn, id_col, text_col)
