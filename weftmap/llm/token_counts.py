"""Token counts by counting the pieces of each distinct pre-token once.

Documents are turned into pre-token frequencies, a slice of documents at a time: the slice's distinct pre-tokens are numbered, and its
frequencies are written, with those numbers, to the shared folder. All slices' distinct pre-tokens are dealt by hash, so that
each meets itself from all slices in one task, where the library's merges count its pieces once. The counts are joined back
to the slices, multiplied with the frequencies and summed per document. No document's ids are made.

A pre-token travels once a slice, however often it occurs, in compressed sorted lists, one for each slice and hash bucket; the number of buckets
is bounded, so lists keep their length as the corpus grows. No pre-token is a hot key beyond that. The slices are
stored once and numbered in what is stored, so lost tasks can't make numbers and counts disagree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import expanded, slices, squeezed, texts_of
from ._store import materialize
from ._tokens import encoder, forget_encoders

#: Buckets of pre-tokens at most, whatever the size of the corpus; a task reads a bucket list by list.
MOST_BUCKETS = 4096
#: Counts of pre-tokens a task remembers; past this it counts some anew.
REMEMBERED = 1_000_000
#: Bytes of text in a slice, and documents at most.
SLICE_BYTES, SLICE_DOCS = 8_000_000, 60_000

_SLICES = "slice long, doc_ids binary, nulls binary, sizes binary, spread binary, tokens binary, times binary, lists array<struct<bucket: int, words: binary>>"
_NAMES = ["slice", "doc_ids", "nulls", "sizes", "spread", "tokens", "times", "lists"]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text is empty, with 0 tokens. Repeated and null ids give a row each; other columns are ignored;
    an empty table gives no row. With a tokenizer file of unknown settings a whole text is one pre-token.
    """
    buckets = min(MOST_BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, "t", SLICE_BYTES, SLICE_DOCS):
                yield _slice_row(enc, piece, number, buckets)
                number += 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        known: dict[bytes, int] = {}
        for batch in batches:
            found = []
            for data in batch.column("words").to_pylist():
                words = _unpacked(data)
                if len(known) > REMEMBERED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = enc.pieces(w.decode())
                found.append(squeezed(np.array([known[w] for w in words], dtype="<u4")))
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("bucket"), pa.array(found, pa.binary())], names=["slice", "bucket", "counts"])

    stored = materialize(rows.mapInArrow(frequencies, _SLICES), "slices")
    lists = stored.select("slice", F.explode("lists").alias("x")).select("slice", "x.bucket", "x.words")
    counted = lists.repartition("bucket").mapInArrow(pieces, "slice long, bucket int, counts binary")
    # A slice's own row comes after the counts of its pre-tokens, which come in the order of the buckets.
    whole = [c for c in stored.columns if c not in ("slice", "lists")]
    known = counted.select("slice", "bucket", "counts", *(F.lit(None).cast("binary").alias(c) for c in whole))
    own = stored.select("slice", F.lit(MOST_BUCKETS).alias("bucket"), F.lit(None).cast("binary").alias("counts"), *whole)
    met = known.union(own).repartition("slice").sortWithinPartitions("slice", "bucket")
    return met.mapInArrow(_summed, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def _packed(words: list[bytes]) -> bytes:
    return squeezed(np.frombuffer(np.array([len(words), *map(len, words)], dtype="<u4").tobytes() + b"".join(words), dtype=np.uint8))


def _unpacked(data: bytes) -> list[bytes]:
    raw = expanded(data, np.uint8).tobytes()
    n = int.from_bytes(raw[:4], "little")
    edge = (4 * n + 4 + np.concatenate([[0], np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4), dtype=np.int64)])).tolist()
    return [raw[a:b] for a, b in zip(edge, edge[1:])]


def _slice_row(enc, piece: pa.RecordBatch, number: int, buckets: int) -> pa.RecordBatch:
    """One slice: its documents, their frequencies of numbered pre-tokens, and the pre-tokens by number, which follows bucket and bytes."""
    texts = texts_of(piece, "t")
    of_chunk: dict[str, int] = {}
    at, freq, docs = [], [], []
    for i, text in enumerate(texts):
        chunks = enc.split(text)
        mine = np.fromiter((of_chunk.setdefault(c, len(of_chunk)) for c in chunks), dtype=np.int64, count=len(chunks))
        u, n = np.unique(mine, return_counts=True)
        at.append(u)
        freq.append(n)
        docs.append(np.full(len(u), i))
    at, freq, docs = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (at, freq, docs))
    numbers: dict[str, int] = {}
    edge, flat = [0], []
    for chunk in of_chunk:
        flat += [numbers.setdefault(p, len(numbers)) for p in enc.pre_tokens(chunk) if p]
        edge.append(len(flat))
    edge, flat = np.array(edge), np.array(flat, dtype=np.int64)
    many = np.diff(edge)[at]
    pick = np.repeat(edge[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    words = [w.encode() for w in numbers]
    bucket = np.array([zlib.crc32(w) % buckets for w in words], dtype=np.int32)
    order = sorted(range(len(words)), key=lambda i: (bucket[i], words[i]))
    rank = np.zeros(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    words, bucket = [words[i] for i in order], bucket[order]
    cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(words)]
    lists = [{"bucket": int(bucket[a]), "words": _packed(words[a:b])} for a, b in zip(cut, cut[1:]) if a < b]
    key = np.repeat(docs, many) * max(1, len(words)) + rank[flat[pick]]
    order = np.argsort(key, kind="stable")
    key, times = key[order], np.repeat(freq, many)[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    key, times = key[new], (np.add.reduceat(times, new) if len(new) else times)
    doc, token = np.divmod(key, max(1, len(words)))
    gap = np.diff(token, prepend=0)
    gap[np.flatnonzero(np.diff(doc, prepend=-1))] = token[np.flatnonzero(np.diff(doc, prepend=-1))]  # gaps inside a document
    ids = piece.column(0)
    columns = [
        [number],
        [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()],
        [ids.is_null().to_numpy(zero_copy_only=False).tobytes()],
        [np.array([len(t.encode()) for t in texts], dtype="<i8").tobytes()],
        [np.bincount(doc, minlength=len(texts)).astype("<i8").tobytes()],
        [squeezed(gap.astype("<u4").view(np.uint8).reshape(-1, 4).T)],
        [squeezed(times.astype("<u4").view(np.uint8).reshape(-1, 4).T)],
        [lists],
    ]
    types = [pa.int64(), *[pa.binary()] * 6, pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)


def _plain(data: bytes) -> np.ndarray:
    """Numbers whose bytes were stored place by place."""
    return np.ascontiguousarray(expanded(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a slice's pre-tokens in order, then the slice: its documents with their sums."""
    forget_encoders()
    held: list[np.ndarray] = []
    for batch in batches:
        for counts, doc_ids, nulls, sizes, spread, tokens, times in zip(*(batch.column(c).to_pylist() for c in ("counts", *_NAMES[1:7]))):
            if counts is not None:
                held.append(expanded(counts, "<u4"))
                continue
            pieces, spread = np.concatenate([*held, np.zeros(0, dtype="<u4")]).astype(np.int64), np.frombuffer(spread, dtype="<i8")
            held = []
            edge = np.concatenate([[0], np.cumsum(spread)])
            run = np.cumsum(_plain(tokens))
            token = run - np.repeat(np.concatenate([[0], run])[edge[:-1]], spread)
            total = np.concatenate([[0], np.cumsum(pieces[token] * _plain(times))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(doc_ids, dtype="<i8"), mask=np.frombuffer(nulls, dtype=bool)), pa.array(np.frombuffer(sizes, dtype="<i8")), pa.array(np.diff(total[edge]))], names=["doc_id", "n_bytes", "n_tokens"]
            )
