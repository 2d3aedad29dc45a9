"""Language-model scores by stupid backoff over token n-grams, computed relationally.

N-grams of orders 2 to ORDER are counted in tables partitioned by their hash, and every document's own n-grams are joined to those
counts and summed. The unit of both is a slice: some megabytes of consecutive documents as token ids, stored once. A slice's
distinct n-grams, with their counts, are dealt to hash buckets as sorted, compressed lists; there the counts of all slices
add up, and each slice gets back, list for list, how often its n-grams occur in other slices. So an
n-gram travels once a slice, whatever its frequency, and none is hot; as slices and buckets grow in number, lists grow shorter, down to the plain
relational form of one row per slice and n-gram. Token counts have one row per entry of the tokenizer's vocabulary, which
bounds what every task is sent.

A document is scored by the rest of the corpus: its own occurrences are taken out of all counts, or nothing in it would ever be unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import expanded, slices, squeezed, texts_of
from ._store import materialize
from ._tokens import encoder, forget_encoders

#: Longest n-grams.
ORDER = 3
#: Factor of each step back.
BACKOFF = 0.4
#: Bytes of text in a slice.
SLICE_BYTES = 3_000_000
#: Tokens of the corpus to a bucket, about.
BUCKET_TOKENS = 3_000_000


def _planes(a: np.ndarray) -> bytes:
    """Integers compressed byte place by byte place, high places first."""
    wide = np.ascontiguousarray(a.astype(">u8"))
    return squeezed(wide.view(np.uint8).reshape(-1, 8).T)


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(expanded(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


@dataclass
class Grams:
    """The n-grams of one order in a slice: where each ends, its number among the distinct ones (which follow their tokens), its count in its own
    document; the count of each distinct one in the slice, and the end of one occurrence."""

    at: np.ndarray
    which: np.ndarray
    own: np.ndarray
    total: np.ndarray
    some: np.ndarray


def _grams(ids: np.ndarray, lengths: np.ndarray, order: int, bits: int) -> list[Grams]:
    """All n-grams inside documents, for n = 1 to ``order``, each by one sort of (number of the n-gram before, token, place)."""
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(ids)) - np.repeat(ends - lengths, lengths)  # in the document
    wide, before, width, out = ids.astype(np.uint64), np.zeros(len(ids), dtype=np.uint64), 0, []
    for n in range(1, order + 1):
        at = np.flatnonzero(place >= n - 1)
        key = (before[at - 1] << np.uint64(bits)) | wide[at] if n > 1 else wide
        room = max(1, len(at).bit_length())
        if width + bits + room <= 64:
            packed = np.sort((key << np.uint64(room)) | np.arange(len(at), dtype=np.uint64))
            by, key = (packed & np.uint64((1 << room) - 1)).astype(np.int64), packed >> np.uint64(room)
        else:
            by = np.argsort(key, kind="stable")
            key = key[by]
        new = np.ones(len(at), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        of = owner[at[by]]
        turn = new.copy()
        turn[1:] |= of[1:] != of[:-1]  # places rise in equal n-grams, and documents with them
        runs = np.diff(np.append(np.flatnonzero(turn), len(at)))
        which, own = np.empty(len(at), dtype=np.int32), np.empty(len(at), dtype=np.int32)
        which[by], own[by] = np.cumsum(new, dtype=np.int32) - 1, np.repeat(runs, runs)
        out.append(Grams(at.astype(np.int32), which, own, np.diff(np.append(start, len(at))), at[by[start]]))
        before = np.zeros(len(ids), dtype=np.uint64)
        before[at] = which
        width = max(1, len(start)).bit_length()
    return out


def _keys(ids: np.ndarray, grams: list[Grams], order: int, bits: int) -> np.ndarray:
    """The distinct n-grams of orders from 2 on as integers, in order; shorter ones have the smaller integers."""
    wide, out = ids.astype(np.uint64), [np.zeros(0, dtype=np.uint64)]
    for n, g in enumerate(grams[1:], 2):
        key = np.zeros(len(g.some), dtype=np.uint64)
        for k in range(n):
            key = (key << np.uint64(bits)) | wide[g.some - n + 1 + k]
        out.append(key | np.uint64((n - 2) << order * bits))
    return np.concatenate(out)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    h = key * np.uint64(0x9E3779B97F4A7C15)
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers in order, and their counts."""
    key = np.sort(key)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[new], np.diff(np.append(new, len(key)))


def _dealt(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by bucket and value, and the buckets' edges."""
    bucket = _bucket(distinct, buckets)
    bucket = bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket  # sorted in linear time
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def lm_scores(docs: DataFrame, tokenizer: str, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, log_score (natural, summed over tokens), mean_log_score.

    c counts occurrences in all other rows. The score of a token after the context of up to ``order`` - 1 tokens in its document is
    c(context, token) / c(context) if c(context, token) > 0, else ``backoff`` times its score after a context shorter by one; with none
    it is max(1, c(token)) / N, where N is the number of tokens in the corpus. A null or empty text has 0 tokens,
    log_score 0 and a null mean. Repeated rows are rows of their own, which count for each other; null ids give a row each; other columns are
    ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    bits = max(1, (_vocabulary_size(tokenizer) - 1).bit_length())
    if order < 1 or order * bits + max(0, order - 2).bit_length() > 64:
        raise ValueError(f"n-grams of order {order} over {1 << bits} tokens do not fit into 64 bits")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, number = encoder(tokenizer), TaskContext.get().partitionId() << 32
        width = 2 if bits <= 16 else 4
        for batch in batches:
            for piece in slices(batch, "t", SLICE_BYTES):
                ids, lengths = [], []
                for part in slices(piece, "t"):
                    for x in enc.encode(texts_of(part, "t")):
                        ids.append(np.frombuffer(x, dtype="<u4").astype(f"<u{width}"))
                        lengths.append(len(ids[-1]))
                flat = np.concatenate(ids)
                token, n = _counted(flat)
                d = piece.column(0)
                columns = [
                    ([number], pa.int64()),
                    ([d.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                    ([d.is_null().to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                    ([np.array(lengths, dtype="<i8").tobytes()], pa.binary()),
                    ([squeezed(flat)], pa.binary()),
                    ([width], pa.int32()),
                    ([len(flat)], pa.int64()),
                    ([token.tolist()], pa.list_(pa.int64())),
                    ([n.tolist()], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["slice", "doc_ids", "nulls", "lengths", "ids", "width", "n_tokens", "tokens", "counts"])
                number += 1

    schema = "slice long, doc_ids binary, nulls binary, lengths binary, ids binary, width int, n_tokens long, tokens array<long>, counts array<long>"
    sliced = materialize(rows.mapInArrow(encode, schema), "slices")
    corpus = sliced.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-corpus // BUCKET_TOKENS))  # tasks grow in number with the corpus, not in size
    counted = sliced.select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy("x.tokens").agg(F.sum("x.counts").alias("n")).collect()  # a row a vocabulary entry
    unigram = np.zeros(max((r[0] for r in counted), default=0) + 1, dtype=np.int64)
    for token, n in counted:
        unigram[token] = n

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for number, lengths, ids, width in zip(*(batch.column(c).to_pylist() for c in ("slice", "lengths", "ids", "width"))):
                tokens = expanded(ids, f"<u{width}")
                found = _grams(tokens, np.frombuffer(lengths, dtype="<i8"), order, bits)
                distinct, count = _keys(tokens, found, order, bits), np.concatenate([np.zeros(0, dtype=np.int64), *(g.total for g in found[1:])])
                by, edge = _dealt(distinct, buckets)
                distinct, count = distinct[by], count[by]
                some = np.flatnonzero(np.diff(edge))
                cut = [slice(edge[b], edge[b + 1]) for b in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.full(len(some), number)), pa.array([_planes(np.diff(distinct[c], prepend=np.uint64(0))) for c in cut], pa.binary()), pa.array([_planes(count[c]) for c in cut], pa.binary())],
                    names=["bucket", "slice", "keys", "counts"],
                )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        now = None

        def others() -> pa.RecordBatch:
            keys, counts = np.concatenate([k for _, k, _ in held]), np.concatenate([c for _, _, c in held])
            by = np.argsort(keys, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], keys[by[1:]] != keys[by[:-1]]]))
            size = np.diff(np.append(new, len(by)))
            rest = np.empty(len(keys), dtype=np.int64)
            rest[by] = np.repeat(np.add.reduceat(counts[by], new), size)
            rest -= counts
            cut = np.cumsum([0, *(len(k) for _, k, _ in held)])
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in held], pa.int64()), pa.array([now] * len(held), pa.int64()), pa.array([_planes(rest[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())], names=["slice", "bucket", "rest"])

        for batch in batches:
            for bucket, number, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != now and held:
                    yield others()
                    held = []
                now = bucket
                held.append((number, np.cumsum(_from_planes(keys), dtype=np.uint64), _from_planes(counts).astype(np.int64)))
        if held:
            yield others()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        rest: list[np.ndarray] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("rest", "doc_ids", "nulls", "lengths", "ids", "width")}
                if row["rest"] is not None:
                    rest.append(_from_planes(row["rest"]).astype(np.int64))
                    continue
                lengths = np.frombuffer(row["lengths"], dtype="<i8")
                ids = expanded(row["ids"], f"<u{row['width']}").astype(np.int64)
                log_score = _scores(ids, lengths, np.concatenate([np.zeros(0, dtype=np.int64), *rest]))
                rest = []
                nulls = np.frombuffer(row["nulls"], dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=nulls), pa.array(lengths), pa.array(log_score)], names=["doc_id", "n_tokens", "log_score"])

    def _scores(ids: np.ndarray, lengths: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Scores of a slice's documents; ``rest``: counts of its n-grams in other slices, in the order in which they were dealt."""
        owner, grams = np.repeat(np.arange(len(lengths)), lengths), _grams(ids, lengths, order, bits)
        context = unigram[ids] - grams[0].own
        value = np.log(np.maximum(context, 1) / max(1, corpus))
        by, _ = _dealt(_keys(ids, grams, order, bits), buckets)
        others = np.empty(len(by), dtype=np.int64)
        others[by] = rest
        for g in grams[1:]:
            elsewhere, others = g.total + others[: len(g.total)], others[len(g.total) :]
            count = np.zeros(len(ids), dtype=np.int64)
            count[g.at] = elsewhere[g.which] - g.own
            seen = count[g.at] > 0
            value[g.at[~seen]] += np.log(backoff)
            value[g.at[seen]] = np.log(count[g.at[seen]] / context[g.at[seen] - 1])
            context = count
        return np.bincount(owner, weights=value, minlength=len(lengths))

    dealt = sliced.select("slice", "lengths", "ids", "width").mapInArrow(deal, "bucket long, slice long, keys binary, counts binary")
    summed = dealt.repartition(max(least, -(-buckets // 2)), "bucket").sortWithinPartitions("bucket").mapInArrow(add_up, "slice long, bucket long, rest binary")
    # A slice's lists come in the order of the buckets, its own row after them.
    back = summed.select("slice", "bucket", "rest", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_ids", "binary"), ("nulls", "binary"), ("lengths", "binary"), ("ids", "binary"), ("width", "int"))))
    own = sliced.select("slice", F.lit(buckets).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("rest"), "doc_ids", "nulls", "lengths", "ids", "width")
    met = back.union(own).repartition(max(least, -(-sliced.count() // 2)), "slice").sortWithinPartitions("slice", "bucket")
    scores = met.mapInArrow(score, "doc_id long, n_tokens long, log_score double")
    return scores.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))


def _vocabulary_size(tokenizer: str) -> int:
    """One more than the largest id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1
