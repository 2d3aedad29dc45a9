"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``RADIUS`` differing bits are linked. The 64 bits are put into four chunks of 16 so that
bits which vary together share one; a partition is a chunk or several. For a split into m partitions, two
fingerprints within the radius lie within t_i bits in some partition i if the t_i add up to RADIUS - m + 1
(t_i = -1: the partition is not probed). How many pairs each t_i would bring is computed from the exact
distance distribution of every chunk, and dynamic programming picks the cheapest thresholds of the cheapest
split. Equal fingerprints are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batches import gathered, slices, texts_of
from ._pairs import meet, pairs, star, whole_groups
from ._rows import by_position, fresh_name, join_hot, without_rows
from ._store import materialize
from .components import connected_components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
CHUNKS, CHUNK_BITS = 4, 16
#: A probe costs about as much as this many compared pairs.
PROBE_COST = 20.0
#: Ways to join chunks to partitions.
SPLITS = ([[0], [1], [2], [3]], [[0], [1], [2, 3]], [[0, 1], [2, 3]])


def _fingerprints_of(texts: list[str]) -> np.ndarray:
    """64-bit fingerprints of whole texts."""
    from xxhash import xxh64_intdigest

    hashes, counts = [], []
    for text in texts:
        words = text.encode().lower().split()
        if len(words) > SHINGLE_WORDS:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS))))
            mine = [xxh64_intdigest(s, SEED) for s in shingles]
        else:
            mine = [xxh64_intdigest(b" ".join(words), SEED)] if words else []
        hashes.append(np.array(mine, dtype="<u8"))
        counts.append(len(mine))
    n = np.array(counts)
    out = np.zeros(len(texts), dtype="<u8")
    for i, h in enumerate(hashes):
        if len(h):
            ones = np.zeros(64, dtype=np.int64)
            for lo in range(0, len(h), 65536):
                ones += np.unpackbits(h[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > n[i], bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, fp): each row's id and fingerprint as a signed long. ASCII letters are lower-cased; words are separated by ASCII blanks;
    a text of fewer than three words is one shingle, one without words (or null) has fingerprint 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(_fingerprints_of(texts_of(piece, "t")).view("<i8"))], names=["d", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(compute, "d long, fp long")


def correlated_order(gram: np.ndarray, n: int) -> list[int]:
    """Bits in an order in which each run of 16 varies together. gram[i, j]: rows with bits i and j set."""
    p = np.diag(gram) / n
    cov = gram / n - np.outer(p, p)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    tie = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, order = set(range(64)), []
    while free:
        rest = sorted(free)
        chunk = [max(rest, key=lambda b: (tie[b, rest].sum(), -b))]
        free.discard(chunk[0])
        while len(chunk) < CHUNK_BITS:
            rest = sorted(free)
            chunk.append(max(rest, key=lambda b: (tie[b, chunk].sum(), -b)))
            free.discard(chunk[-1])
        order += sorted(chunk)
    return order


def distance_shares(hist: np.ndarray) -> np.ndarray:
    """Share of ordered pairs at each number of differing bits, from the counts of all values, by the Walsh-Hadamard transform."""
    a = hist.astype(float)
    h = 1
    while h < len(a):
        a = a.reshape(-1, 2, h)
        a = np.stack([a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]], axis=1).reshape(-1)
        h *= 2
    a = a * a
    h = 1
    while h < len(a):
        a = a.reshape(-1, 2, h)
        a = np.stack([a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]], axis=1).reshape(-1)
        h *= 2
    at = np.maximum(a / len(a), 0)
    by = np.bincount(np.bitwise_count(np.arange(len(a))), weights=at)
    return by / max(by.sum(), 1.0)


def allocate(shares: list[np.ndarray], n: int, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """The split and its thresholds with the lowest estimated cost."""
    best = None
    for split in SPLITS:
        costs = []
        for chunk_ids in split:
            dist = np.ones(1)
            for c in chunk_ids:
                dist = np.convolve(dist, shares[c])
            width = CHUNK_BITS * len(chunk_ids)
            near = np.cumsum(dist)
            costs.append([0.0, *(near[t] * n * n / 2 + PROBE_COST * n * sum(comb(width, k) for k in range(t + 1)) for t in range(radius + 1))])
        goal = radius - len(split) + 1 + len(split)  # thresholds shifted by one, so that they start from 0
        table = {0: (0.0, [])}
        for cost in costs:
            table = {
                total: min(((table[total - t][0] + cost[t], [*table[total - t][1], t - 1]) for t in range(radius + 2) if total - t in table), key=lambda x: x[0])
                for total in range(goal + 1)
                if any(total - t in table for t in range(radius + 2))
            }
        if best is None or table[goal][0] < best[0]:
            best = (table[goal][0], split, table[goal][1])
    return best[1], best[2]


def _permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits[:, order]).ravel(), bitorder="little").view("<u8")


def _probes(split: list[list[int]], thresholds: list[int], order: list[int]):
    """A mapInArrow function: fingerprints to (key, fp, probe)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view("<u8")
            turned = _permuted(fp, order)
            at = 0
            for i, (chunk_ids, t) in enumerate(zip(split, thresholds)):
                width = CHUNK_BITS * len(chunk_ids)
                if t >= 0:
                    value = ((turned >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    masks = [sum(1 << b for b in bits) for k in range(t + 1) for bits in combinations(range(width), k)]
                    for mask in masks:
                        yield pa.RecordBatch.from_arrays([pa.array((i << 40) | (value ^ mask)), pa.array(fp.view("<i8")), pa.array(np.full(len(fp), mask != 0))], names=["key", "fp", "probe"])
                at += width

    return emit


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the pairs within the radius, as stars."""
    for table, first, count in whole_groups(batches, "key"):
        fp = table.column("fp").to_numpy()
        probe = table.column("probe").to_numpy()
        bits = fp.view("<u8")
        found_a, found_b = [], []
        for a, b in pairs(first, count):
            near = (np.bitwise_count(bits[a] ^ bits[b]) <= RADIUS) & ~(probe[a] & probe[b]) & (fp[a] != fp[b])
            if near.any():
                u, v = star(fp[a[near]], fp[b[near]])
                found_a.append(u)
                found_b.append(v)
        if found_a:
            u, v = star(np.concatenate(found_a), np.concatenate(found_b))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        bits = np.unpackbits(batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += bits.T @ bits
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))], names=["at", "n"])


def _chunk_counts(order: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = _permuted(batch.column("fp").to_numpy(), order).view("<u2").reshape(-1, CHUNKS).astype(np.int64)
            at, n = np.unique(turned + (np.arange(CHUNKS) << CHUNK_BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], names=["at", "n"])

    return count


def simhash_links(unique: DataFrame) -> DataFrame:
    """(u, v): links that join all fingerprints within the radius of each other; ``unique`` has one row per fingerprint, in column fp."""
    gram, n = np.zeros(4096), max(1, unique.count())
    for r in unique.select("fp").mapInArrow(_bit_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 4096 rows
        gram[r["at"]] = r["n"]
    order = correlated_order(gram.reshape(64, 64), n)
    counts = gathered(unique.select("fp").mapInArrow(_chunk_counts(order), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")))  # 2^18 rows at most
    hist = np.zeros(CHUNKS << CHUNK_BITS)
    hist[counts["at"]] = counts["n"]
    split, thresholds = allocate([distance_shares(h) for h in hist.reshape(CHUNKS, -1)], n)
    rows = unique.select("fp").mapInArrow(_probes(split, thresholds, order), "key long, fp long, probe boolean")
    return meet(rows, "key", "fp").mapInArrow(_verified, "u long, v long")


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, n_rows, winner) of every fingerprint of ``rows`` (fp, d, r): how many rows have it, and the row that stands for its component,
    as (whether its id is null, the id, the row's number): that with the smallest id, and of several the first."""
    own = F.min(F.struct(F.col("d").isNull().alias("no_id"), "d", "r")).alias("first")
    unique = materialize(rows.groupBy("fp").agg(own, F.count("*").alias("n_rows")), "unique")
    parts = connected_components(simhash_links(unique))
    labelled = unique.join(parts, unique.fp == parts.node, "left").select("fp", "first", "n_rows", F.coalesce("component", "fp").alias("label"))
    winners = labelled.groupBy("label").agg(F.min("first").alias("winner"), F.count("*").alias("_n"))
    return materialize(join_hot(labelled.drop("first"), winners, "label", "_n").select("fp", "n_rows", "winner"), "classes")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable by links), kept.

    Rows with a null id are linked like others but never name a component unless all its ids are null, which gives
    a null component_id; kept is true where doc_id = component_id. Repeated rows and ids give a row each; other columns
    are ignored; an empty table gives no row.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _classes(rows.withColumn("r", F.lit(0).cast("long"))).select("fp", "n_rows", F.col("winner.d").alias("component_id"))
    return join_hot(rows, named, "fp", "n_rows").select(
        F.col("d").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("d") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates: of each group one row stays, that with the smallest id; of several with that id, or if all
    ids are null, the first as stored. Other rows go, whatever their ids are elsewhere. All columns are kept as they are; an empty table stays empty.
    """
    return by_position(docs, _deduplicated, id_col, text_col)


def _deduplicated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    number, fp = fresh_name(docs.columns, "row"), fresh_name(docs.columns, "fp")
    names = [*docs.columns, number]
    numbered = docs.withColumn(number, F.monotonically_increasing_id())

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(_fingerprints_of(texts_of(piece, text_col)).view("<i8"))], names=[*names, fp])

    schema = T.StructType([*numbered.schema.fields, T.StructField(fp, T.LongType())])
    stored = materialize(numbered.mapInArrow(compute, schema), "documents")
    rows = stored.select(F.col(id_col).cast("long").alias("d"), F.col(number).alias("r"), F.col(fp).alias("fp"))
    found = join_hot(rows, _classes(rows).select("fp", "n_rows", F.col("winner.r").alias("stays")), "fp", "n_rows")
    return without_rows(stored.drop(fp), number, materialize(found.where(F.col("r") != F.col("stays")).select("r"), "gone"))
