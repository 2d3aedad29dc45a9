"""Benchmark decontamination with suffix arrays over shards of the documents.

A shard's words are numbered by the benchmark's vocabulary, 0 for words outside it. The shard's suffix array
holds the positions whose suffix could begin a match: those with enough numbered words ahead. Every suffix of
every benchmark item is found in it by binary search, by its first ten words at once for all suffixes: the range of equal beginnings
are the match's locations. From each location the longest verbatim match is then found among the benchmark's own sorted suffixes
with that beginning, by a binary search of the rest of the document. Shards are slices of one task's rows, so
documents are read once, in place, and nothing of them is shuffled; contaminated ones are removed where they are found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import slices, texts_of
from ._rows import by_position, fresh_name, without_rows
from ._store import materialize

WINDOW = 10
#: Bytes of benchmark text that are sent to every task at once, as some 20 times as many bytes of tables; a larger benchmark is searched for block by block.
BLOCK_BYTES = 8_000_000
#: Bytes of document text in a shard.
SHARD_BYTES = 4_000_000

#: A-Z to lower case; ASCII that is neither letter nor digit to a blank; other bytes stay.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: ASCII letters and digits, and all characters beyond ASCII."""
    return text.encode().translate(_WORD_BYTES).split()


def _cut_at_end(rows: np.ndarray) -> np.ndarray:
    """Rows of words with zeros from their first zero on."""
    return np.where(np.logical_and.accumulate(rows > 0, axis=1), rows, 0)


def _suffix_order(words: np.ndarray) -> np.ndarray:
    """Rank of the suffix at each position, by doubling; a 0 ends a suffix, and suffixes that are equal up to it have one rank."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        ahead = np.zeros(len(words), dtype=np.int64)
        ahead[: len(words) - k] = rank[k:] if k < len(words) else 0
        ahead[words == 0] = 0
        new = np.unique(rank * (len(words) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        k *= 2
        if new.max(initial=0) == rank.max(initial=0) or k >= len(words):
            return new
        rank = new


@dataclass
class TestSuffixes:
    """The benchmark as numbered words: items one after another with a 0 after each, and its distinct windows."""

    __test__ = False
    vocabulary: dict[bytes, int]
    item_ids: list
    starts: np.ndarray  # of items, with the end
    words: np.ndarray
    table: np.ndarray  # distinct windows as zero-padded rows
    first: np.ndarray  # where each window's suffixes stand in ``order``, with the end
    order: np.ndarray  # positions that begin a window, by their suffixes

    @classmethod
    def build(cls, rows: list[tuple], window: int) -> TestSuffixes:
        vocabulary: dict[bytes, int] = {}
        ids, parts, starts = [], [], [0]
        for item_id, text in sorted(rows, key=lambda r: (str(r[0]), r[1] or "")):
            words = words_of(text or "")
            if words:
                ids.append(item_id)
                parts.append(np.array([*(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), 0], dtype=np.int32))
                starts.append(starts[-1] + len(words) + 1)
        starts = np.array(starts)
        words = np.concatenate([*parts, np.zeros(window, dtype=np.int32)])
        size = np.diff(starts) - 1
        begins = np.concatenate([np.arange(a, a + max(0, n - window) + 1) for a, n in zip(starts, size)] or [np.zeros(0, dtype=np.int64)])
        order = begins[np.argsort(_suffix_order(words)[begins], kind="stable")]
        rows = _cut_at_end(np.lib.stride_tricks.sliding_window_view(words, window)[order])
        new = np.flatnonzero(np.concatenate([[True], np.any(rows[1:] != rows[:-1], axis=1)])) if len(rows) else np.zeros(0, dtype=np.int64)
        return cls(vocabulary, ids, starts, words, rows[new].astype(np.int64), np.append(new, len(rows)), order)

    def item_at(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def items_of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the windows, item) for all items that hold them."""
        n = np.diff(self.first)[windows]
        at = np.repeat(self.first[windows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(windows)), n), self.item_at(self.order[at])

    def longest(self, shard: np.ndarray, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match that begins at each place ``at`` of the shard, where ``window`` occurs, and its position in the benchmark."""
        own, tests = _Prints(shard), _Prints(self.words)
        lo, hi = self.first[window], self.first[window + 1]
        best, where = np.zeros(len(at), dtype=np.int64), self.order[lo] if len(at) else at

        def look(who: np.ndarray, place: np.ndarray) -> np.ndarray:
            """Notes the match with the suffix at ``place``; whether the shard's suffix sorts after it."""
            position = self.order[place]
            n = _common(own, at[who], tests, position)
            better = n > best[who]
            best[who[better]], where[who[better]] = n[better], position[better]
            return shard[at[who] + n] > self.words[position + n]

        lo, hi = lo.copy(), hi.copy()
        while len(who := np.flatnonzero(lo < hi)):
            middle = (lo[who] + hi[who]) // 2
            after = look(who, middle)
            lo[who[after]], hi[who[~after]] = middle[after] + 1, middle[~after]
        for place in (lo - 1, lo):  # the neighbours of where it belongs
            who = np.flatnonzero((place >= self.first[window]) & (place < self.first[window + 1]))
            look(who, place[who])
        return best, where


class _Prints:
    """64-bit prints of all stretches of a sequence of words, to compare long stretches in one step."""

    def __init__(self, words: np.ndarray):
        x = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.power = np.cumprod(np.append(np.uint64(1), np.full(len(words), 0xD6E8FEB86659FD93, dtype=np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum((x ^ (x >> np.uint64(32))) * self.power[:-1]))
        end = np.flatnonzero(words == 0)
        self.left = end[np.searchsorted(end, np.arange(len(words)))] - np.arange(len(words))  # words before the next 0

    def of(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.sums[at + n] - self.sums[at]


def _common(a: _Prints, at: np.ndarray, b: _Prints, bt: np.ndarray) -> np.ndarray:
    """Numbers of equal words from the places ``at`` of a and ``bt`` of b on, up to a 0, by halving."""
    low, high = np.zeros(len(at), dtype=np.int64), np.minimum(a.left[at], b.left[bt])
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = a.of(at, middle) * b.power[bt] == b.of(bt, middle) * a.power[at]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


class SuffixArray:
    """Suffixes of a shard of numbered words, compared by their first ``depth`` words; 0 ends a suffix."""

    def __init__(self, words: np.ndarray, least: int, depth: int):
        self.words, self.depth = np.concatenate([words, np.zeros(depth, dtype=np.int64)]), depth
        gap = np.flatnonzero(self.words == 0)
        at = np.flatnonzero(words)
        ahead = gap[np.searchsorted(gap, at)] - at
        at, ahead = at[ahead >= least], ahead[ahead >= least]
        rows = self.words[at[:, None] + np.arange(depth)]
        rows[np.arange(depth) >= ahead[:, None]] = 0
        keys = self._keys(rows)
        order = np.argsort(keys, kind="stable")
        self.at, self.keys = at[order], keys[order]

    @staticmethod
    def _keys(rows: np.ndarray) -> np.ndarray:
        """Rows as byte strings that sort as the rows do."""
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()

    def ranges(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each zero-padded row of words, the range of the array that begins with them."""
        n = (table > 0).sum(axis=1)
        after = table.copy()
        after[np.arange(len(table)), n - 1] += 1
        return np.searchsorted(self.keys, self._keys(table), "left"), np.searchsorted(self.keys, self._keys(after), "left")


def _numbered(texts: list[str], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbered words of all texts, a 0 after each, and where each text starts (with the end)."""
    out, starts, at = [], [0], 0
    get = vocabulary.get
    for text in texts:
        words = words_of(text)
        out.append(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)))
        out.append(np.zeros(1, dtype=np.int64))
        at += len(words) + 1
        starts.append(at)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.int64)), np.array(starts)


@dataclass
class Hits:
    """What a benchmark has in the texts of one shard."""

    n_words: np.ndarray
    n_hit: np.ndarray
    flags: np.ndarray  # of the shard's words
    items: list[list]  # names of each text's items, None for those without
    longest: np.ndarray
    start: np.ndarray  # of the longest match in its text, -1 for none
    item: np.ndarray  # of the longest match
    item_start: np.ndarray

    def names(self, item_ids: list) -> list[str | None]:
        return [None if n == 0 or item_ids[i] is None else str(item_ids[i]) for n, i in zip(self.longest.tolist(), self.item.tolist())]


def _hits(texts: list[str], tests: TestSuffixes) -> Hits:
    words, starts = _numbered(texts, tests.vocabulary)
    n_words, zeros = np.diff(starts) - 1, np.zeros(len(texts), dtype=np.int64)
    out = Hits(n_words, zeros, np.zeros(len(words), dtype=bool), [[] for _ in texts], zeros.copy(), zeros - 1, zeros, zeros.copy())
    if not len(tests.table):
        return out
    size = (tests.table > 0).sum(axis=1)
    array = SuffixArray(words, int(size.min()), tests.table.shape[1])
    lo, hi = array.ranges(tests.table)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return out
    n = (hi - lo)[some]
    w = np.repeat(some, n)
    at = array.at[np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + size[w], -1)
    out.flags = np.cumsum(hit[:-1]) > 0
    out.n_hit = np.add.reduceat(out.flags, starts[:-1]).astype(np.int64)
    text = np.searchsorted(starts, at, "right") - 1
    found = np.unique(np.stack([text, w], 1), axis=0)
    which, item = tests.items_of(found[:, 1])
    for t, i in np.unique(np.stack([found[which, 0], item], 1), axis=0).tolist():
        out.items[t].append(tests.item_ids[i])
    length, where = tests.longest(array.words, at, w)
    order = np.lexsort((where, at, -length, text))
    top = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
    t, item = text[top], tests.item_at(where[top])
    out.longest[t], out.start[t], out.item, out.item_start = length[top], at[top] - starts[t], out.item.copy(), out.item_start.copy()
    out.item[t], out.item_start[t] = item, where[top] - tests.starts[item]
    return out


_MATCH = "longest long, longest_start long, longest_item string, longest_item_start long"


def _match_columns(hits: Hits, item_ids: list) -> list[pa.Array]:
    none = hits.longest == 0
    return [pa.array(hits.longest), pa.array(hits.start, mask=none), pa.array(hits.names(item_ids), pa.string()), pa.array(hits.item_start, mask=none)]


def _named(items: list) -> list[str | None]:
    """An item's name once, and null once for all items without an id."""
    return [*sorted({str(i) for i in items if i is not None}), *([None] if any(i is None for i in items) else [])]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> list[DataFrame]:
    """The benchmark as parts of about ``limit`` bytes."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-size // limit) or 1
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


_NAMES = ["doc_id", "n_words", "n_hit", "items", "longest", "longest_start", "longest_item", "longest_item_start"]
_FOUND = f"doc_id long, n_words long, n_hit long, items array<string>, {_MATCH}"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_start, longest_item, longest_item_start.

    A window is ``window`` consecutive words of an item, or all words of a shorter item; a document's word inside
    any occurrence of a window is hit. Null and empty texts have no words; an item without words has no window.
    items_sha256 is of the ids of items with an occurring window, sorted as strings and joined by commas (of the
    empty string if there are none); items that share an id count as one, as do all items without an id, which are not named.
    longest is the length in words of the longest verbatim match that begins with a window, 0 if there is none; longest_start and
    longest_item_start are where it begins (of several the first in the document), and longest_item is an item that holds it.
    Repeated rows and null ids give a row each; other columns are ignored; empty tables give no row, or no hits.
    A benchmark over ``block_bytes`` is searched for block by block and the hits are united.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    if len(blocks) == 1:
        tests = TestSuffixes.build([tuple(r) for r in blocks[0].collect()], window)  # of checked size

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, "t", SHARD_BYTES):
                    hits = _hits(texts_of(piece, "t"), tests)
                    items = pa.array([_named(x) for x in hits.items], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(hits.n_words), pa.array(hits.n_hit), items, *_match_columns(hits, tests.item_ids)], names=_NAMES)

        found = rows.mapInArrow(search, _FOUND)
    else:
        named = materialize(rows.withColumn("k", F.monotonically_increasing_id()), "documents")
        found = _by_blocks(named, blocks, window).drop("k")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"), *_NAMES[4:])


def _by_blocks(named: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """As one block, for rows (k, d, t) with a number k of their own: each document's hits of all blocks put together."""
    parts = []
    for block in blocks:
        tests = TestSuffixes.build([tuple(r) for r in block.collect()], window)

        def search(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, "t", SHARD_BYTES):
                    hits = _hits(texts_of(piece, "t"), tests)
                    cuts = np.cumsum(hits.n_words + 1)
                    packed = [np.packbits(hits.flags[e - n - 1 : e - 1]).tobytes() for e, n in zip(cuts, hits.n_words)]
                    items = pa.array([_named(x) for x in hits.items], pa.list_(pa.string()))
                    columns = [piece.column(0), piece.column(1), pa.array(hits.n_words), pa.array(packed, pa.binary()), items, *_match_columns(hits, tests.item_ids)]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "d", "n_words", "flags", *_NAMES[3:]])

        parts.append(named.select("k", "d", "t").mapInArrow(search, f"k long, d long, n_words long, flags binary, items array<string>, {_MATCH}"))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    # A document's row from each block: as many as there are blocks.
    first = F.struct((-F.col("longest")).alias("short"), F.col("longest_start"), F.col("longest_item"), F.col("longest_item_start"))
    per_doc = every.groupBy("k").agg(
        F.first("d").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("flags").alias("flags"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.min(first).alias("m")
    )
    ordered = F.concat(F.array_sort(F.array_compact("items")), F.filter("items", lambda x: x.isNull()))
    per_doc = per_doc.select("k", "doc_id", "n_words", "flags", ordered.alias("items"), (-F.col("m.short")).alias("longest"), "m.longest_start", "m.longest_item", "m.longest_item_start")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(f, dtype=np.uint8) for f in flags])).sum()) if flags and flags[0] else 0 for flags in batch.column("flags").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(n_hit, pa.int64()) if c == "n_hit" else batch.column(c) for c in _NAMES)], names=["k", *_NAMES])

    return per_doc.mapInArrow(unite, f"k long, {_FOUND}")


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verbatim matches of at least ``least`` words that can't be made longer on either side: item_id, item_start, n_words, doc_id, doc_start (in words).

    From every place in a document one longest match is told, in one item that holds it. Null and empty texts have none; repeated rows
    give theirs each; empty tables give no row. A benchmark over ``block_bytes`` is searched for block by block, and each block's matches are told.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    names = ["item_id", "item_start", "n_words", "doc_id", "doc_start"]
    parts = []
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        tests = TestSuffixes.build([tuple(r) for r in block.collect()], least)

        def search(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, "t", SHARD_BYTES):
                    yield _matches_of(piece, tests, least, names)

        parts.append(rows.mapInArrow(search, "item_id string, item_start long, n_words long, doc_id long, doc_start long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _matches_of(piece: pa.RecordBatch, tests: TestSuffixes, least: int, names: list[str]) -> pa.RecordBatch:
    at = where = length = np.zeros(0, dtype=np.int64)
    starts = np.zeros(1, dtype=np.int64)
    if len(tests.table):
        words, starts = _numbered(texts_of(piece, "t"), tests.vocabulary)
        array = SuffixArray(words, least, least)
        whole = np.flatnonzero(tests.table[:, -1] > 0)  # shorter items have no match of this length
        lo, hi = array.ranges(tests.table[whole])
        n = hi - lo
        at = array.at[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        length, where = tests.longest(array.words, at, np.repeat(whole, n))
        order = np.argsort(at, kind="stable")
        at, where, length = at[order], where[order], length[order]
        keep = np.append(True, (at + length)[1:] > np.maximum.accumulate(at + length)[:-1])[: len(at)]  # ends beyond all before it
        at, where, length = at[keep], where[keep], length[keep]
    text, item = np.searchsorted(starts, at, "right") - 1, tests.item_at(where)
    told = [None if tests.item_ids[i] is None else str(tests.item_ids[i]) for i in item.tolist()]
    columns = [pa.array(told, pa.string()), pa.array(where - tests.starts[item]), pa.array(length), piece.column(0).take(pa.array(text, pa.int64())), pa.array(at - starts[text])]
    return pa.RecordBatch.from_arrays(columns, names=names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they are. A row goes if its own text is contaminated, whatever its id; null texts stay,
    and empty tables give no row, or all rows. With one block of benchmark rows are dropped where they are searched."""
    blocks = _blocks(benchmark, "item_id", "text", block_bytes)
    return by_position(docs, lambda rows, own_id, text: _cleaned(rows, blocks, window, own_id, text), id_col, text_col)


def _cleaned(docs: DataFrame, blocks: list[DataFrame], window: int, id_col: str, text_col: str) -> DataFrame:
    if len(blocks) > 1:
        number = fresh_name(docs.columns, "row")
        stored = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
        found = _by_blocks(stored.select(F.col(number).alias("k"), F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")), blocks, window)
        return without_rows(stored, number, materialize(found.where("n_hit > 0").select("k"), "gone"))
    tests = TestSuffixes.build([tuple(r) for r in blocks[0].collect()], window)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col, SHARD_BYTES):
                yield piece.filter(pa.array(_hits(texts_of(piece, text_col), tests).n_hit == 0))

    return docs.mapInArrow(clean, docs.schema)
