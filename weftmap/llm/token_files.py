"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A set of files holds the documents in ascending order of their id. One file holds, in this order:

* the ids of its documents, 16 or 32 bits each, little-endian, with nothing between documents;
* an Elias-Fano code of the documents' end positions (low bits packed, high bits in unary, and the
  bit position of every 512th one for select);
* the document ids and a mask of those that are null;
* a JSON footer, its length (8 bytes) and the magic ``WEFTIDS1``.

The boundaries take about 2 + log2(ids per document) bits a document instead of 64.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import slices, texts_of
from ._store import fresh_path
from ._tokens import encoder

MAGIC = b"WEFTIDS1"
#: A file is closed once it holds this many ids.
FILE_IDS = 64_000_000
SELECT_EVERY = 512
#: Documents whose boundaries are selected, and ids that are read, in one go.
READ_DOCS, READ_IDS = 16_384, 4_000_000

_MANIFEST = "file string, shard int, part int, n_docs long, n_ids long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of non-negative integers, with random access by select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        ones = (values >> bits) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1) if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), ones[::SELECT_EVERY].astype("<u8"))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SELECT_EVERY])
        left = i % SELECT_EVERY
        byte = at >> 3
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        bits[: at & 7] = 0
        while (here := int(bits.sum())) <= left:
            left -= here
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        one = byte * 8 + int(np.flatnonzero(bits)[left])
        low = 0
        for b in range(self.low_bits):
            k = i * self.low_bits + b
            low |= ((int(self.low[k >> 3]) >> (k & 7)) & 1) << b
        return ((one - i) << self.low_bits) | low

    def selects(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi, by select: the samples bound the stretch of high bits to read."""
        if lo >= hi:
            return np.zeros(0, dtype=np.int64)
        start, after = int(self.samples[lo // SELECT_EVERY]), -(-hi // SELECT_EVERY)
        stop = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start >> 3 : (stop >> 3) + 1], bitorder="little")[start & 7 :]) + start
        at = np.arange(lo, hi)
        ones = ones[at - lo // SELECT_EVERY * SELECT_EVERY]
        first = lo * self.low_bits
        low = np.unpackbits(self.low[first >> 3 : (hi * self.low_bits >> 3) + 1], bitorder="little")[first & 7 :][: len(at) * self.low_bits]
        low = (low.reshape(len(at), self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1, dtype=np.int64)
        return ((ones - at) << self.low_bits) | low

    def all(self) -> np.ndarray:
        return self.selects(0, self.n)


def _filesystem(path: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class _FileWriter:
    """Writes one file under a passing name and gives it its own at the end, so that a lost task leaves nothing half done."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, folder = _filesystem(folder)
        self.fs.create_dir(folder, recursive=True)
        self.final, self.passing = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out, self.width = self.fs.open_output_stream(self.passing), width
        self.ends: list[int] = []
        self.doc_ids: list[int | None] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.doc_ids.append(doc_id)

    def close(self) -> None:
        ef = EliasFano.encode(np.array(self.ends, dtype=np.int64))
        parts = {
            "low": ef.low.tobytes(),
            "high": ef.high.tobytes(),
            "samples": ef.samples.tobytes(),
            "doc_ids": np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes(),
            "null_ids": np.packbits([d is None for d in self.doc_ids]).tobytes(),
        }
        at, where = self.n_ids * self.width, {}
        for key, data in parts.items():
            self.out.write(data)
            where[key] = [at, len(data)]
            at += len(data)
        footer = json.dumps({"n_docs": ef.n, "n_ids": self.n_ids, "width": self.width, "low_bits": ef.low_bits, "parts": where}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.passing, self.final)


class TokenFile:
    """Random access to one file."""

    def __init__(self, path: str):
        filesystem, inner = _filesystem(path)
        self.file = filesystem.open_input_file(inner)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        n = int.from_bytes(tail[:8], "little")
        self.info = json.loads(self.file.read_at(n, size - 16 - n))
        part = lambda key, dtype: np.frombuffer(self.file.read_at(self.info["parts"][key][1], self.info["parts"][key][0]), dtype=dtype)
        self.ends = EliasFano(self.info["n_docs"], self.info["low_bits"], part("low", np.uint8), part("high", np.uint8), part("samples", "<u8"))
        self.doc_ids = part("doc_ids", "<i8")
        self.null_ids = np.unpackbits(part("null_ids", np.uint8))[: self.info["n_docs"]].astype(bool)

    def __len__(self) -> int:
        return self.info["n_docs"]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids at positions lo to hi of this file."""
        w = self.info["width"]
        return np.frombuffer(self.file.read_at((hi - lo) * w, lo * w), dtype=f"<u{w}")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending document order below ``path``.

    ``path`` must be a folder that driver and executors share. Documents are dealt to tasks by ranges of
    (id, hash of text), so equal ids do not meet in one task; within a file they are sorted likewise.
    Rows with the same id and text are further parted by a number of their own, so that no group of copies is one task's.
    A null id comes first, a null text is empty, repeated rows are written repeatedly, other columns are
    ignored. Of an empty table no file is written. Returns the manifest: one row per file with the number of
    documents, of ids, and of ids before it (``base``). The manifest is what the driver gathers: a row a file.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("n"))
    rows = rows.repartitionByRange(parts, "d", "h", "n").sortWithinPartitions("d", "h", "n").select("d", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4
        shard, part, out, done = TaskContext.get().partitionId(), 0, None, []
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for piece in slices(batch, "t"):
                for doc_id, ids in zip(piece.column(0).to_pylist(), enc.encode(texts_of(piece, "t"))):
                    if out is None:
                        out = _FileWriter(path, f"ids-{shard:06d}-{part:04d}.bin", width)
                    out.add(doc_id, np.concatenate([np.frombuffer(ids, dtype="<u4"), end]))
                    if out.n_ids >= FILE_IDS:
                        out.close()
                        done.append((out.final.rpartition("/")[2], shard, part, len(out.ends), out.n_ids))
                        part, out = part + 1, None
        if out is not None:
            out.close()
            done.append((out.final.rpartition("/")[2], shard, part, len(out.ends), out.n_ids))
        cols = list(zip(*done)) or [[]] * 5
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file", "shard", "part", "n_docs", "n_ids"])

    files = sorted(rows.mapInArrow(write, _MANIFEST).collect(), key=lambda r: (r.shard, r.part))
    base, listed = 0, []
    for r in files:
        listed.append((f"{path}/{r.file}", r.n_docs, r.n_ids, base))
        base += r.n_ids
    filesystem, inner = _filesystem(path)
    filesystem.create_dir(inner, recursive=True)
    with filesystem.open_output_stream(f"{inner}/manifest.json") as out:
        out.write(json.dumps([[f.rpartition("/")[2], *rest] for f, *rest in listed]).encode())
    return spark.createDataFrame(listed, "file string, n_docs long, n_ids long, base long")


def open_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of files written before."""
    filesystem, inner = _filesystem(path)
    with filesystem.open_input_stream(f"{inner}/manifest.json") as f:
        listed = [(f"{path}/{name}", *rest) for name, *rest in json.loads(f.read())]
    return spark.createDataFrame(listed, "file string, n_docs long, n_ids long, base long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start among all ids, n_tokens and the CRC-32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(row["file"])
                for first in range(0, len(f), READ_DOCS):
                    yield from _read_some(f, first, min(first + READ_DOCS, len(f)), row["base"])

    n = max(1, manifest.count())
    return manifest.repartition(n, "base").mapInArrow(read, _ROWS)


def _read_some(f: TokenFile, first: int, last: int, base: int) -> Iterator[pa.RecordBatch]:
    """Rows of the documents first to last of one file, whose boundaries come from select."""
    ends = f.ends.selects(first, last)
    starts = np.concatenate([[f.ends.select(first - 1) if first else 0], ends[:-1]]).astype(np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + READ_IDS, "right")))
        block = f.ids(int(starts[lo]), int(ends[hi - 1])).astype("<u4")
        at = starts[lo]
        crcs = [zlib.crc32(block[s - at : e - at].tobytes()) for s, e in zip(starts[lo:hi], ends[lo:hi])]
        own = slice(first + lo, first + hi)
        yield pa.RecordBatch.from_arrays(
            [pa.array(f.doc_ids[own], pa.int64(), mask=f.null_ids[own]), pa.array(starts[lo:hi] + base), pa.array(ends[lo:hi] - starts[lo:hi]), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )
        lo = hi


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read every document back from them: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has its end id only; null ids come first; repeated rows are written repeatedly; other columns are
    ignored; an empty table gives no row.
    """
    return read_token_files(write_token_files(docs, fresh_path(docs.sparkSession, "ids"), tokenizer, end_id))
