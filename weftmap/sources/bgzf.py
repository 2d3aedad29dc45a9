"""Block-compressed text (BGZF): a .gz file made of blocks of at most 64 KB, which several tasks can read.

A file is cut into byte ranges. A range's reader looks for the first block that begins in it, and reads the lines that begin in its
blocks; the last of them may end in a later block. So every line is read once, wherever the cuts fall.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import Files

#: Compressed bytes that a task reads, about.
SPLIT_BYTES = 64_000_000
#: How every block begins.
_MAGIC = b"\x1f\x8b\x08\x04"
#: No block is longer.
_LONGEST = 1 << 16


def _open(path: str):
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return filesystem.open_input_file(inner)


def _block_size(head: bytes, at: int = 0) -> int | None:
    """Size of the block that begins at a place of ``head``; None if none does."""
    if head[at : at + 4] != _MAGIC or len(head) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", head, at + 10)
    i, end = at + 12, at + 12 + extra
    while i + 4 <= min(end, len(head)):
        tag, size = head[i : i + 2], struct.unpack_from("<H", head, i + 2)[0]
        if tag == b"BC" and size == 2 and i + 6 <= len(head):
            return struct.unpack_from("<H", head, i + 4)[0] + 1
        i += 4 + size
    return None


def _first_block(file, start: int, size: int) -> int:
    """Where the first block at or after ``start`` begins; the file's size if there is none. A place counts if another block, or the end, follows it."""
    head = file.read_at(min(2 * _LONGEST + 64, size - start), start)
    at = head.find(_MAGIC)
    while at >= 0:
        n = _block_size(head, at)
        if n and (start + at + n == size or _block_size(file.read_at(min(64, size - start - at - n), start + at + n)) is not None):
            return start + at
        at = head.find(_MAGIC, at + 1)
    return size


def _blocks(file, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, contents) of the blocks from one on."""
    while at < size:
        head = file.read_at(min(_LONGEST, size - at), at)
        n = _block_size(head)
        if n is None:
            raise ValueError("not a block-compressed file")
        yield at, zlib.decompress(head[:n], 31)
        at += n


def _lines(path: str, start: int, end: int, size: int) -> Iterator[list[bytes]]:
    """Lists of the lines that begin in blocks of a byte range. A line that begins exactly with a range's first block is the range before's."""
    file, rest, own = _open(path), b"", start == 0
    for at, data in _blocks(file, start and _first_block(file, start, size), size):
        if at >= end:  # only the line that is open, up to its end
            head, newline, _ = data.partition(b"\n")
            rest += head
            if newline:
                break
            continue
        if not own:
            _, newline, data = data.partition(b"\n")
            if not newline:
                continue
            own = True
        *whole, rest = (rest + data).split(b"\n")
        if whole:
            yield whole
    if own and rest:
        yield [rest]


def read_bgzf(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The lines of a block-compressed file, or of all files of a folder, as ``value``. Files of no block give no line; a plain .gz file is an error."""
    files = Files(spark)
    names = [f"{path.rstrip('/')}/{n}" for n in files.names(path) if not n.startswith(("_", "."))] if files.is_dir(path) else [path]
    ranges = [(n, a, min(a + split_bytes, size), size) for n in names for size in [files.size(n)] for a in range(0, size, split_bytes)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for lines in _lines(row["path"], row["a"], row["b"], row["size"]):
                    yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode() for x in lines], pa.string())], names=["value"])

    frame = spark.createDataFrame(ranges, "path string, a long, b long, size long")
    return frame.repartition(max(1, len(ranges))).mapInArrow(read, "value string")
