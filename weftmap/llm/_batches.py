"""Arrow batches cut to bounded amounts of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Texts are handled in slices of about this many bytes.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows whose texts hold about ``limit`` bytes; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (held + n > limit or i - lo >= rows):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if len(sizes) > lo:
        yield batch.slice(lo)
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def squeezed(a: np.ndarray) -> bytes:
    """An array's bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def expanded(data: bytes, dtype: str) -> np.ndarray:
    """The array behind compressed bytes."""
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def gathered(table: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of numbers without nulls on the driver, sent as Arrow batches: rows as Python objects, as ``toPandas`` makes them by default, take over ten times the memory."""
    found = table.toArrow()
    return {name: column.to_numpy() for name, column in zip(found.column_names, found.columns)}
