"""Block-compressed text and HDF5 containers."""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np
import pytest

from weftmap import cli
from weftmap.operators.ingest import InvalidPairs
from weftmap.sources import collection as C
from weftmap.sources import text as T
from weftmap.sources.bgzf import read_bgzf


def bgzf(text: bytes, sizes) -> bytes:
    """Blocks with the given numbers of bytes, in turn."""
    out, at, k = b"", 0, 0
    while at < len(text) or not k:
        part = text[at : at + sizes[k % len(sizes)]]
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(part) + squeeze.flush()
        out += b"\x1f\x8b\x08\x04" + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
        at, k = at + len(part), k + 1
    return out


def test_every_line_is_read_once_wherever_ranges_end(spark, tmp_path):
    rng = np.random.default_rng(3)
    lines = [f"line {i} " + "x" * int(rng.integers(0, 200)) for i in range(300)]
    for name, text in (("a", "\n".join(lines) + "\n"), ("b", "\n".join(lines)), ("c", "\r\n".join(lines))):
        for sizes in ((97, 13, 400), (7,), (100_000,)):
            path = tmp_path / f"{name}.gz"
            path.write_bytes(bgzf(text.encode(), sizes))
            for split in (1000, 4096, 10**9):
                assert sorted(r.value for r in read_bgzf(spark, str(path), split).collect()) == sorted(lines)
    (tmp_path / "none.gz").write_bytes(bgzf(b"", (1,)))
    assert read_bgzf(spark, str(tmp_path / "none.gz")).collect() == []
    (tmp_path / "plain.gz").write_bytes(zlib.compress(b"x"))
    with pytest.raises(Exception, match="block-compressed"):
        read_bgzf(spark, str(tmp_path / "plain.gz")).collect()


def test_indexed_pairs(spark, tmp_path):
    path = str(tmp_path / "p.gz")
    with open(path, "wb") as f:
        f.write(bgzf(b"#h\nr1\ta\t5\ta\t30\nr2\ta\t7\tb\t1\nr3\tb\t3\tb\t3\n", (9,)))
    places = {"c1": 2, "p1": 3, "c2": 4, "p2": 5}
    assert T.read_indexed_pairs(spark, path, **places).count() == 3
    (tmp_path / "sizes").write_text("a\t40\nb\t20\n")
    assert cli.main(["cload", f"{tmp_path}/sizes:10", path, f"file://{tmp_path}/m", "--index", "pairix", "-c1", "2", "-p1", "3", "-c2", "4", "-p2", "5"], spark) == 0
    assert sorted(tuple(r) for r in C.ContactMatrix(spark, f"file://{tmp_path}/m").pixels_frame.collect()) == [(0, 2, 1), (0, 4, 1), (4, 4, 1)]
    with open(path, "wb") as f:
        f.write(bgzf(b"r1\ta\t5\tb\t3\nr2\tb\t7\ta\t1\n", (9,)))
    with pytest.raises(InvalidPairs):
        T.read_indexed_pairs(spark, path, **places)


FAKE = '''"""Stands in for h5py: a container is a folder of .npy files."""
import json, os
import numpy as np

class Group:
    def __init__(self, path): self.path = path
    def __getitem__(self, key):
        p = os.path.join(self.path, key.strip("/"))
        return np.load(p + ".npy") if os.path.exists(p + ".npy") else Group(p)
    def __iter__(self): return iter(sorted(x.removesuffix(".npy") for x in os.listdir(self.path) if not x.endswith(".json")))
    def __contains__(self, key): return os.path.exists(os.path.join(self.path, key)) or os.path.exists(os.path.join(self.path, key + ".npy"))
    def keys(self): return list(self)
    @property
    def attrs(self):
        with open(os.path.join(self.path, "attrs.json")) as f: return json.load(f)

class File(Group):
    def __init__(self, path, mode="r"): super().__init__(path)
    def __enter__(self): return self
    def __exit__(self, *a): pass
'''


def test_import_of_a_container(spark, tmp_path):
    """With a stand-in for h5py, which is not installed here: driver and workers find it in a folder that Spark ships."""
    (tmp_path / "fake").mkdir()
    (tmp_path / "fake" / "h5py.py").write_text(FAKE)
    box = tmp_path / "box" / "resolutions" / "10"
    tables = {
        "chroms": {"name": np.array([b"a", b"b"]), "length": np.array([40, 15], dtype="i4")},
        "bins": {"chrom": np.array([0, 0, 0, 0, 1, 1], dtype="i4"), "start": np.array([0, 10, 20, 30, 0, 10], dtype="i4"), "end": np.array([10, 20, 30, 40, 10, 15], dtype="i4"), "weight": np.array([1, 2, np.nan, 1, 1, 1.0])},
        "pixels": {"bin1_id": np.array([0, 0, 3]), "bin2_id": np.array([0, 4, 5]), "count": np.array([7, 1, 2], dtype="i4")},
    }
    for table, columns in tables.items():
        (box / table).mkdir(parents=True)
        for c, x in columns.items():
            np.save(box / table / f"{c}.npy", x)
    (box / "attrs.json").write_text('{"storage-mode": "symmetric-upper", "genome-assembly": "toy", "metadata": "{}"}')
    spark.sparkContext.addPyFile(str(tmp_path / "fake" / "h5py.py"))
    sys.path.insert(0, str(tmp_path / "fake"))
    try:
        from weftmap.sources import hdf5

        source = f"{tmp_path}/box"
        assert hdf5.list_groups(source) == ["/resolutions/10"]
        assert hdf5.read_table(spark, source, "/resolutions/10", "pixels", chunk_rows=2).count() == 3
        m = hdf5.import_matrix(spark, f"{source}::/resolutions/10", f"file://{tmp_path}/m")
        assert m.info["sum"] == 10 and m.chromsizes == {"a": 40, "b": 15} and m.binsize == 10 and m.info["genome-assembly"] == "toy"
        assert [r.chrom for r in m.bins_frame.orderBy("bin_id").collect()] == ["a"] * 4 + ["b"] * 2 and "weight" in m.bins()
    finally:
        sys.path.remove(str(tmp_path / "fake"))
        sys.modules.pop("h5py", None)
