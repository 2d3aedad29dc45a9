"""Small file operations on the driver, through Hadoop, so that any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def qualified(self, path: str) -> str:
        """The path in full, with scheme and authority, as Spark names its input files."""
        fs, p = self._at(path)
        return str(fs.makeQualified(p).toUri().toString()).rstrip("/")

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        q = self.jvm.org.apache.hadoop.fs.Path(new)
        if q.getParent() is not None:
            fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"cannot rename {old} to {new}")

    def copy(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        q = self.jvm.org.apache.hadoop.fs.Path(new)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, q.getFileSystem(self.conf), q, False, True, self.conf)
