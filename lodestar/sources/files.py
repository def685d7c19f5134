"""Small files and folders in whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import StorageError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        at = self.path
        for n in names:
            at = self.jvm.org.apache.hadoop.fs.Path(at, n)
        return at

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self._at(*names))

    def list(self, *names: str) -> list[str]:
        at = self._at(*names)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, *names: str) -> str:
        stream = self.fs.open(self._at(*names))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, text: str, *names: str) -> None:
        """Write a file whole or not at all; an error if it is there already."""
        at = self._at(*names)
        part = self._at(*names[:-1], f".{names[-1]}.part")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(at) or not self.fs.rename(part, at):
            self.fs.delete(part, False)
            raise StorageError(f"{at.toString()} was written by another process")

    def delete(self, *names: str) -> None:
        self.fs.delete(self._at(*names), True)
