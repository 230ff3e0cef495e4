"""Small files beside large tables, on whatever file system holds the folder: pointers, marks, listings."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Store:
    """A folder of a Hadoop file system (HDFS, an object store, a shared or local disk)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def mark(self, name: str = "") -> tuple[int, int]:
        """(bytes, last change) of a file or of the files of a folder: another value where a table was written again."""
        s = self._fs.getFileStatus(self._path(name))
        files = self._fs.listStatus(self._path(name)) if s.isDirectory() else [s]
        return sum(f.getLen() for f in files), max([f.getModificationTime() for f in files], default=0)

    def replace_by(self, other: str) -> None:
        """Put another folder in this one's place; the old one goes last."""
        jvm = self.spark._jvm
        old, new, here = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{self.root}.old", other, self.root))
        self._fs.delete(old, True)
        self._fs.rename(here, old)
        self._fs.rename(new, here)
        self._fs.delete(old, True)

    def read(self, name: str) -> dict | None:
        """A JSON file's content; None where there is none."""
        if not self.exists(name):
            return None
        lines = self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()
        return json.loads(lines[0]) if lines else None

    def write(self, name: str, content: dict) -> None:
        """Put a JSON file in place in one step: readers see the old one or the new one, never a part."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        new = self._path(f".{name}.new")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(new), self._fs.makeQualified(self._path(name)), how)
