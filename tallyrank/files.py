"""Files of the shared file system that readers see whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Small files under a path, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._spark = path.rstrip("/"), spark
        self._jvm = spark.sparkContext._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def _full(self, name: str):
        return self._at(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._full(name))

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._full(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def names(self, name: str = "") -> list[str]:
        """The visible entries of a folder, sorted; none if it is missing."""
        if not self.exists(name):
            return []
        found = (x.getPath().getName() for x in self._fs.listStatus(self._full(name)))
        return sorted(x for x in found if not x.startswith(("_", ".")))

    def write(self, name: str, data: bytes, replace: bool = True) -> None:
        """One atomic rename puts the file in place. FileExistsError if replace is off and it is there already."""
        folder, _, _ = name.rpartition("/")
        hidden = self._full(f"{folder}/_{uuid.uuid4().hex}" if folder else f"_{uuid.uuid4().hex}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(data))
        out.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if replace else kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._full(name).toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(hidden), self._fs.makeQualified(self._full(name)), options)
        except Exception as e:
            self._fs.delete(hidden, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(name) from None
            raise

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._full(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._full(name), True)
