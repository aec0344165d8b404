"""Small files beside tables, through Hadoop, so that any of its file systems will do."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder whose entries are read, listed, deleted and, at most once, created."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        p, fs = self._at(name)
        return fs.exists(p)

    def names(self, name: str = "") -> list[str]:
        p, fs = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, name: str = "") -> int:
        p, fs = self._at(name)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def read(self, name: str) -> str:
        p, fs = self._at(name)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        p, fs = self._at(name)
        return fs.delete(p, True)

    def create_once(self, name: str, content: str) -> bool:
        """Creates a file unless it is there, and tells whether it did: of several writers one succeeds.

        On a local disk the file appears with its content by a hard link; other
        file systems create it exclusively.
        """
        p, fs = self._at(name)
        if fs.getScheme() == "file":
            path = p.toUri().getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            aside = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
            with open(aside, "w", encoding="utf-8") as out:
                out.write(content)
            try:
                os.link(aside, path)
            except FileExistsError:
                return False
            finally:
                os.unlink(aside)
            return True
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Exception as e:  # another writer was faster
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True
