"""Small file operations in the store that Spark itself uses: markers, pointers, listings. No table passes through here."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder in any store that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._store = self._fs.Path(self.root).getFileSystem(self._conf)

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _path(self, *parts: str):
        return self._fs.Path(self.at(*parts))

    def exists(self, *parts: str) -> bool:
        return self._store.exists(self._path(*parts))

    def folders(self, *parts: str) -> list[str]:
        """Names of the folders in one, sorted; none if it is not there."""
        if not self.exists(*parts):
            return []
        return sorted(s.getPath().getName() for s in self._store.listStatus(self._path(*parts)) if s.isDirectory())

    def read_text(self, *parts: str) -> str | None:
        if not self.exists(*parts):
            return None
        stream = self._store.open(self._path(*parts))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace_text(self, text: str, *parts: str) -> None:
        """Write a small file whole or not at all: a draft is renamed over what was there."""
        *folder, name = parts
        draft = self._path(*folder, f".{name}-{uuid.uuid4().hex}")
        stream = self._store.create(draft)
        stream.write(text.encode("utf-8"))
        stream.close()
        kind = getattr(self._fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = self._fs.FileContext.getFileContext(self._store.getUri(), self._conf)
        context.rename(self._store.makeQualified(draft), self._store.makeQualified(self._path(*parts)), how)

    def delete(self, *parts: str) -> None:
        self._store.delete(self._path(*parts), True)
