"""Small files and folders by Hadoop paths, so that they may lie wherever Spark can write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """The file system of a path, whichever it is."""

    def __init__(self, spark: SparkSession):
        self.spark, self.fs = spark, spark._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        target = self.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, path: str) -> bool:
        target, system = self._at(path)
        return system.exists(target)

    def read(self, path: str) -> str | None:
        """The text of a small file; None if there is none."""
        target, system = self._at(path)
        if not system.exists(target):
            return None
        stream = system.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, new: bool = False) -> bool:
        """Puts a small file in place whole; with ``new`` only if there is none yet (else False)."""
        target, system = self._at(path)
        if new:
            try:
                stream = system.create(target, False)
            except Exception as e:
                if "AlreadyExists" in str(e) or system.exists(target):
                    return False
                raise
            stream.write(text.encode())
            stream.close()
            return True
        part, _ = self._at(f"{path}.{uuid.uuid4().hex[:8]}.part")
        stream = system.create(part, True)
        stream.write(text.encode())
        stream.close()
        context = self.fs.FileContext.getFileContext(target.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        rename = getattr(self.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(system.makeQualified(part), system.makeQualified(target), how)
        return True

    def delete(self, path: str) -> None:
        target, system = self._at(path)
        system.delete(target, True)

    def names(self, path: str) -> list[str]:
        """What a folder holds, by name; empty if there is none."""
        target, system = self._at(path)
        return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []

    def glob(self, pattern: str) -> list[str]:
        target, system = self._at(pattern)
        return sorted(s.getPath().toString() for s in system.globStatus(target) or [])

    def modified(self, path: str) -> int:
        """Milliseconds since 1970."""
        target, system = self._at(path)
        return system.getFileStatus(target).getModificationTime()

    def put(self, local: str, path: str) -> None:
        """Moves a file of this machine to where it is wanted."""
        target, system = self._at(path)
        system.copyFromLocalFile(True, True, self.fs.Path(f"file://{local}"), target)
