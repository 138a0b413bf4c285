"""Small files through the file system that Spark uses for a path."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


class Files:
    """Lists, reads, writes and deletes below any path that Spark can reach."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple[JavaObject, JavaObject]:
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def names(self, folder: str) -> list[str]:
        fs, where = self._at(folder)
        if not fs.exists(where):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(where))
        return sorted(n for n in names if not n.startswith((".", "_")))

    def write(self, path: str, text: str) -> None:
        """Appears as a whole: written beside, then renamed."""
        folder, _, name = path.rpartition("/")
        fs, beside = self._at(f"{folder}/_{name}")
        out = fs.create(beside, True)
        out.write(text.encode())
        out.close()
        self._swap(beside, path)

    def _swap(self, beside: JavaObject, path: str) -> None:
        """Put a file in the place of another, which readers see until then."""
        fs, where = self._at(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.conf)
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(kinds.OVERWRITE.getClass(), 1)
        options[0] = kinds.OVERWRITE
        context.rename(beside, where, options)

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return bool(fs.exists(where))

    def rename(self, path: str, to: str) -> None:
        """Move a folder to a name that does not exist yet."""
        fs, where = self._at(path)
        target = self._at(to)[1]
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(where, target):
            raise OSError(f"cannot move {path} to {to}")

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        size = int(fs.getFileStatus(where).getLen())
        if not size:
            return ""
        stream = fs.open(where)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def size(self, path: str) -> int:
        """Bytes of all files below a path; 0 if there is none."""
        fs, where = self._at(path)
        return int(fs.getContentSummary(where).getLength()) if fs.exists(where) else 0

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)
