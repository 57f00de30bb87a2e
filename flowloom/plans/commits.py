"""An ordered log of commits, one small file each, that two writers can't both extend."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    """Commits 1, 2, ... of ``folder``, each a text that is there as a whole or not at all.

    A commit is written beside its place and renamed to it, which fails where another
    writer was first. That holds on file systems that rename atomically (HDFS, local); on
    an object store it needs a committer that does.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.folder}/{name}")

    def latest(self) -> int:
        """The number of the last commit, 0 if there is none."""
        where = self.hadoop.Path(self.folder)
        if not self.files.exists(where):
            return 0
        names = (s.getPath().getName() for s in self.files.listStatus(where))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, number: int) -> str:
        return self.spark.read.text(f"{self.folder}/{number:012d}", wholetext=True).first()[0]

    def append(self, number: int, text: str) -> bool:
        """Make ``text`` commit ``number``; False, and nothing changed, if there is one already."""
        draft = self._path(f".{uuid.uuid4().hex}")
        out = self.files.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = getattr(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(self.files.makeQualified(draft), self.files.makeQualified(self._path(f"{number:012d}")), never)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.files.delete(draft, False)

    def folders(self, path: str) -> dict[str, int]:
        """Names of the folders in ``path`` and when they last changed, in milliseconds."""
        where = self.hadoop.Path(path)
        return {s.getPath().getName(): s.getModificationTime() for s in self.files.listStatus(where) if s.isDirectory()} if self.files.exists(where) else {}

    def delete(self, path: str) -> None:
        self.files.delete(self.hadoop.Path(path), True)
