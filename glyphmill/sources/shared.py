"""Files and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a local master gets a temporary folder of this process;
    on a cluster, whose executors cannot read that, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.sparkContext.setCheckpointDir(_FALLBACK["dir"])
    return _FALLBACK["dir"]


_OPEN: list[Scratch] = []


def clean() -> None:
    """Deletes all tables that this process has kept so far: for long sessions, between results that are read to the end."""
    while _OPEN:
        _OPEN.pop()._at_exit()


class Scratch:
    """Tables written once and read back, so that a lost executor never costs more than one stage.

    ``drop`` deletes a table as soon as nothing reads it; what a lazy result still needs goes at exit, or by ``clean``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        _OPEN.append(self)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        self.paths[path] = name
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for path in [p for p, n in self.paths.items() if n in names]:
            self._delete(path)
            self.paths[path] = ""

    def put(self, name: str, data: bytes) -> str:
        """The path of a file with these bytes."""
        path = f"{self.root}/{name}"
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = there.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(there, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return path

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(conf).delete(there, True)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone; then the folder's owner clears it
            if not self.spark.sparkContext._jsc.sc().isStopped():
                self._delete(self.root)


atexit.register(clean)
