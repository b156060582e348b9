"""Versioned generations of a file table: Parquet per generation, one pointer to the active one, bounded retention."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from cairn.operators import state

POINTER = "active.json"


class Store:
    """A folder on any file system that Spark writes: ``generation=N`` folders and the pointer."""

    def __init__(self, spark: SparkSession, folder: str, retention: int = state.RETENTION, quota: int = state.QUOTA_BYTES):
        self.spark, self.folder, self.retention, self.quota = spark, folder.rstrip("/"), retention, quota

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self) -> dict[int, int]:
        """Bytes of each finished generation."""
        if not self._fs.exists(self._path()):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        found = [int(n.split("=")[1]) for n in names if n.startswith("generation=") and n.split("=")[1].isdigit()]
        done = [n for n in found if self._fs.exists(self._path(f"generation={n}/files/_SUCCESS"))]
        return {n: self._fs.getContentSummary(self._path(f"generation={n}")).getLength() for n in sorted(done)}

    def active(self) -> dict | None:
        """The pointer: generation, identity, head, freshness; None if there is none or it points nowhere."""
        if not self._fs.exists(self._path(POINTER)):
            return None
        try:
            stream = self._fs.open(self._path(POINTER))
            try:
                pointer = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
            number = pointer["generation"]
        except (Py4JJavaError, KeyError, ValueError, TypeError) as e:
            raise ValueError(f"{self.folder}/{POINTER} is damaged") from e
        if number not in self.generations():
            raise ValueError(f"active generation {number} is missing")
        return pointer

    def load(self, generation: int | None = None) -> DataFrame:
        number = generation if generation is not None else (self.active() or {}).get("generation")
        if number is None:
            raise ValueError("no active generation")
        return self.spark.read.parquet(f"{self.folder}/generation={number}/files")

    def activate(self, files: DataFrame, head: str = "no-head", freshness: str = "fresh") -> int:
        """Writes a generation, then moves the pointer, then prunes; equal content writes nothing.  Returns its number."""
        now = self.active()
        identity = state.content_identity(files, "path", "contentHash", "kind", "degradedReason")
        facts = {"identity": identity, "head": head, "freshness": freshness}
        if now and {k: now.get(k) for k in facts} == facts:
            return now["generation"]
        number = max([0, *self.generations(), now["generation"] if now else 0]) + 1
        files.write.mode("overwrite").parquet(f"{self.folder}/generation={number}/files")
        self._point({"generation": number, **facts})
        self.prune(number)
        return number

    def _point(self, pointer: dict) -> None:
        fs, new, old = self._fs, self._path(f".{POINTER}.{pointer['generation']}"), self._path(POINTER)
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        rename.rename(fs.makeQualified(new), fs.makeQualified(old), options)

    def prune(self, active: int) -> list[int]:
        """Deletes the oldest generations below the active one until count and bytes are within bounds."""
        sizes = self.generations()
        if not sizes:
            return []
        rows = self.spark.createDataFrame(list(sizes.items()), "generation long, bytes long")
        gone = [r["generation"] for r in state.pruned(rows, active, self.retention, self.quota).where("NOT kept").collect()]
        for number in gone:
            self._fs.delete(self._path(f"generation={number}"), True)
        return sorted(gone)
