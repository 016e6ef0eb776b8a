"""A folder of batches that is folded into a base from time to time, so that reading it costs what its keys cost.

Every batch has a folder of its number and replaces it when it is run again; a folder counts once Spark's ``_SUCCESS``
stands in it. Every ``every`` batches all that counts is merged into ``base=N``, which stands for the batches up
to N; those it covers are then passed over, whether they are still there or come again in a replay. Folders that the
base before covered are deleted, so that a reader that has just listed the target still finds its files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Target:
    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], every: int = 8):
        self.spark, self.path, self.merge, self.every = spark, path.rstrip("/"), merge, every
        jvm = spark.sparkContext._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind."""
        root = self._file(self.path)
        if not self._fs.exists(root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in numbers if self._fs.exists(self._file(f"{self.path}/{kind}={n}/_SUCCESS")))

    def parts(self) -> tuple[int, list[int]]:
        """The base (-1: none) and the batches after it."""
        base = max(self._numbers("base"), default=-1)
        return base, [n for n in self._numbers("batch") if n > base]

    def put(self, rows: DataFrame, number: int) -> None:
        """Writes a batch, and a new base when enough batches have come since the last."""
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        base, batches = self.parts()
        if len(batches) >= self.every:
            self.compact()

    def compact(self) -> None:
        base, batches = self.parts()
        if not batches:
            return
        self.read().drop("batch").write.mode("overwrite").parquet(f"{self.path}/base={batches[-1]}")
        for kind in ("base", "batch"):
            for n in self._numbers(kind):
                if n < base or (kind == "batch" and n == base):
                    self._fs.delete(self._file(f"{self.path}/{kind}={n}"), True)

    def read(self) -> DataFrame:
        """The merged rows; ``merge`` gets those of the base and of each batch with their number as ``batch``."""
        base, batches = self.parts()
        folders = ([("base", base)] if base >= 0 else []) + [("batch", n) for n in batches]
        if not folders:
            raise FileNotFoundError(f"{self.path} has no complete batch")
        frames = [self.spark.read.parquet(f"{self.path}/{kind}={n}").withColumn("batch", F.lit(n).cast("long")) for kind, n in folders]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return self.merge(out)
