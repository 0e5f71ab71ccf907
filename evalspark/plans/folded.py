"""A table that grows batch by batch and is folded as it grows.

Each batch goes to a folder of its own. After every ``every`` batches all rows so far are folded
into a base by ``merge`` (newest row per key, sums per key), and what the base before that one had
replaced is deleted. A folder counts once Spark has marked it complete (``_SUCCESS``), which is one
atomic step, so readers see a batch or a base whole or not at all, and may go on reading what the
newest base replaces until the next one. A batch that is written again overwrites its folder, or does
nothing if a base holds it already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.operators.reports import newest_by

DONE = "_SUCCESS"  # fixed: the file Spark writes last


def newest_per(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Keep the row of the last batch per key."""
    return lambda rows: newest_by(rows, list(keys), F.desc("_epoch"))


class FoldedTable:
    """``write`` suits ``foreachBatch``; batch numbers grow. ``merge`` takes rows with their batch
    number ``_epoch`` and must give the same however often parts of them were merged before."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, merge: Callable[[DataFrame], DataFrame], every: int = 16):
        self.spark, self.path, self.schema, self.merge, self.every = spark, path, schema, merge, every

    def write(self, batch: DataFrame, epoch: int) -> None:
        base = self._newest_base()
        if base is not None and epoch <= base:
            return
        batch.select(self.schema.names).write.mode("overwrite").parquet(f"{self.path}/changes/{epoch}")
        if len([e for e in self._complete("changes") if base is None or e > base]) >= self.every:
            self._fold(epoch, base)

    def read(self) -> DataFrame:
        """All batches complete now, merged."""
        return self._rows(None)

    def _rows(self, upto: int | None) -> DataFrame:
        base = self._newest_base()
        epochs = [e for e in self._complete("changes") if (base is None or e > base) and (upto is None or e <= upto)]
        parts = [(f"{self.path}/changes/{e}", e) for e in epochs] + ([(f"{self.path}/base/{base}", base)] if base is not None else [])
        found = self.spark.createDataFrame([], self.schema).withColumn("_epoch", F.lit(0).cast("long"))
        for path, epoch in parts:
            found = found.unionByName(self.spark.read.schema(self.schema).parquet(path).withColumn("_epoch", F.lit(epoch).cast("long")))
        return self.merge(found).select(self.schema.names)

    def _fold(self, epoch: int, before: int | None) -> None:
        self._rows(epoch).write.mode("overwrite").parquet(f"{self.path}/base/{epoch}")
        if before is not None:  # readers of the base before may still be at work: delete what that one replaced
            for kind, last in (("base", before - 1), ("changes", before)):
                for e in self._folders(kind):
                    if e <= last:
                        self._fs().delete(self._at(f"{kind}/{e}"), True)

    def _newest_base(self) -> int | None:
        return max(self._complete("base"), default=None)

    def _complete(self, kind: str) -> list[int]:
        return [e for e in self._folders(kind) if self._fs().exists(self._at(f"{kind}/{e}/{DONE}"))]

    def _folders(self, kind: str) -> list[int]:
        if not self._fs().exists(self._at(kind)):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(self._at(kind)) if f.isDirectory()]
        return sorted(int(n) for n in names if n.isdigit())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())
