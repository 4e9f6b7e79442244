"""Keyed tables that are upserted by appending: a bucketed log of changes, merged on read, compacted now and then.

Under ``root``: ``deltas/epoch=E/bucket=B`` has the new rows of write E, one a key; ``base/v=E/bucket=B`` what a
compaction at epoch E left of the buckets that had changes. Rows are dealt to buckets by a hash of the key, so an upsert
reads and writes the buckets of its keys only, and a compaction rewrites the buckets that changed. A folder counts once
its ``_SUCCESS`` file is there. Nothing that a reader may have listed is changed: a write has its own epoch, which a
replay overwrites with the same rows, and a compaction its own version. One writer at a time, as in ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.session import list_paths

BUCKETS = 64
DELETED = "_deleted"


class KeyedLog:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = f"{schema}, {DELETED} boolean"
        self.columns = spark.createDataFrame([], schema).columns
        other = {p.rsplit("/buckets=", 1)[1] for p in list_paths(spark, f"{self.root}/buckets=*")} - {str(buckets)}
        if other:
            raise ValueError(f"the table has {other.pop()} buckets")
        self.root += f"/buckets={buckets}"

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _numbers(self, kind: str, name: str) -> list[int]:
        found = list_paths(self.spark, f"{self.root}/{kind}/{name}=*/_SUCCESS")
        return sorted(int(p.rsplit(f"/{name}=", 1)[1].split("/")[0]) for p in found)

    def epochs(self) -> list[int]:
        return self._numbers("deltas", "epoch")

    def versions(self) -> list[int]:
        return self._numbers("base", "v")

    def _base(self, at: int | None) -> DataFrame | None:
        """The rows of each bucket's newest version, tombstones and all; none where there is no version."""
        newest: dict[str, str] = {}
        for v in self.versions():
            if at is None or v <= at:
                for p in list_paths(self.spark, f"{self.root}/base/v={v:012d}/bucket=*"):
                    newest[p.rsplit("bucket=", 1)[1]] = p
        if not newest:
            return None
        return self.spark.read.schema(self.schema).parquet(*newest.values())

    def _merged(self, below: int | None) -> DataFrame:
        versions = [v for v in self.versions() if below is None or v < below]
        base = self._base(versions[-1]) if versions else None
        epochs = [e for e in self.epochs() if (not versions or e > versions[-1]) and (below is None or e < below)]
        if not epochs:
            return base if base is not None else self.spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/deltas/epoch={e:012d}" for e in epochs]
        deltas = self.spark.read.schema(f"{self.schema}, bucket int, epoch long").option("basePath", f"{self.root}/deltas").parquet(*paths)
        row = F.struct(*[c for c in (*self.columns, DELETED)])
        newest = deltas.groupBy(*[F.col(k).alias(f"_{k}") for k in self.key]).agg(F.max_by(row, "epoch").alias("row")).select("row.*")
        if base is None:
            return newest
        return base.join(newest.select(*self.key), self.key, "left_anti").select(*newest.columns).unionByName(newest)

    def read(self, below: int | None = None) -> DataFrame:
        """The table as of all writes, or of those before an epoch. A small delta side is broadcast by its measured
        size, so the base is then not shuffled."""
        return self._merged(below).where(f"NOT {DELETED}").select(*self.columns)

    def rows_of(self, keys: DataFrame, below: int | None = None) -> DataFrame:
        """The rows of some keys."""
        return self.read(below).join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def write(self, rows: DataFrame, epoch: int, deleted: bool = False) -> None:
        """New rows, one a key, as write ``epoch``; or the keys that go. Writing an epoch again replaces it."""
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in self.columns]).withColumn(DELETED, F.lit(deleted))
        rows = self.spark.createDataFrame([], self.schema).unionByName(rows).withColumn("bucket", self.bucket())
        (rows.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/deltas/epoch={epoch:012d}"))

    def upsert(self, changes: DataFrame, epoch: int, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Write ``fold(rows of the changes' keys as before this epoch, changes)``."""
        self.write(fold(self.rows_of(changes, below=epoch), changes), epoch)

    def compact(self) -> int | None:
        """Merge all writes into new versions of the buckets they touch; returns the version, None without new writes."""
        done = self.versions()
        epochs = [e for e in self.epochs() if not done or e > done[-1]]
        if not epochs:
            return None
        deltas = self.spark.read.option("basePath", f"{self.root}/deltas").parquet(*[f"{self.root}/deltas/epoch={e:012d}" for e in epochs])
        touched = deltas.select("bucket").distinct()
        rows = self._merged(epochs[-1] + 1).withColumn("bucket", self.bucket()).join(F.broadcast(touched), "bucket")      # at most BUCKETS rows
        rows.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base/v={epochs[-1]:012d}")
        return epochs[-1]
