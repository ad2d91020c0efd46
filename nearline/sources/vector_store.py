"""Vectors stored bucketed and sorted by id, appended to and compacted.

A store is an external table of the session catalog over a folder that all
executors share.  Rows are exchanged by id once, when written: joins by id between
stores of as many buckets, and look-ups by id, read them without an exchange.  Each
write leaves at most one file a bucket; ``compact`` brings the store back to that.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearline.session import release


@dataclass(frozen=True)
class VectorStore:
    """Handle of a store: catalog ``name``, root ``path``, ``version`` of its folder, ``buckets``, and writes since compaction."""

    spark: SparkSession
    name: str
    path: str
    buckets: int
    version: int = 0
    writes: int = 0

    @property
    def table(self) -> str:
        return f"{self.name}_v{self.version}"

    @property
    def folder(self) -> str:
        return f"{self.path.rstrip('/')}/v{self.version}"

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, reps: DataFrame, mode: str) -> "VectorStore":
        dealt = reps.repartition(self.buckets, "id").sortWithinPartitions("id")
        (dealt.write.mode(mode).format("parquet").bucketBy(self.buckets, "id").sortBy("id")
         .option("path", self.folder).saveAsTable(self.table))
        return replace(self, writes=self.writes + 1)

    def append(self, reps: DataFrame) -> "VectorStore":
        """The store with new rows (same columns, by name); ids that are null, repeated or stored already raise."""
        reps = _checked(reps.select(*self.read().columns))
        # Raises inside the write, so the new rows are read once; the store side is not exchanged.
        known = self.read().select(F.col("id").alias("known"))
        again = F.raise_error(F.concat(F.lit("id is stored already: "), F.col("known").cast("string"))).cast("boolean")
        fresh = (reps.repartition(self.buckets, "id").join(known, F.col("id") == F.col("known"), "left")
                 .where(F.when(F.col("known").isNotNull(), again).otherwise(F.lit(True))).drop("known"))
        return self._write(fresh, "append")

    def compact(self) -> "VectorStore":
        """One file a bucket again, in a new folder; readers of the old version go on until ``drop_old``."""
        # Read as plain files: over a bucketed scan the planner drops the exchange, then the buckets that nothing else needs.
        plain = self.spark.read.parquet(self.folder)
        return replace(self, version=self.version + 1, writes=0)._write(plain, "errorifexists")

    def drop_old(self) -> None:
        """Forget and delete the versions before this one."""
        old = [replace(self, version=v) for v in range(self.version)]
        for store in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {store.table}")
        release(self.spark, [store.folder for store in old])


def _checked(reps: DataFrame) -> DataFrame:
    bad = reps.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id is null or n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"id {bad[0]['id']} is missing or stands on {bad[0]['n']} rows")
    return reps


def create_store(reps: DataFrame, name: str, path: str, buckets: int) -> VectorStore:
    """Write ``reps`` (a column ``id``, any others) as a new store; null or repeated ids raise."""
    return VectorStore(reps.sparkSession, name, path, buckets)._write(_checked(reps), "errorifexists")


def open_store(spark: SparkSession, name: str, path: str, buckets: int, version: int = 0) -> VectorStore:
    """A store written by another session, registered again under its name."""
    store = VectorStore(spark, name, path, buckets, version)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(store.folder).schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {store.table} ({columns}) USING parquet "
              f"CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{store.folder}'")
    return store
