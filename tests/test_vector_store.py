"""Bucketed store: no exchange by id, bounded files, loud ids; shard folders of few files."""

import glob
import uuid

import pytest
from pyspark.sql import functions as F

from nearline.session import scratch_path
from nearline.sources import io
from nearline.sources.vector_store import create_store, open_store


def reps(spark, lo, hi):
    return spark.range(lo, hi, numPartitions=7).select("id", F.array(F.col("id") * 0.5, F.lit(1.0)).alias("rep"))


def files(store):
    return glob.glob(store.folder.removeprefix("file:") + "/*.parquet")


def test_store_appends_compacts_and_joins_without_exchange(spark):
    name, path = f"s{uuid.uuid4().hex}", scratch_path(spark, "store")
    store = create_store(reps(spark, 0, 300), name, path, buckets=4)
    assert len(files(store)) == 4
    store = store.append(reps(spark, 300, 350)).append(reps(spark, 350, 351))
    assert store.writes == 3 and len(files(store)) <= 9 and store.read().count() == 351
    small = store.compact()
    assert len(files(small)) == 4 and small.writes == 1
    assert sorted(small.read().collect()) == sorted(reps(spark, 0, 351).collect())
    other = create_store(reps(spark, 100, 200), name + "b", path + "b", buckets=4)
    joined = small.read().join(other.read().select("id", F.col("rep").alias("r")).hint("merge"), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 100
    small.drop_old()
    assert not files(store) and small.read().count() == 351
    again = open_store(spark, name + "c", path, 4, version=1)
    assert again.read().where("id = 7").first().rep == [3.5, 1.0] and again.append(reps(spark, 400, 410)).read().count() == 361


def test_store_refuses_bad_ids(spark):
    name, path = f"s{uuid.uuid4().hex}", scratch_path(spark, "store")
    store = create_store(reps(spark, 0, 10), name, path, buckets=2)
    with pytest.raises(Exception, match="stored already"):
        store.append(reps(spark, 9, 12))
    assert store.read().count() == 10
    none = spark.createDataFrame([(None, [1.0])], "id bigint, rep array<double>")
    for bad in (none, reps(spark, 20, 22).union(reps(spark, 21, 23))):
        with pytest.raises(ValueError, match="missing or stands on"):
            store.append(bad)
        with pytest.raises(ValueError):
            create_store(bad, name + "x", path + "x", buckets=2)
    assert create_store(reps(spark, 0, 0), name + "e", path + "e", 2).append(reps(spark, 0, 5)).read().count() == 5


def test_shard_folders_hold_few_files(spark):
    path = scratch_path(spark, "shards")
    many = reps(spark, 0, 2000).repartition(40).withColumn("shard", F.pmod("id", F.lit(3)).cast("int"))
    io.write_reps(many, path, files=2)
    for shard in range(3):
        assert 1 <= len(glob.glob(f"{path.removeprefix('file:')}/shard={shard}/*.parquet")) <= 2
    assert io.read_reps(spark, path).count() == 2000
