"""Cuts of lineage: whole, typed, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from notaflux import cluster


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, ["a"], {"k": 1.5}), (None, None, None)], "id bigint, xs array<string>, m map<string,double>")
    copy = cluster.cut(df)
    assert copy.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, copy.collect())) == sorted(map(str, df.collect()))
    assert cluster.cut(df.limit(0)).count() == 0
    assert all(f.startswith(("file:", "/")) and "notaflux-" in f for f in copy.inputFiles())


def test_cut_runs_the_stage_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    copy = cluster.cut(spark.range(10).coalesce(1).mapInPandas(count, "id bigint"))
    assert copy.count() == 10 and copy.agg(F.sum("id")).first()[0] == 45 and seen.value == 10


def test_spread_leaves_wide_tables(spark):
    assert cluster.spread(spark.range(100).repartition(9)).rdd.getNumPartitions() == 9
    assert cluster.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_cuts_go_with_their_block(spark):
    import os

    with cluster.cuts(spark):
        path = cluster.cut(spark.range(3)).inputFiles()[0].removeprefix("file:").replace("//", "/")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_private_folders_are_named():
    assert cluster.looks_private("file:///tmp/x") and cluster.looks_private("/tmp") and cluster.looks_private("file:/var/tmp/a")
    assert not any(map(cluster.looks_private, ("hdfs://nn/tmp/x", "s3a://b/tmp", "/mnt/shared/tmp", "file:///mnt/shared")))
