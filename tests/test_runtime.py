from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from symbolake import runtime as R


def test_salting_keeps_every_pair(spark, monkeypatch):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, i long")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c"), (None, "d")], "k string, v string")
    hot = R.heavy_keys(left, "k", 0.1)
    assert "hot" in hot and len(hot) <= 10
    a, b, on = R.salted(left, right, "k", hot, 4)
    assert a.where("k = 'hot'").select("_salt").distinct().count() > 1
    got = Counter(map(tuple, a.join(b, on).select("k", "i", "v").collect()))
    assert got == Counter(map(tuple, left.join(right, "k").select("k", "i", "v").collect()))
    assert a.join(b, on, "left_anti").count() == left.join(right, "k", "left_anti").count()
    monkeypatch.setattr(R, "LIGHT_BYTES", 1 << 70)
    assert R.heavy_keys(left, "k", 0.1) == []
    assert R.heavy_keys(left.limit(0), "k") == []


def test_materialized_frames_and_clearing(spark):
    df = R.materialize(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 10 and df.agg(F.sum("x")).first()[0] == 90
    assert R.clear(spark) >= 1


def test_scope_and_counts(spark):
    kept = R.materialize(spark.range(3), "t", keep=True)
    with R.scope(spark):
        df, n = R.materialize_counted(spark.range(7), "t")
        assert n == df.count() == 7
        at = R._WRITTEN[-1].removeprefix("file://")
        assert Path(at).exists()
    assert not Path(at).exists() and kept.count() == 3
    place = R.place(spark, "x")
    spark.range(1).write.parquet(place)
    assert R.clear(spark) >= 2 and not Path(place.removeprefix("file://")).exists()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1024]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        R.shared_dir(Session())
