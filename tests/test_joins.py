import pytest
from pyspark.sql import functions as F

from rolefit.plans.joins import (
    fits_broadcast,
    payload_bytes,
    salted_join,
    sized_join,
    text_size,
)
from rolefit.plans.layout import spread_small_scan


@pytest.fixture(scope="module")
def sides(spark):
    large = spark.range(1000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("bigint").alias("key"),
    )
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40)] + [(0, "again")], "key long, v string")
    return large, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_every_strategy_gives_the_same_rows(sides, how):
    large, small = sides
    plain = sorted(map(tuple, large.join(small, ["key"], how).collect()), key=repr)
    shuffled = sized_join(large, small, ["key"], how, "row", limit=0)
    sent = sized_join(large, small, ["key"], how, "row")
    salted = salted_join(large, small, ["key"], how, "row", hot_rows=20)
    for frame in (shuffled, sent, salted):
        assert sorted(map(tuple, frame.collect()), key=repr) == plain


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("fits", [True, False])
def test_rows_without_a_key_and_many_hot_keys(sides, how, fits, monkeypatch):
    large, small = sides
    large = large.withColumn("key", F.when(F.col("row") % 4 != 1, F.col("key")))
    plain = sorted(map(tuple, large.join(small, ["key"], how).collect()), key=repr)
    monkeypatch.setattr("rolefit.plans.joins.fits_broadcast", lambda *_: fits)
    salted = salted_join(large, small, ["key"], how, "row", hot_rows=5, counted=large.select("key"))
    assert sorted(map(tuple, salted.collect()), key=repr) == plain


def test_salt_spreads_a_hot_key(sides, spark):
    large, small = sides
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(large, small, ["key"], "inner", "row", hot_rows=20)
        tasks = (
            joined.filter(F.col("key") == 0).select(F.spark_partition_id().alias("p")).distinct()
        )
        assert tasks.count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_size_decides(sides, spark):
    large, small = sides
    assert 0 < payload_bytes(small) < payload_bytes(large)
    assert fits_broadcast(small) and not fits_broadcast(small, limit=10)
    assert fits_broadcast(small, limit=10, bound=5)
    assert text_size(small, "v") == (41, 5 + sum(len(f"v{k}") for k in range(40)))
    assert payload_bytes(small.filter("key < 0")) == 0


def test_spread_leaves_wide_scans_alone(spark):
    narrow, wide = spark.range(10).coalesce(1), spark.range(10, numPartitions=64)
    assert spread_small_scan(narrow, "id").rdd.getNumPartitions() > 1
    assert spread_small_scan(wide, "id") is wide
