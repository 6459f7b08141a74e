"""Shards: every record once, sizes by law, an order that only the seed decides."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolefit.llm.sharding import LAWS, key_shard, read_shards, shard_documents, write_shards
from rolefit.session import scratch_path

FIELDS = "doc_id long, text string, shard string, size int, _bucket int"


def odd_rows():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab ß\n") for _ in range(rng.randrange(80))), "x", i, 1) for i in range(400)]
    rows += [(None, None, None, 0, 0), (None, "", "y", 0, 0), (1, None, None, None, None), (400, "long" * 100_000, "", 0, 0)]
    return rows + [rows[7]] * 200 + [(500 + i, "the same text", "", 0, 0) for i in range(100)]


def places(frame):
    return sorted(map(tuple, frame.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=repr)


@pytest.mark.parametrize("law", LAWS)
@pytest.mark.parametrize("bucket_bytes", [700, 48 << 20])
def test_every_record_has_one_place(spark, law, bucket_bytes):
    rows = odd_rows()
    path = scratch_path(spark, "shards")
    write_shards(spark.createDataFrame(rows, FIELDS).repartition(7), path, 8, law, 3, bucket_bytes=bucket_bytes)
    got = read_shards(spark, path)
    assert set(got.columns) == {"doc_id", "text", "shard", "size", "_bucket", "slot"}
    got = got.collect()
    assert Counter((r.doc_id, r.text, r.size, r._bucket) for r in got) == Counter((r[0], r[1], r[3], r[4]) for r in rows)
    counts = Counter(r.shard for r in got)
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    if law == "rows":
        assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    else:
        assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


@pytest.mark.parametrize("law", LAWS)
def test_only_the_seed_decides(spark, law):
    docs = spark.createDataFrame(odd_rows(), FIELDS)
    first = shard_documents(docs.repartition(7), 8, law, 1)
    assert places(first) == places(shard_documents(docs.repartition(2), 8, law, 1))
    assert places(first) != places(shard_documents(docs, 8, law, 2))
    for r in first.collect():
        assert r.law == law and (r.grown_shard is None) == (law == "rows")
    sizes = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows())
    assert sizes == Counter((r.doc_id, r.size, r.text_crc32) for r in first.collect())


def test_a_further_shard_only_takes(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    moved = keys.select(key_shard("doc_id", 8, 0).alias("a"), key_shard("doc_id", 9, 0).alias("b")).collect()
    assert all(r.a == r.b or r.b == 8 for r in moved)
    assert 300 < sum(r.b == 8 for r in moved) < 600
    assert min(Counter(r.a for r in moved).values()) > 400


def test_order_is_shuffled_over_all(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("word " * 20).alias("text"))
    path = scratch_path(spark, "shards")
    write_shards(docs, path, 4, bucket_bytes=20_000)
    rows = read_shards(spark, path).orderBy("shard", "slot").collect()
    ids = [r.doc_id for r in rows]
    neighbours = sum(abs(a - b) == 1 for a, b in zip(ids, ids[1:], strict=False))
    assert neighbours < 15
    for k in range(4):
        assert abs(sum(ids[k * 750 : (k + 1) * 750]) / 750 - 1500) < 150


def test_empty_table(spark):
    none = spark.createDataFrame([], FIELDS)
    for law in LAWS:
        got = shard_documents(none, 8, law)
        assert got.count() == 0 and "grown_shard" in got.columns
    with pytest.raises(ValueError):
        shard_documents(none, 8, "size")


def test_a_task_shuffles_a_small_bucket(spark):
    # 24 MB of records: one task may not hold them all.
    docs = spark.range(2400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("text"))
    path = scratch_path(spark, "shards")
    write_shards(docs, path, 8)
    written = read_shards(spark, path).groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task"))
    bytes_of = [r.held for r in written.agg(F.sum(F.octet_length("text")).alias("held")).collect()]
    assert sum(bytes_of) == 24_000_000 and max(bytes_of) < 16_000_000
