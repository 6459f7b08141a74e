"""Shards of shuffled records: scatter into memory-sized buckets, shuffle each bucket, write it."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolefit.llm.common import stored, whole
from rolefit.session import scratch_path

# Bytes of records that one task holds while it shuffles them; a list, its copies and the shuffled
# one take several times as much.
BUCKET_BYTES = 8 << 20
LAWS = ("rows", "key")


def record_size(text: str) -> Column:
    """UTF-8 bytes of a text, none for null, and one more."""
    return (F.octet_length(whole(text)) + 1).cast("bigint")


def key_shard(key: str, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is highest: a further shard takes keys, no other changes."""
    marked = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda shard: F.struct(F.xxhash64(F.lit(seed), F.col(key), shard).alias("hash"), shard.alias("shard")),
    )
    return F.array_max(marked)["shard"]


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int,
    law: str = "rows",
    seed: int = 0,
    id_column: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> None:
    """Shuffle all rows of ``docs`` and write them below ``path``, as ``shard=N`` in order of ``slot``.

    Pass one scatters the records by a seeded hash into buckets of about ``bucket_bytes``, pass two
    shuffles every bucket in memory (a seeded Fisher-Yates shuffle, the built-in one of arrays) and
    writes it; texts are shuffled over the network once. A bucket is one task, whose seed is its
    number, so a retried task and a rerun give the same order.

    ``law`` says which shard a record goes to. ``rows``: the buckets stand one after the other and are
    cut into ``shards`` pieces whose row counts differ by one at most. ``key``: the id and the number
    of shards decide (``key_shard``), and every shard has buckets of its own.

    Rows with equal ids are separate records; the n copies of a row equal in all columns are numbered
    and scattered each for itself. Null ids and null or empty texts are records like others. A bucket
    is larger than ``bucket_bytes`` only if one record is. An empty table gives no files. Columns named
    ``shard`` or ``slot`` are replaced, all others pass; columns of map type are refused, as they have
    no hash. ``path-schema`` holds the columns. An existing path is an error.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    kept = docs.drop("shard", "slot")
    columns = [F.col(f"`{c}`") for c in kept.columns]
    of = key_shard(id_column, shards, seed) if law == "key" else F.lit(0)
    records = kept.select(
        F.struct(*columns).alias("_record"),
        F.xxhash64(*columns).alias("_one"),
        F.xxhash64(F.lit("other"), *columns).alias("_two"),
        of.alias("_of"),
        record_size(text).alias("_size"),
    )
    typed = kept.limit(0).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")})
    typed.write.parquet(f"{path}-schema")

    slim = records.groupBy("_one", "_two").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_of").alias("_of"), F.min("_size").alias("_size")
    )
    slim = stored(slim, "record-hashes")
    spans = slim.groupBy("_of").agg(
        F.sum("_n").alias("_rows"),
        F.ceil(F.sum(F.col("_n") * F.col("_size")) / bucket_bytes).cast("int").alias("_buckets"),
    )
    earlier = W.partitionBy().orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_base", F.coalesce(F.sum("_buckets").over(earlier), F.lit(0)).cast("int"))
    spans = stored(spans, "bucket-spans")
    n_buckets, n_rows = spans.agg(F.sum("_buckets"), F.sum("_rows")).first()
    if not n_rows:
        typed.write.partitionBy("shard").parquet(path)
        return

    def scattered(rows: DataFrame) -> DataFrame:
        # One row per shard under law "key", one row under law "rows".
        placed = rows.join(F.broadcast(spans.select("_of", "_buckets", "_base")), "_of")
        mixed = F.xxhash64(F.lit(seed), F.lit("bucket"), "_one", "_two", "_copy")
        bucket = (F.col("_base") + F.pmod(mixed, F.col("_buckets"))).cast("int")
        return placed.withColumn("_bucket", bucket).drop("_buckets", "_base", "_size")

    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    counts = scattered(slim.withColumn("_copy", copy)).groupBy("_bucket").agg(
        F.min("_of").alias("_of"), F.count(F.lit(1)).alias("_count")
    )
    within = W.partitionBy("_of").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(
        "_bucket", F.col("_of").alias("_shard"), F.coalesce(F.sum("_count").over(within), F.lit(0)).alias("_first")
    )
    firsts = stored(firsts, "bucket-starts")

    if slim.filter("_n > 1").isEmpty():
        records = records.withColumn("_copy", F.lit(0).cast("bigint"))
    else:
        records = records.groupBy("_one", "_two").agg(
            F.first("_record").alias("_record"), F.min("_of").alias("_of"), F.count(F.lit(1)).alias("_n")
        )
        records = records.withColumn("_copy", copy)
    buckets = (
        scattered(records)
        .repartitionById(int(n_buckets), F.col("_bucket"))
        .sortWithinPartitions("_bucket", "_one", "_two", "_copy")
        .groupBy("_bucket")
        .agg(F.collect_list("_record").alias("_records"))
    )
    mixed = buckets.select("_bucket", F.posexplode(F.shuffle("_records", F.lit(seed))).alias("_pos", "_record"))
    # One row per bucket: total bytes / bucket_bytes rows of 20 bytes.
    mixed = mixed.join(F.broadcast(firsts), "_bucket")
    mixed = mixed.withColumn("_place", F.col("_first") + F.col("_pos"))
    if law == "key":
        mixed = mixed.withColumn("slot", F.col("_place"))
    else:
        # Shard k has the places from k * n_rows / shards on, rounded down.
        cut = f"CAST(((_place + 1) * {shards} - 1) DIV {n_rows} AS INT)"
        mixed = mixed.withColumn("_shard", F.expr(cut))
        mixed = mixed.withColumn("slot", F.expr(f"_place - (_shard * {n_rows}) DIV {shards}"))
    placed = mixed.select("_record.*", F.col("_shard").alias("shard"), "slot")
    placed.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``path`` with their ``shard`` and ``slot``; a filter on ``shard`` prunes folders."""
    return spark.read.schema(spark.read.parquet(f"{path}-schema").schema).parquet(path)


def shard_documents(
    docs: DataFrame, shards: int, law: str = "rows", seed: int = 0, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write ``docs`` in shards and return ``id, size, text_crc32, law, shard, slot, grown_shard`` of the files.

    ``grown_shard`` is the shard with one shard more under law ``key`` and null otherwise.
    """
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, law, seed, id_column, text)
    grown = key_shard(id_column, shards + 1, seed) if law == "key" else F.lit(None)
    return read_shards(docs.sparkSession, path).select(
        id_column,
        record_size(text).alias("size"),
        F.crc32(F.encode(whole(text), "UTF-8")).alias("text_crc32"),
        F.lit(law).alias("law"),
        "shard",
        "slot",
        grown.cast("int").alias("grown_shard"),
    )
