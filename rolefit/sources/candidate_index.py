"""Where a candidate is stored: files of ids in order, so that one id reads few pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 8 << 20


def write_candidate_index(candidates: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write ``candidate_id, job_id`` of all candidates, by ranges of ids and in order inside each.

    Row groups hold disjoint ranges of ids with a bloom filter each, pages have an index. Replaces an
    index at ``path``.
    """
    rows = candidates.select("candidate_id", "job_id").repartitionByRange("candidate_id")
    rows.sortWithinPartitions("candidate_id").write.mode("overwrite").options(
        **{
            "parquet.block.size": row_group_bytes,
            "parquet.bloom.filter.enabled#candidate_id": "true",
            "parquet.writer.version": "PARQUET_2_0",
        }
    ).parquet(path)


def candidate_by_id(spark: SparkSession, index: str, candidates: DataFrame, candidate_id: int) -> DataFrame:
    """The rows of one candidate in a table stored by job, none if the id is unknown.

    The index tells the jobs; with them the table is read in those jobs' folders only, where the id
    is pushed down to the row groups. Rows without a job are looked for by id.
    """
    places = spark.read.schema("candidate_id long, job_id long").parquet(index)
    found = places.filter(F.col("candidate_id") == candidate_id).select("job_id").distinct()
    jobs = [row["job_id"] for row in found.toLocalIterator()]
    wanted = F.col("job_id").isin([j for j in jobs if j is not None])
    if None in jobs:
        wanted = wanted | F.col("job_id").isNull()
    return candidates.filter((F.col("candidate_id") == candidate_id) & wanted)
