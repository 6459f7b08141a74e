"""Positions of rows in an order within groups of any size."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolefit.llm.common import stored
from rolefit.plans.joins import sized_join


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_rank``, from 0 and without gaps in ``order`` within ``group``, and ``_total`` of the group.

    Rows alike in ``group`` and ``order`` are ranked one after the other and must be alike in all
    columns. Such rows are counted first, so a row that makes up a third of a table is one row; then
    rows are range-partitioned, so a group is spread over as many ranges as it fills. A rank is the
    count of the group's rows in earlier ranges and of earlier rows in the range. Null comes first.
    """
    keys = [group, *order]
    others = [F.first(c).alias(c) for c in rows.columns if c not in keys]
    counted = rows.groupBy(*keys).agg(*others, F.count(F.lit(1)).alias("_copies"))
    placed = counted.repartitionByRange(*(F.col(k).asc_nulls_first() for k in keys))
    placed = stored(placed.withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(group, "_range").agg(F.sum("_copies").alias("_sum"))
    sums = sums.select(
        group,
        "_range",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_sum").over(W.partitionBy(group)).alias("_total"),
    )
    inside = W.partitionBy(group, "_range").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    inside = inside.rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("_inside", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    numbered = sized_join(numbered, stored(sums, "range-sums"), [group, "_range"])
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1))
    numbered = numbered.withColumn("_copy", copy)
    rank = F.col("_before") + F.col("_inside") + F.col("_copy")
    return numbered.withColumn("_rank", rank).select(*rows.columns, "_rank", "_total")
