"""What several of the operators share."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.session import scratch_path

# ASCII white space and words as every operator here reads them.
SPACES = " \t\n\v\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps start from files."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def whole(text: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def squeezed(text: Column) -> Column:
    """Without white space at the ends, one blank for every run inside."""
    return F.regexp_replace(F.btrim(text, F.lit(SPACES)), SPACE_RUN, " ")


def bucketed_running_sum(
    frame: DataFrame, group: list[str], chunk: str, order: list[Column], value: str, out: str
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of ``group``, in order of ``chunk`` and then ``order``.

    The rows of a group are summed by chunk first, so no task gets more than one chunk of a group;
    only the sums of the chunks of a group meet in one task.
    """
    from pyspark.sql import Window as W

    before = W.partitionBy(*group) if group else W.partitionBy()
    before = before.orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*group, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        frame.groupBy(*group, chunk)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    summed = frame.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        summed.join(offsets, [*group, chunk])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside")
    )
