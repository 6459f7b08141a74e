"""CSV export of ranked reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit.operators.report import REPORT_COLUMNS, candidate_report

# Rows of one job in one file. A job with more gets several, numbered by ``part``, that follow each other.
ROWS_PER_FILE = 1_000_000

CSV_OPTIONS = {
    "header": False,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "lineSep": "\r\n",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_csv(ranked: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write the report of ranked candidates as ``job_id=…/part=…/*.csv``, in rank order.

    A job is one CSV: its parts put together in order, of which only the first begins with the header,
    as a row in front of the candidate with rank 1. So no task writes a whole job of many rows. An
    empty frame writes no file.
    """
    part = F.floor((F.col("rank") - 1) / F.lit(rows_per_file)).alias("part")
    report = candidate_report(ranked, "job_id", "rank").select("*", part)
    fields = [F.col(f"`{c}`").cast("string").alias(c) for c in REPORT_COLUMNS]
    header = F.struct(*(F.lit(c).alias(c) for c in REPORT_COLUMNS))
    lines = F.when(F.col("rank") == 1, F.array(header, F.struct(*fields))).otherwise(F.array(F.struct(*fields)))
    (
        report.repartition("job_id", "part")
        .select("job_id", "part", "rank", F.posexplode(lines).alias("_line", "_row"))
        .sortWithinPartitions("job_id", "part", "rank", "_line")
        .select("_row.*", "job_id", "part")
        .write.mode("overwrite")
        .partitionBy("job_id", "part")
        .options(**CSV_OPTIONS)
        .csv(path)
    )


def read_exported_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read an export back, with the job it belongs to and without the headers."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in REPORT_COLUMNS])
    schema.add("job_id", T.LongType()).add("part", T.LongType())
    is_header = F.lit(True)
    for column in REPORT_COLUMNS:
        is_header &= F.col(f"`{column}`") == column
    return (
        spark.read.schema(schema)
        .options(**CSV_OPTIONS, multiLine=True)
        .csv(path)
        .na.fill("", list(REPORT_COLUMNS))
        .filter(~is_header)
    )
