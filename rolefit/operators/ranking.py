"""Ranks of candidates within their job."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefit.plans.joins import sized_join
from rolefit.plans.layout import stored

# Rows of one job with one score that a single task may be given.
CELL_ROWS = 200_000


def _order():
    return [F.col("matching_score").desc_nulls_last(), F.col("candidate_id").asc()]


def rank_candidates(scored: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``scored`` with ``rank`` 1..n per job: score descending, no score last, then candidate id.

    Scores have two decimals, so a job has about 10,001 of them at most: a cell is a job and a score.
    Counting the cells tells how many candidates of the job stand before each, and a candidate's rank
    is that and the position inside the cell. No task gets a whole job; a cell with more than
    ``cell_rows`` rows, as for a score that a third of all candidates share, is cut by ranges of ids.
    Scores with more decimals give more cells and the same ranks.

    The input is computed once and written; cells are counted from its job, score and id columns.
    Rows without a job form one group, rows without a score the last cell of their job; equal rows get
    ranks one after the other. Names with an underscore are reserved.
    """
    rows = stored(scored, "scored")
    job, score, who = F.col("job_id"), F.col("matching_score"), F.col("candidate_id")
    keyed = {
        "_job": F.coalesce(job.cast("string"), F.lit("")),
        "_unscored": score.isNull(),
        "_score": F.coalesce(score, F.lit(0.0)),
    }
    cell = list(keyed)
    cells = rows.withColumns(keyed).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(who).cast("double").alias("_low"),
        F.max(who).cast("double").alias("_high"),
    )
    cells = stored(cells, "score-cells")
    crowded = cells.filter(F.col("_n") > cell_rows).withColumn("_pieces", F.ceil(F.col("_n") / cell_rows))
    pieced = rows.withColumns(keyed)
    if crowded.isEmpty():
        pieced = pieced.withColumn("_piece", F.lit(0).cast("bigint"))
        counted = cells.withColumn("_piece", F.lit(0).cast("bigint"))
    else:
        # At most rows / cell_rows of them.
        pieced = sized_join(pieced, crowded.drop("_n"), cell, "left", "candidate_id")
        place = (who.cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * F.col("_pieces")
        piece = F.when(F.col("_pieces").isNull() | who.isNull(), 0).otherwise(F.floor(place))
        pieced = pieced.withColumn("_piece", piece.cast("bigint")).drop("_pieces", "_low", "_high")
        counted = pieced.groupBy(*cell, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy("_job")
        .orderBy("_unscored", F.col("_score").desc(), "_piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = counted.select(
        *cell, "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*cell, "_piece").orderBy(who.asc())
    return (
        pieced.withColumn("_position", F.row_number().over(inside))
        .join(before, [*cell, "_piece"])
        .withColumn("rank", (F.col("_before") + F.col("_position")).cast("int"))
        .select(*scored.columns, "rank")
    )


def top_k_candidates(scored: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` candidates of each job. Each task keeps its own best ``k`` before the shuffle."""
    window = Window.partitionBy("job_id").orderBy(*_order())
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def list_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs, newest first."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc())


def latest_job_candidates(scored: DataFrame, jobs: DataFrame) -> DataFrame:
    """Ranked candidates of the newest job."""
    newest = list_jobs(jobs.select("job_id", "created_at")).limit(1).select("job_id")
    return rank_candidates(scored.join(F.broadcast(newest), "job_id", "left_semi"))
