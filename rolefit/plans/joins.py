"""Joins of a large frame with one that is usually, but not always, small."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.session import ensure_checkpoint_dir

# Largest side, in bytes of its text form, that is sent whole to every executor.
BROADCAST_BYTES = 128 * 1024 * 1024
# Rows of one key that a single task may be given when both sides have to be shuffled.
HOT_KEY_ROWS = 100_000
ROW_OVERHEAD = 32


def payload_bytes(frame: DataFrame) -> int:
    """Measured size of a frame: one aggregate over it, one number to the driver."""
    size = F.octet_length(F.to_json(F.struct("*"))) + F.lit(ROW_OVERHEAD)
    return frame.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def fits_broadcast(frame: DataFrame, limit: int | None = None, bound: int | None = None) -> bool:
    """Whether the size of a frame is within the broadcast limit.

    ``bound`` is an upper bound the caller derived from measured inputs. If it settles the question,
    the frame itself need not be computed to measure it.
    """
    allowed = BROADCAST_BYTES if limit is None else limit
    if bound is not None and bound <= allowed:
        return True
    return payload_bytes(frame) <= allowed


def text_size(frame: DataFrame, column: str) -> tuple[int, int]:
    """Measured rows and bytes of a text column: one scan of that column."""
    size = F.coalesce(F.sum(F.octet_length(column)), F.lit(0))
    rows, total = frame.agg(F.count(F.lit(1)), size).first()
    return rows, total


def sized_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: str | None = None,
    limit: int | None = None,
    bound: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join that broadcasts ``small`` only if it was measured to fit, else shuffles with salt.

    ``how`` may be inner, left, left_semi or left_anti. ``spread`` names a column of ``large`` that
    varies within a key; it decides which copy of a hot key a row goes to.
    """
    if fits_broadcast(small, limit, bound):
        return large.join(F.broadcast(small), on, how)
    return salted_join(large, small, on, how, spread, counted=counted)


def salted_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: str | None = None,
    hot_rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join in which every hot key of ``large`` is spread over several tasks.

    Keys are counted first (combined before the shuffle). A key with more than ``hot_rows`` rows gets
    ``ceil(rows / hot_rows)`` copies of its rows in ``small`` and each of its rows in ``large`` goes
    to one of them, chosen by hash so that a retried task chooses alike. There are at most
    ``rows / hot_rows`` hot keys; they are counted once and broadcast if they fit, else joined with a
    shuffle that adaptive execution splits. Rows with a NULL key match nothing and go anywhere.
    ``counted`` is a cheaper frame with the same keys to count instead of ``large``.
    """
    per_copy = HOT_KEY_ROWS if hot_rows is None else hot_rows
    ensure_checkpoint_dir(large.sparkSession)
    hot = (
        (large if counted is None else counted)
        .groupBy(*on)
        .count()
        .filter(F.col("count") > per_copy)
        .select(*on, F.ceil(F.col("count") / per_copy).cast("int").alias("_copies"))
        .checkpoint()
    )
    if fits_broadcast(hot):
        hot = F.broadcast(hot)
    varying = [F.col(spread)] if spread else [F.col(c) for c in large.columns]
    without_key = reduce(Column.__or__, (F.col(c).isNull() for c in on))
    salted_large = (
        large.join(hot, on, "left")
        .withColumn(
            "_salt",
            F.when(without_key, F.xxhash64(*varying))
            .when(F.col("_copies").isNotNull(), F.pmod(F.xxhash64(*varying), F.col("_copies")))
            .otherwise(F.lit(0).cast("bigint")),
        )
        .drop("_copies")
    )
    salted_small = (
        small.join(hot, on, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.sequence(F.lit(0).cast("bigint"), F.coalesce("_copies", F.lit(1)).cast("bigint") - 1)
            ),
        )
        .drop("_copies")
    )
    return salted_large.join(salted_small, [*on, "_salt"], how).drop("_salt")
