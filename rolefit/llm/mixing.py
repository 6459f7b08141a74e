"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolefit.llm.common import WORD, bucketed_running_sum, stored, whole

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_PASSES = 2
# Odd, and near 2^31 divided by the golden ratio: multiples of it modulo 2^31 spread evenly.
GOLDEN = 1327217885
RANGE = 1 << 31
FINE = 1 << 18
LARGEST_BLOCK = 1 << 20
CHUNK = 4096
CELLS = 4096


def words(text: str) -> Column:
    """The number of words of a text column; 0 for null."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``_source, source_size, target, _low, _high``: what each source gives, and its share of the range.

    ``sizes`` has ``_source`` (null is a source of its own), ``_key`` and ``size``. A source takes the
    same level times its weight unless that is above its bound; the level is found by running sums
    over the sources in order of the level at which they are full, one row per source.
    """
    by_name = W.partitionBy().orderBy(F.col("_source").asc_nulls_last())
    weights = F.element_at(
        F.array(*(F.lit(w) for w in WEIGHTS)), F.pmod(F.row_number().over(by_name) - 1, len(WEIGHTS)) + 1
    )
    totals = (
        sizes.groupBy("_source", "_key")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", weights)
        .withColumn("_order", F.row_number().over(by_name))
        .withColumn("_full", F.col("source_size") * float(MOST_PASSES) / F.col("_weight"))
    )
    filling = W.partitionBy().orderBy("_full", "_order")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST_PASSES
    level = (F.sum("source_size").over(everything) * F.lit(BUDGET) - full) / F.sum("_weight").over(rest)
    totals = totals.withColumn("_level", level)
    found = F.min(F.when(F.col("_full") > F.col("_level"), F.struct("_full", "_level"))).over(everything)
    totals = totals.withColumn("_found", found["_level"])
    bound = F.col("source_size") * float(MOST_PASSES)
    target = F.coalesce(F.least(bound, F.col("_weight") * F.col("_found")), bound)
    totals = totals.withColumn("target", target)
    whole_words = F.floor("target").cast("bigint")
    ordered = W.partitionBy().orderBy("_order").rowsBetween(W.unboundedPreceding, 0)
    totals = totals.withColumn("_upto", F.sum(whole_words).over(ordered))
    total = F.sum(whole_words).over(everything)
    share = lambda words: F.floor(words.cast("double") / total.cast("double") * RANGE).cast("bigint")
    return totals.select(
        "_source",
        "_key",
        "source_size",
        "target",
        share(F.col("_upto") - whole_words).alias("_low"),
        share(F.col("_upto")).alias("_high"),
    )


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """``slot, _key, rank``: the source of every slot and how many of its slots came before.

    Slot i lies at i times the golden ratio, modulo one; the source whose interval holds the point has
    it. Points find their interval by the cell of the range that both are in.
    """
    spark = targets.sparkSession
    cell = RANGE // CELLS
    spans = targets.filter(F.col("_high") > F.col("_low")).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("_low") / cell), F.floor((F.col("_high") - 1) / cell)))
    )
    points = spark.range(slots).withColumnRenamed("id", "slot")
    points = points.withColumn("_point", F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(RANGE)))
    points = points.withColumn("cell", F.floor(F.col("_point") / cell))
    placed = points.join(spans, "cell").filter(
        (F.col("_point") >= F.col("_low")) & (F.col("_point") < F.col("_high"))
    )
    placed = placed.select("slot", "_key", F.lit(1).alias("_one")).withColumn(
        "_chunk", F.floor(F.col("slot") / CHUNK)
    )
    ranked = bucketed_running_sum(placed, ["_key"], "_chunk", [F.col("slot")], "_one", "rank")
    return ranked.select("slot", "_key", "rank")


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_words: int | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``taken`` and ``passes`` to every row of ``docs``.

    The documents of a source are shuffled by a hash of their id, laid end to end and cut into blocks
    of ``block_words`` words (derived from the total if not given). The r-th slot of a source takes
    its block r modulo its number of blocks; slots beyond two passes stay empty. ``taken`` is the
    number of words the mix takes of a document, repeats counted; ``passes`` how often it takes the
    block in which the document begins.

    A null source is a source of its own, after the others. A null or empty text has size 0 and gives
    nothing. Rows with equal ids are separate documents; equal rows may stand in either order.
    An empty table gives an empty result. Columns named like the added ones are replaced, others pass;
    names with an underscore are reserved.
    """
    docs = docs.drop("source_size", "target", "taken", "passes")
    texts, names = None, docs.columns
    if keep_text:
        # Texts wait in files, by row, and meet what the mix takes of them at the end.
        texts = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")
        docs = texts.select("_row", id_column, source, text)
    mixed = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    sized = docs.withColumns(
        {
            "size": words(text),
            "_source": F.col(source),
            "_key": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")),
            "_mixed": mixed,
        }
    )
    sized = stored(sized.drop(text).withColumn("_chunk", F.substring("_mixed", 1, 3)), "sizes")
    targets = stored(source_targets(sized.select("_source", "_key", "size")), "targets")
    total = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    block = block_words or int(min(LARGEST_BLOCK, max(1, total // FINE)))
    slots = schedule(targets.select("_key", "_low", "_high"), int(-(-total // block)))
    blocks = F.ceil(F.col("source_size") / block)
    takes = (
        slots.join(targets.select("_key", "source_size"), "_key")
        .filter(F.col("rank") < blocks * MOST_PASSES)
        .groupBy("_key", F.pmod("rank", blocks).alias("_block"))
        .agg(F.count(F.lit(1)).alias("_takes"))
    )
    order = [F.col("_mixed"), F.col(id_column), F.col("size")]
    laid = bucketed_running_sum(sized, ["_key"], "_chunk", order, "size", "_start")
    laid = stored(laid.drop("_mixed", "_chunk"), "laid")
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)
    pieces = (
        laid.filter("size > 0")
        .select("_key", "_start", "size", first.alias("_first"), F.explode(F.sequence(first, last)).alias("_block"))
        .join(takes, ["_key", "_block"])
    )
    begin = F.greatest(F.col("_start"), F.col("_block") * block)
    end = F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * block)
    taken = pieces.groupBy("_key", "_start").agg(
        F.sum((end - begin) * F.col("_takes")).alias("taken"),
        F.sum(F.when(F.col("_block") == F.col("_first"), F.col("_takes")).otherwise(0)).alias("passes"),
    )
    given = F.col("size") > 0
    result = laid.join(
        taken.withColumn("_given", F.lit(True)), ["_key", "_start"], "left"
    )
    result = result.withColumns(
        {
            "taken": F.when(given, F.coalesce("taken", F.lit(0))).otherwise(0).cast("bigint"),
            "passes": F.when(given, F.coalesce("passes", F.lit(0))).otherwise(0).cast("bigint"),
        }
    ).drop("_given")
    result = result.join(targets.select("_key", "source_size", "target"), "_key", "left")
    result = result.drop("_key", "_start", "_source")
    if texts is None:
        return result
    added = ["size", "taken", "passes", "source_size", "target"]
    whole_rows = texts.drop("size").join(result.select("_row", *added), "_row")
    return whole_rows.select(*(f"`{c}`" for c in names), *(c for c in added if c not in names))
