"""Line dedup: repeated runs of lines found by a suffix array over line ids, later copies deleted."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolefit.llm.common import (
    SPACE_RUN,
    SPACES,
    bucketed_running_sum,
    stored,
    whole,
)

# A repeated run counts from so many words on.
MIN_RUN_WORDS = 20
# Positions of a range partition, below its number: an order-preserving rank.
PARTITION_RANKS = 1 << 40
RANK_CHUNK = 4096


def lines_of(docs: DataFrame, doc: list[str], text: str) -> DataFrame:
    """``doc, pos, at, line, words``: the lines that have a word, numbered from 0; ``at`` counts all."""
    placed = F.transform(
        F.split(whole(text), "\n"),
        lambda x, i: F.struct(F.btrim(x, F.lit(SPACES)).alias("x"), i.alias("at")),
    )
    kept = F.filter(placed, lambda p: p["x"] != "")
    return docs.select(*doc, F.posexplode(kept).alias("pos", "_line")).select(
        *doc,
        "pos",
        F.col("_line")["at"].alias("at"),
        F.xxhash64(F.col("_line")["x"]).alias("line"),
        F.size(F.split(F.col("_line")["x"], SPACE_RUN)).alias("words"),
    )


def repeated_segments(lines: DataFrame, doc: list[str]) -> DataFrame:
    """Lines that occur more than once, with ``segment``: the number of the stretch they stand in.

    A line that occurs once ends every repeated run, so only these stretches need suffixes.
    """
    often = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("line")
    repeated = lines.join(often, "line", "left_semi")
    in_doc = W.partitionBy(*doc).orderBy("pos")
    return repeated.withColumn("segment", F.col("pos") - F.row_number().over(in_doc))


def ordered_ranks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of ``keys`` with ``rank``, which keeps their order; no key is placed twice."""
    ranged = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranged = ranged.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    inside = W.partitionBy("_part").orderBy(*keys)
    return ranged.select(
        *keys, "_n", (F.col("_part") * F.lit(PARTITION_RANKS) + F.row_number().over(inside)).alias("rank")
    )


def suffix_ranks(segments: DataFrame, doc: list[str]) -> DataFrame:
    """``doc, pos, rank``: suffixes of segments in order of their line ids, by prefix doubling.

    The rank by the first 2k lines is the rank of the pair (rank by k lines here, rank by k lines k
    lines on). Only distinct pairs are sorted; equal suffixes keep equal ranks.
    """
    # A suffix that ends sorts before those that go on; -2^63 cannot be told from a hash, so ids are halved.
    ranks = stored(
        segments.select(*doc, "segment", "pos", F.shiftright("line", 1).alias("rank")), "ranks"
    )
    longest = (
        segments.groupBy(*doc, "segment").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    )
    step = 1
    while longest and step < longest:
        in_segment = W.partitionBy(*doc, "segment").orderBy("pos")
        paired = ranks.withColumn(
            "next", F.coalesce(F.lead("rank", step).over(in_segment), F.lit(-(1 << 63)))
        )
        paired = stored(paired.withColumnRenamed("rank", "here"), "pairs")
        named = ordered_ranks(paired, ["here", "next"]).drop("_n")
        ranks = stored(paired.join(named, ["here", "next"]).drop("here", "next"), "ranks")
        step *= 2
    return ranks


def least_runs(segments: DataFrame, doc: list[str], min_words: int) -> DataFrame:
    """Adds ``ahead`` and ``places``: line ids and places of the shortest run from here with ``min_words``.

    Null if the segment ends before. Every line has a word, so a run has ``min_words`` lines at most.
    """
    on = W.partitionBy(*doc, "segment").orderBy("pos").rowsBetween(0, min_words - 1)
    gathered = segments.withColumn("_next", F.collect_list(F.struct("line", "words", "pos", "at")).over(on))
    sums = F.aggregate(
        "_next",
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")),
        lambda a, x: F.when(a["words"] >= min_words, a).otherwise(
            F.struct((a["words"] + x["words"]).alias("words"), (a["lines"] + 1).alias("lines"))
        ),
    )
    gathered = gathered.withColumn("_sums", sums).filter(F.col("_sums")["words"] >= min_words)
    run = F.slice("_next", 1, F.col("_sums")["lines"])
    return gathered.select(
        *doc,
        "segment",
        "pos",
        F.transform(run, lambda x: x["line"]).alias("ahead"),
        F.transform(run, lambda x: F.struct(x["pos"], x["at"])).alias("places"),
    )


def repeated_intervals(ranks: DataFrame, runs: DataFrame, doc: list[str]) -> DataFrame:
    """``doc, pos, places, interval``: suffixes whose least run is shared, by interval of the suffix array.

    Neighbours in the array share their least run if their common prefix covers it; where one does
    not, a new interval begins. Distinct suffixes are numbered densely, so that a suffix meets its
    neighbour by equality, and the beginnings are counted by chunks of the array.
    """
    placed = stored(ranks.join(runs, [*doc, "segment", "pos"]), "runs")
    distinct = placed.groupBy("rank").agg(F.any_value("ahead").alias("ahead"))
    ranged = distinct.withColumn("_one", F.lit(1)).repartitionByRange("rank")
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "suffixes")
    dense = bucketed_running_sum(ranged, [], "_part", [F.col("rank")], "_one", "number")
    dense = stored(dense.select("rank", "ahead", "number"), "dense")
    before = dense.select((F.col("number") + 1).alias("number"), F.col("ahead").alias("before"))
    # The common prefix of neighbours covers the least run if it covers its every line.
    shared = F.coalesce(
        F.slice("before", 1, F.size("ahead")) == F.col("ahead"), F.lit(False)
    )
    begun = dense.join(before, "number", "left").select(
        "rank", "number", F.floor(F.col("number") / RANK_CHUNK).alias("_chunk"),
        F.when(shared, 0).otherwise(1).alias("_begins"),
    )
    counted = bucketed_running_sum(begun, [], "_chunk", [F.col("number")], "_begins", "_before")
    intervals = counted.select("rank", (F.col("_before") + F.col("_begins")).alias("interval"))
    return placed.select(*doc, "pos", "places", "rank").join(intervals, "rank").drop("rank")


def deleted_lines(intervals: DataFrame, doc: list[str]) -> DataFrame:
    """``doc, deleted``: positions covered by a run that began earlier, in an earlier text or above."""
    first = intervals.groupBy("interval").agg(
        F.min(F.struct(*doc, "pos")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    later = intervals.join(first.filter("n > 1"), "interval").filter(
        F.struct(*doc, "pos") > F.col("first")
    )
    places = later.select(*doc, F.explode("places").alias("p")).distinct()
    return places.groupBy(*doc).agg(F.array_sort(F.collect_list("p")).alias("deleted"))


def line_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_RUN_WORDS,
) -> DataFrame:
    """Delete later copies of repeated line runs; every row of ``docs`` is returned.

    Adds ``clean_text``, ``n_lines`` (lines with a word), ``n_deleted`` and ``n_runs`` (stretches of
    deleted lines). Lines are compared without white space at their ends; lines without a word are
    not counted, interrupt no run and stay. A run is repeated if its lines, with ``min_words`` words
    or more, stand in the same order elsewhere; the copy in the least (id, position) stays, and a
    later one goes, within a document too.

    A null text is empty and stays null. Rows with equal id and text are one document and all get
    its result; rows with a null id come first. Clashing column names: ``clean_text``, ``n_lines``,
    ``n_deleted``, ``n_runs`` are replaced, names with an underscore are reserved.
    """
    docs = docs.withColumns(
        {
            "_text": F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("")), whole(text)),
            "_order": F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(1 << 63))),
        }
    )
    doc = ["_order", "_text"]
    lines = stored(lines_of(docs, doc, text).dropDuplicates([*doc, "pos"]), "lines")
    segments = stored(repeated_segments(lines, doc), "segments")
    ranks = suffix_ranks(segments, doc)
    runs = least_runs(segments, doc, min_words)
    deleted = deleted_lines(repeated_intervals(ranks, runs, doc), doc)
    sizes = lines.groupBy(*doc).agg(F.count(F.lit(1)).alias("n_lines"))
    marked = stored(sizes.join(deleted.withColumnRenamed("deleted", "_deleted"), doc, "left"), "deleted")
    joined = docs.drop("clean_text", "n_lines", "n_deleted", "n_runs").join(marked, doc, "left")
    return _without_lines(joined, text).drop(*doc)


def _without_lines(joined: DataFrame, text: str) -> DataFrame:
    """Rebuild the texts that lose lines from the lines that stay."""
    changed = F.col("_deleted").isNotNull()
    joined = joined.withColumn("_parts", F.when(changed, F.split(text, "\n")))
    stay = F.array_except(
        F.sequence(F.lit(0), F.size("_parts") - 1), F.transform("_deleted", lambda p: p["at"])
    )
    kept = F.transform(stay, lambda i: F.get("_parts", i))
    starts = F.filter(
        "_deleted",
        lambda p, i: F.coalesce(F.get("_deleted", i - 1)["pos"] != p["pos"] - 1, F.lit(True)),
    )
    return joined.withColumns(
        {
            "clean_text": F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text)),
            "n_lines": F.coalesce("n_lines", F.lit(0)).cast("bigint"),
            "n_deleted": F.when(changed, F.size("_deleted")).otherwise(0).cast("bigint"),
            "n_runs": F.when(changed, F.size(starts)).otherwise(0).cast("bigint"),
        }
    ).drop("_deleted", "_parts")
