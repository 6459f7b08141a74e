"""Quality rules: lines that many documents of a host share, and documents that consist of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import SPACE_RUN, SPACES, ascii_lower, squeezed, stored, whole

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
# A line is common on a host from so many documents on, and above so many percent of them.
MIN_DOCUMENTS = 30
MAX_PERCENT = 5
# A document is depleted if less than this much of its words is left.
MIN_LEFT_PERCENT = 30
SYMBOLS = "#*$%&|<>"


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def normal_line(line: Column) -> Column:
    """Lower case (A-Z), one blank between words, digits as 0."""
    return F.translate(squeezed(ascii_lower(line)), "123456789", "0" * 9)


def line_key(line: Column) -> Column:
    return F.md5(normal_line(line))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Word, symbol, line and repetition counts of every text, computed inside its row.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, and
    ``_lines`` (the lines that have a word). Repeated five-word windows are found by hash: a text with
    as many distinct window hashes as windows has none, and only the others are sorted.
    """
    trimmed = F.btrim(whole(text), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_RUN)
    )
    frame = docs.withColumn("_words", words)
    frame = frame.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    frame = frame.withColumn("n_words", F.size("_words").cast("bigint")).drop("_words")
    no_windows = F.array().cast("array<bigint>")
    starts = F.sequence(F.lit(0), F.size("_hashes") - WINDOW)
    window = F.transform(
        starts, lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW)))
    )
    frame = frame.withColumn(
        "_windows", F.when(F.size("_hashes") > WINDOW, window).otherwise(no_windows)
    ).drop("_hashes")
    placed = F.array_sort(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    frame = frame.withColumn("_placed", F.when(again, placed)).drop("_windows")
    same = lambda a, b: F.coalesce(a["h"] == F.get("_placed", b)["h"], F.lit(False))
    repeated = F.filter("_placed", lambda p, j: same(p, j - 1) | same(p, j + 1))
    frame = frame.withColumn("_repeated", F.array_sort(F.transform(repeated, lambda p: p["i"])))
    frame = frame.drop("_placed")
    covered = F.aggregate(
        F.transform(
            "_repeated",
            lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_repeated", j + 1), i + WINDOW) - i),
        ),
        F.lit(0).cast("bigint"),
        lambda total, n: total + n,
    )
    frame = frame.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
    frame = frame.drop("_repeated")
    frame = frame.withColumn("_lines", F.filter(F.split(whole(text), "\n"), has_word))
    size = lambda c: F.length(c).cast("bigint")
    return frame.withColumns(
        {
            "word_chars": size(F.translate(whole(text), SPACES, "")),
            "n_symbols": size(whole(text)) - size(F.translate(whole(text), SYMBOLS, "")),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        }
    )


def common_lines(documents: DataFrame, min_documents: int, max_percent: int) -> DataFrame:
    """``(_host, line)`` of lines above the limits.

    ``documents`` has one row per distinct text of a host: ``_host`` and ``_keys``, its distinct line
    keys. So every row of a line is another document, and counts combine before they move.
    """
    hosts = documents.groupBy("_host").agg(F.count(F.lit(1)).alias("_documents"))
    counted = (
        documents.select("_host", F.explode("_keys").alias("line"))
        .groupBy("_host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_documents)
    )
    return (
        counted.join(hosts, "_host")
        .filter(F.col("n") * 100 > F.col("_documents") * max_percent)
        .select("_host", "line")
    )


ADDED = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words",
    "kept", "clean_text",
)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    max_percent: int = MAX_PERCENT,
    min_left_percent: int = MIN_LEFT_PERCENT,
    with_text: bool = False,
) -> DataFrame:
    """Judge every row of ``docs``; rows are returned as they came, with the verdict added.

    Added columns: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``n_common_words`` (words in lines above the limits) and ``kept``. With
    ``with_text`` also ``clean_text``, the text without those lines; else the text column is dropped.

    A line's documents are counted per host: texts that are equal count once, all others, near copies
    too, count each. Null hosts form one host. A null text is empty: no words, base_failed. Repeated rows, null ids and other columns are kept as they are; an empty
    table gives an empty result. Columns named like the added ones are replaced, names that begin with
    an underscore are reserved.
    """
    wide = (
        with_statistics(docs.drop(*ADDED), text)
        .withColumn("_host", F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")))
        .withColumn("_text_key", F.md5(whole(text)))
        .withColumn(
            "_found",
            F.transform(
                "_lines",
                lambda x: F.struct(
                    F.unhex(line_key(x)).alias("line"),
                    (F.size(F.split(F.btrim(x, F.lit(SPACES)), SPACE_RUN))).alias("words"),
                ),
            ),
        )
        .drop("_lines")
    )
    if not with_text:
        wide = wide.drop(text)
    wide = stored(wide, "quality")
    texts = (
        wide.select("_host", "_text_key", "_found")
        .groupBy("_host", "_text_key")
        .agg(F.any_value("_found").alias("_found"))
        .filter(F.size("_found") > 0)
        .withColumn("_keys", F.array_distinct(F.col("_found")["line"]))
    )
    common = common_lines(texts, min_documents, max_percent)
    removed = (
        texts.select("_host", "_text_key", F.explode("_found").alias("f"))
        .select("_host", "_text_key", F.col("f")["line"].alias("line"), F.col("f")["words"].alias("w"))
        .join(common, ["_host", "line"])
        .groupBy("_host", "_text_key")
        .agg(
            F.sum("w").alias("n_common_words"),
            F.collect_set(F.lower(F.hex("line"))).alias("_common"),
        )
    )
    judged = wide.drop("_found").join(removed, ["_host", "_text_key"], "left")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    left = F.col("n_words") - F.col("n_common_words")
    depleted = (left < MIN_WORDS) | (left * 100 < F.col("n_words") * min_left_percent)
    judged = judged.withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("bigint"))
    judged = judged.withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~failed & ~((F.col("n_common_words") > 0) & depleted))
    if with_text:
        kept_lines = F.filter(
            F.split(whole(text), "\n"), lambda x: ~F.array_contains("_common", line_key(x))
        )
        judged = judged.withColumn(
            "clean_text",
            F.when(F.col("_common").isNull(), F.col(text)).otherwise(F.array_join(kept_lines, "\n")),
        )
    return judged.drop("_host", "_text_key", "_common")
