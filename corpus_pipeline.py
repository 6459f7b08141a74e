"""A corpus pipeline: quality rules, line dedup, near duplicates, mixing, subword ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet
and reads it again as the next stage's documents. All but the last return the columns of documents.
Null texts are empty and fail the quality rules; empty tables pass through; repeated rows are kept by
every stage but those that delete copies; columns beyond those of ``documents`` pass the first four.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolefit.llm.common import documents, stored
from rolefit.llm.jaccardjoin import jaccard_components
from rolefit.llm.linededup import line_dedup
from rolefit.llm.mixing import mix_sources, words
from rolefit.llm.piecebpe import digests, encode_pieces
from rolefit.llm.quality import quality_rules

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _with_text(changed: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``clean_text`` as text and its length."""
    changed = changed.withColumn("text", F.col("clean_text"))
    if "n_chars" in like.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return changed.select(like.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that most documents of their source share."""
    return _with_text(quality_rules(docs, with_text=True).filter("kept"), docs)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one that loses its every line goes."""
    left = line_dedup(docs).filter("n_deleted = 0 OR n_deleted < n_lines")
    return _with_text(left, docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies; those without an id stay."""
    found = jaccard_components(docs)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes the block in which it begins: not, once or twice.

    The mix is made without texts; texts meet it by id, source and size. Rows that agree in these stand
    in any order in the mix, so they are numbered here by a hash of the row.
    """
    place = ["_words", "_id", "_from"]
    named = {
        "_id": F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("")),
        "_from": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")),
    }
    slim = mix_sources(docs.select("doc_id", "source", "text")).filter("passes > 0")
    slim = slim.withColumns(named | {"_words": F.col("size")})
    slim = slim.groupBy(*place).agg(F.sort_array(F.collect_list("passes")).alias("_all"))
    met = docs.withColumns(named | {"_words": words("text")}).join(slim, place)
    # The window finds the rows where the join has put them, so texts are shuffled once.
    number = F.row_number().over(W.partitionBy(*place).orderBy(F.xxhash64(*docs.columns)))
    met = met.withColumn("_number", number).withColumn("_passes", F.get("_all", F.col("_number") - 1))
    repeated = met.filter("_passes > 0").withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("bigint"), "_passes")))
    return repeated.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of each document, with digests of the ids and of the decoded text."""
    encoded = encode_pieces(docs.select("doc_id", "source", "text"), PIECES)
    return digests(encoded.withColumn("piece_ids", F.col("ids")))


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", delete_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_to_targets),
    ("SentencePiece encoding and decoding", encode),
]

# Subword encoding has no counterpart in SQL. Tests compare the last stage with the library, and each of
# the others in the test of its operator; run() as a whole has no brute-force version yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
