"""One query per operator of this package, over whole tables, and the pipeline."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.llm import oracles
from rolefit.llm.common import documents
from rolefit.session import scratch_path


# Keys the surrogates; a deployment sets its own secret.
SURROGATE_KEY = "rolefit"


def op1_replace_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolefit.llm.surrogates import replace_personal_data

    replaced = replace_personal_data(documents(spark, sf_dir), SURROGATE_KEY)
    return replaced.select("doc_id", F.size("entities").alias("n_entities"), "entities", "text")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rolefit.llm.tokenfiles import token_digests, write_tokens

    path = scratch_path(spark, "tokens")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, path)


def op3_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolefit.llm.suffixdedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolefit.llm.jaccardjoin import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op5_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolefit.llm.maxent import score_texts

    return score_texts(documents(spark, sf_dir))


def op6_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolefit.llm.spotsigs import spot_fingerprints

    found = spot_fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op7_encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rolefit.llm.piecebpe import digests, encode_pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    return digests(encode_pieces(documents(spark, sf_dir).select("doc_id", "text"), model))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolefit.llm.linededup import line_dedup

    return line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("clean_text", 256).alias("clean_sha256")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolefit.llm.quality import quality_rules

    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_common_words",
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolefit.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolefit.llm.merkle import altered_counts, manifest_proofs

    return manifest_proofs(documents(spark, sf_dir), altered_counts())


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rolefit.llm.alignment import align_tokens

    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = align_tokens(documents(spark, sf_dir).select("doc_id", "text"), *paths)
    return aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op13_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolefit.llm.sharding import shard_documents

    return shard_documents(documents(spark, sf_dir), 8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query in globals().items() if name.startswith("op")} | {
        "pipeline": pipeline
    }


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
