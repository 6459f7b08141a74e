"""Inputs of the engine, derived by Spark from the test tables.

The test tables hold prose, not résumés. A candidate is a document whose text is mixed with the text of
the job it is sent to (not at all, or 1, 4 or 16 times), so that scores cover the whole range, and with
a name label, a statement of experience or an address in some. Whole texts and whole tables are used;
every 50th document has a second candidate whose file could not be read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.operators.lookups import candidate_profiles
from rolefit.operators.profiles import parse_profiles
from rolefit.operators.scoring import score_candidates
from rolefit.operators.similarity import semantic_similarity
from rolefit.plans.layout import spread_small_scan, stored
from rolefit.plans.screening import screen_resumes
from rolefit.session import scratch_path

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("job_id"),
        F.concat(F.lit("Job "), F.col("item_id").cast("string")).alias("title"),
        F.col("text").alias("description"),
        (start + F.make_dt_interval(days=(F.col("item_id") % 7).cast("int"))).alias("created_at"),
    )


def n_jobs(spark: SparkSession, sf_dir: str) -> int:
    """Number of jobs; their ids count from 0."""
    return table(spark, sf_dir, "benchmark").count()


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.explode(F.split(F.lower("text"), "[^a-z0-9]+"))
    return (
        table(spark, sf_dir, "benchmark")
        .select(tokens.alias("skill"))
        .filter(F.length("skill") >= 5)
        .distinct()
    )


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two words of each job's description, with their full stop."""
    last = F.regexp_extract(F.lower("text"), r"[^ \n]+ [^ \n]+$", 0)
    return table(spark, sf_dir, "benchmark").select(last.alias("skill")).distinct()


def filename() -> Column:
    return F.concat(
        "source", F.lit("_"), "lang", F.lit("-doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread_small_scan(
        table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id"
    )
    unreadable = F.when(F.col("doc_id") % 50 == 49, F.array(F.lit(False), F.lit(True)))
    keyed = documents.withColumn("job_id", F.col("doc_id") % n_jobs(spark, sf_dir)).withColumn(
        "unreadable", F.explode(unreadable.otherwise(F.array(F.lit(False))))
    )
    wanted = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("job_id"), F.col("text").alias("wanted")
    )
    doc_id = F.col("doc_id")
    times = (
        F.when(doc_id % 5 == 0, 1).when(doc_id % 5 == 1, 4).when(doc_id % 5 == 2, 16).otherwise(0)
    )
    id_text = doc_id.cast("string")
    text = F.concat(
        F.when(
            doc_id % 4 == 1, F.concat(F.lit("Full Name: "), "lang", F.lit(" "), "source", F.lit("\n"))
        ).otherwise(""),
        F.repeat(F.concat("wanted", F.lit(" ")), times),
        F.col("text"),
        F.when(
            doc_id % 6 == 0,
            F.concat(F.lit(" "), (doc_id % 9).cast("string"), F.lit(" years of experience")),
        ).otherwise(""),
        F.when(
            doc_id % 3 == 0, F.concat(F.lit(" user"), id_text, F.lit("@example.com"))
        ).otherwise(""),
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return keyed.join(wanted, "job_id").select(
        F.when(F.col("unreadable"), -1 - doc_id).otherwise(doc_id).alias("candidate_id"),
        "job_id",
        filename().alias("filename"),
        F.when(F.col("unreadable"), "").otherwise(text).alias("resume_text"),
        (start + F.make_dt_interval(mins=doc_id.cast("int"))).alias("created_at"),
    )


def plain_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are, for scores of every pair."""
    documents = spread_small_scan(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"
    )
    return documents.select(
        F.col("doc_id").alias("candidate_id"), F.col("text").alias("resume_text")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with two jobs, or one where both are the same."""
    doc_id, n = F.col("doc_id"), n_jobs(spark, sf_dir)
    both = F.array_distinct(F.array(doc_id % n, (doc_id * 7 + 3) % n))
    return table(spark, sf_dir, "documents").select(
        doc_id.alias("candidate_id"), F.explode(both).alias("job_id")
    )


def vectors(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The vector of each document or job that has one."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), "embedding")


def semantic(spark: SparkSession, sf_dir: str, applied: DataFrame) -> DataFrame:
    """Embedding cosine of ``applied(candidate_id, job_id)``; NULL where a vector is missing."""
    keys = applied.select("candidate_id", "job_id")
    known = keys.join(vectors(spark, sf_dir, "candidate_id"), "candidate_id", "left")
    return semantic_similarity(known, vectors(spark, sf_dir, "job_id"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts with a name, a statement of experience and skills of the default vocabulary."""
    key = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    stated = (
        F.when(key % 5 == 0, F.concat(size, F.lit(" years of experience")))
        .when(key % 5 == 1, F.concat(F.lit("Experience of "), size, F.lit(" years")))
        .when(key % 5 == 2, F.concat(size, F.lit("+ yrs experience")))
        .when(key % 5 == 3, F.concat(F.lit("fresher, "), size, F.lit(" years experience")))
        .otherwise(F.concat(size, F.lit(" years of professional experience")))
    )
    skills = (
        F.when(key % 4 == 0, "C++, Machine Learning; Git")
        .when(key % 4 == 1, "Scikit-Learn and CI/CD on Linux")
        .when(key % 4 == 2, "Node.js, HTML5, Django REST Framework")
        .otherwise("R&D lead, machine  learning, MySQL")
    )
    label = F.when(key % 3 == 0, "Full Name: ").when(key % 3 == 1, " name - ").otherwise("by ")
    return table(spark, sf_dir, "part").select(
        key.alias("doc_id"),
        F.concat(
            label, "p_name", F.lit("\n"), stated, F.lit("\n"), skills, F.lit("\n"), "p_brand",
            F.lit(" +91 "), (F.lit(9000000000) + key).cast("string"), F.lit("\n"),
        ).alias("text"),
        F.concat(
            F.translate("p_name", " ", "_"), F.lit("-"), F.translate("p_brand", "#", "."),
            F.lit(".v"), size, F.lit(".PDF"),
        ).alias("filename"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"
    )


def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(_upload_path().alias("path"))


def _upload_path() -> Column:
    doc_id = F.col("doc_id")
    suffix = (
        F.when(doc_id % 4 == 0, ".pdf")
        .when(doc_id % 4 == 1, ".PDF")
        .when(doc_id % 4 == 2, ".Zip")
        .otherwise(".docx")
    )
    return F.concat(F.lit("in/"), "lang", F.lit("/"), "source", F.lit("-"), doc_id.cast("string"), suffix)


def _archive_path() -> Column:
    return F.concat(F.lit("batch-"), F.floor(F.col("doc_id") / 10).cast("string"), F.lit(".zip"))


def _archive_entry() -> Column:
    doc_id = F.col("doc_id")
    id_text = doc_id.cast("string")
    return (
        F.when(doc_id % 5 == 3, F.concat(F.lit("__MACOSX/cv"), id_text, F.lit(".pdf")))
        .when(doc_id % 5 == 4, F.concat(F.lit("notes/"), id_text, F.lit(".txt")))
        .when(doc_id % 5 == 2, F.concat(F.lit("CV"), id_text, F.lit(".PDF")))
        .otherwise(F.concat(F.col("lang"), F.lit("/cv"), id_text, F.lit(".pdf")))
    )


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP files of up to ten documents each, with entries that do not count."""

    def pack(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            # Only one archive of a batch is held as Python objects.
            for row in range(batch.num_rows):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("folder/", "")
                    for member in batch.column("members")[row].as_py():
                        archive.writestr(member["entry"], member["text"])
                content = pa.array([held.getvalue()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(row, 1), content], ["path", "content"])

    return (
        table(spark, sf_dir, "documents")
        .select(
            _archive_path().alias("path"),
            F.struct(_archive_entry().alias("entry"), "text").alias("member"),
        )
        .groupBy("path")
        .agg(F.sort_array(F.collect_list("member")).alias("members"))
        .mapInArrow(pack, "path string, content binary")
    )


def stored_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives as files in the shared folder, by path."""
    root = scratch_path(spark, "archives")

    def write(batches):
        import os
        from urllib.parse import unquote, urlparse

        for batch in batches:
            for path, packed in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                content = packed.as_py()
                parsed = urlparse(path)
                if parsed.scheme in ("", "file"):
                    local = unquote(parsed.path) if parsed.scheme else path
                    os.makedirs(os.path.dirname(local), exist_ok=True)
                    with open(local, "wb") as held:
                        held.write(content)
                else:
                    from pyarrow import fs

                    store, inside = fs.FileSystem.from_uri(path)
                    with store.open_output_stream(inside) as held:
                        held.write(content)
            yield batch.select(["path"])

    named = archives(spark, sf_dir).withColumn("path", F.concat(F.lit(f"{root}/"), "path"))
    return stored(named.mapInArrow(write, "path string"), "archive-paths")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they came, each for a job: single documents, other files, and the archives."""
    n = n_jobs(spark, sf_dir)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    doc_id = F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint")
    paths = upload_names(spark, sf_dir).filter("NOT path LIKE '%.Zip'")
    paths = paths.unionByName(table(spark, sf_dir, "documents").select(_archive_path().alias("path")).distinct())
    return paths.select(
        "path",
        (doc_id % n).alias("job_id"),
        (start + F.make_dt_interval(mins=doc_id.cast("int"))).alias("created_at"),
    )


def upload_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts of the uploaded documents: two of a single one, one of an archive's member."""
    doc_id, half = F.col("doc_id"), F.floor(F.length("text") / 2).cast("int")
    documents = table(spark, sf_dir, "documents").filter(doc_id % 50 != 49)
    direct = documents.filter(doc_id % 4 < 2).select(
        _upload_path().alias("path"),
        F.lit(None).cast("string").alias("entry"),
        F.posexplode(F.array(F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text")))).alias("page_no", "text"),
    )
    inside = documents.select(
        _archive_path().alias("path"), _archive_entry().alias("entry"), F.lit(0).alias("page_no"), "text"
    )
    return direct.unionByName(inside)


def resume_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector that is not a job's; it is sent to the job at the head of its block of 25."""
    vec_id = F.col("vec_id")
    return (
        table(spark, sf_dir, "embeddings")
        .filter(vec_id % 25 != 0)
        .select(
            vec_id.alias("candidate_id"), (vec_id - vec_id % 25).alias("job_id"), "embedding"
        )
    )


def job_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    return (
        table(spark, sf_dir, "embeddings")
        .filter(vec_id % 25 == 0)
        .select(vec_id.alias("job_id"), "embedding")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_profiles(resumes(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_candidates(
        resumes(spark, sf_dir),
        jobs(spark, sf_dir),
        vocabulary(spark, sf_dir),
        scored_at=F.col("created_at"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_profiles(
        candidates(spark, sf_dir), jobs(spark, sf_dir), scores(spark, sf_dir)
    )


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``profiles``, from one pass over the résumés."""
    return screen_resumes(
        resumes(spark, sf_dir), jobs(spark, sf_dir), vocabulary(spark, sf_dir)
    )
