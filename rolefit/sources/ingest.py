"""From uploaded files to résumés: direct documents and archive members, each taken in once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.plans.joins import fits_broadcast, sized_join
from rolefit.plans.layout import stored
from rolefit.schemas import RESUMES
from rolefit.sources.files import assemble_text, classify_files, file_id

TAKEN = "resumes"


def uploaded_documents(uploads: DataFrame, members: DataFrame) -> DataFrame:
    """``candidate_id, path, entry, job_id, filename, created_at`` of every document of the uploads.

    ``uploads(path, job_id, created_at)`` are the files as they came; ``members(archive, entry, member)``
    what their archives hold (an index or expanded rows; those with ``error`` are left out). Ids are
    hashes of path and entry. A file that is uploaded again keeps its first time, then its least job.
    """
    files = classify_files(uploads.select("path", "job_id", "created_at"))
    direct = files.filter("kind = 'document'").select(
        "path", F.lit("").alias("entry"), "job_id", F.col("name").alias("filename"), "created_at"
    )
    if "error" in members.columns:
        members = members.filter("error IS NULL")
    inside = members.select(F.col("archive").alias("path"), "entry", F.col("member").alias("filename"))
    archived = sized_join(inside, files.filter("kind = 'archive'").select("path", "job_id", "created_at"), ["path"])
    documents = direct.unionByName(archived).withColumn("candidate_id", file_id(F.col("path"), F.col("entry")))
    first = F.min(F.struct("created_at", "job_id", "filename")).alias("_first")
    return documents.groupBy("candidate_id", "path", "entry").agg(first).select(
        "candidate_id", "path", "entry", "_first.job_id", "_first.filename", "_first.created_at"
    )


def ingest_resumes(
    uploads: DataFrame, members: DataFrame, pages: DataFrame, taken: DataFrame | None = None
) -> DataFrame:
    """Résumés of the uploads that are not in ``taken(candidate_id)`` yet.

    ``pages(path, entry, page_no, text)`` are the texts of the documents' pages, ``entry`` empty or null
    for direct ones. A document without pages has an empty text. Ids meet first; only pages of
    documents that are new are put together. The new documents, without their texts, are written to the
    shared folder: uploads and members are read once.
    """
    documents = uploaded_documents(uploads, members)
    if taken is not None:
        documents = documents.join(taken.select("candidate_id").distinct(), "candidate_id", "left_anti")
    documents = stored(documents, "new-documents")
    place = file_id(F.col("path"), F.coalesce("entry", F.lit("")))
    keyed = pages.select(place.alias("candidate_id"), "page_no", "text")
    new = documents.select("candidate_id")
    wanted = keyed.join(F.broadcast(new) if fits_broadcast(new) else new, "candidate_id", "left_semi")
    texts = assemble_text(wanted, key="candidate_id")
    found = documents.join(texts, "candidate_id", "left")
    found = found.withColumn("resume_text", F.coalesce("text", F.lit("")))
    return found.select(*(F.col(f.name).cast(f.dataType) for f in RESUMES))


def taken_in(spark: SparkSession, root: str) -> DataFrame:
    """All résumés that have been taken in below ``root``."""
    return spark.read.schema(RESUMES).parquet(f"{root.rstrip('/')}/{TAKEN}")


def take_in(spark: SparkSession, uploads: DataFrame, members: DataFrame, pages: DataFrame, root: str) -> DataFrame:
    """Append the résumés of the uploads to those below ``root`` and return all.

    The stored rows are the ledger: an id that is there is not taken in again, so repeating an ingestion,
    or one that failed before its rows were committed, adds what is missing and nothing else. One
    ingestion into a root at a time.
    """
    path = f"{root.rstrip('/')}/{TAKEN}"
    # Makes the folder where there is none.
    spark.createDataFrame([], RESUMES).write.mode("append").parquet(path)
    ingest_resumes(uploads, members, pages, taken_in(spark, root)).write.mode("append").parquet(path)
    return taken_in(spark, root)
