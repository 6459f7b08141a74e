"""Uploaded files: classification, archive members, page texts."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File kinds, and archive entries that are not résumés.
ARCHIVE_SUFFIX = ".zip"
DOCUMENT_SUFFIX = ".pdf"
RESOURCE_PREFIX = "__MACOSX"

# A binary cell cannot hold more.
MAX_MEMBER_BYTES = 2**31 - 1

# Contents handed on at once by a task that reads archives.
BLOCK_BYTES = 8 * 1024 * 1024

MEMBER_SCHEMA = "archive string, entry string, member string, content binary, error string"


def basename(path: Column) -> Column:
    """The part of a path behind its last slash."""
    return F.substring_index(path, "/", -1)


def classify_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``name`` and ``kind`` (archive or document); other files are left out.

    Reads nothing but the path: with a ``binaryFile`` source the contents are not loaded.
    """
    lowered = F.lower(F.col(path))
    kind = F.when(F.endswith(lowered, F.lit(ARCHIVE_SUFFIX)), F.lit("archive")).when(
        F.endswith(lowered, F.lit(DOCUMENT_SUFFIX)), F.lit("document")
    )
    return files.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn(
        "name", basename(F.col(path))
    )


def expand_archives(
    files: DataFrame, path: str = "path", max_member_bytes: int = MAX_MEMBER_BYTES
) -> DataFrame:
    """One row per résumé in each ZIP archive of ``files(path, content)``.

    Entries count when they end in .pdf (any case) and are not operating-system resources; equal
    names in different folders are all kept. What cannot be read (a broken archive or entry, an entry
    above ``max_member_bytes``) becomes a row with ``error`` set. A task opens one archive at a time and
    hands its members on in blocks.
    """
    suffix, resource_prefix, block_bytes = DOCUMENT_SUFFIX, RESOURCE_PREFIX, BLOCK_BYTES
    columns = [field.split()[0] for field in MEMBER_SCHEMA.split(", ")]

    def members(archive: str, content: bytes):
        import io
        import zipfile

        try:
            opened = zipfile.ZipFile(io.BytesIO(content))
        except Exception as problem:
            yield archive, None, None, None, str(problem)
            return
        with opened:
            for info in opened.infolist():
                entry = info.filename
                member = entry.rsplit("/", 1)[-1]
                wanted = entry.lower().endswith(suffix) and member != ""
                if not wanted or entry.startswith(resource_prefix):
                    continue
                if info.file_size > max_member_bytes:
                    yield archive, entry, member, None, "member is too large"
                    continue
                try:
                    yield archive, entry, member, opened.read(info), None
                except Exception as problem:
                    yield archive, entry, member, None, str(problem)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas

        block, held = [], 0
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                for row in members(archive, content):
                    block.append(row)
                    held += len(row[3] or b"")
                    if held >= block_bytes or len(block) >= 1000:
                        yield pandas.DataFrame(block, columns=columns, dtype=object)
                        block, held = [], 0
        if block:
            yield pandas.DataFrame(block, columns=columns, dtype=object)

    return files.select(F.col(path).alias("path"), "content").mapInPandas(read, MEMBER_SCHEMA)


def file_id(*parts: Column) -> Column:
    """An id for an ingested file that stays the same when a job is rerun."""
    return F.xxhash64(*parts)


def assemble_text(
    pages: DataFrame, texts_of: DataFrame | None = None, key: str = "doc_id"
) -> DataFrame:
    """Text of each document from its page rows ``(key, page_no, text)``.

    Pages are joined in order and each that has text is followed by a line break. A document whose
    pages are all empty gets an empty text; ``texts_of(key)`` adds documents without any page.
    The pages of one document meet in one task, which its text, a single cell, requires anyway.
    """
    with_text = F.when(
        F.coalesce(F.col("text"), F.lit("")) != "", F.struct("page_no", "text")
    )
    assembled = pages.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(with_text)),
                lambda page: F.concat(page["text"], F.lit("\n")),
            ),
            "",
        ).alias("text")
    )
    if texts_of is None:
        return assembled
    return texts_of.select(key).join(assembled, key, "left").select(
        key, F.coalesce("text", F.lit("")).alias("text")
    )
