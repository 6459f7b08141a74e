"""ZIP archives of any size: an index of their members, and members read one by one."""

import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.plans.layout import stored
from rolefit.sources.files import (
    BLOCK_BYTES,
    DOCUMENT_SUFFIX,
    MAX_MEMBER_BYTES,
    MEMBER_SCHEMA,
    RESOURCE_PREFIX,
)

INDEX_SCHEMA = (
    "archive string, entry string, member string, place long, packed_bytes long, bytes long, "
    "method int, crc long, error string"
)
# Packed bytes of members that one task reads.
TASK_BYTES = 64 << 20
BLOCK_ROWS = 1000
# Fixed values of the ZIP format: the local header in front of every member.
LOCAL_HEADER = "<4s5H3I2H"
LOCAL_SIGNATURE = b"PK\x03\x04"
STORED, DEFLATED, ENCRYPTED = 0, 8, 1


def open_range(path: str) -> BinaryIO:
    """A file of any store that can be read from any place, without reading the rest."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path) if parsed.scheme else path, "rb")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def _blocks(rows: Iterator[tuple], schema: str, held: Callable[[tuple], int]) -> Iterator[pd.DataFrame]:
    import pandas

    columns = [field.split()[0] for field in schema.split(", ")]
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += held(row)
        if len(block) >= BLOCK_ROWS or size >= BLOCK_BYTES:
            yield pandas.DataFrame(block, columns=columns, dtype=object)
            block, size = [], 0
    if block:
        yield pandas.DataFrame(block, columns=columns, dtype=object)


def index_archives(
    files: DataFrame, path: str = "path", opener: Callable[[str], BinaryIO] = open_range
) -> DataFrame:
    """One row per résumé in each ZIP archive of ``files(path)``, without its content.

    Only the directory at the end of an archive is read, so its size does not matter. Entries count as
    in ``expand_archives``; an archive that cannot be read is a row with ``error``.
    """
    suffix, resource_prefix = DOCUMENT_SUFFIX, RESOURCE_PREFIX

    def entries(archive: str) -> Iterator[tuple]:
        nothing = (None,) * 7
        try:
            with opener(archive) as held, zipfile.ZipFile(held) as opened:
                infos = opened.infolist()
        except Exception as problem:
            yield archive, *nothing, str(problem)
            return
        for info in infos:
            entry = info.filename
            member = entry.rsplit("/", 1)[-1]
            if entry.lower().endswith(suffix) and member and not entry.startswith(resource_prefix):
                error = "member is encrypted" if info.flag_bits & ENCRYPTED else None
                yield (
                    archive, entry, member, info.header_offset, info.compress_size, info.file_size,
                    info.compress_type, info.CRC, error,
                )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for archive in batch["path"] for row in entries(archive))
        return _blocks(rows, INDEX_SCHEMA, lambda row: 0)

    return files.select(F.col(path).alias("path")).mapInPandas(read, INDEX_SCHEMA)


def read_members(
    index: DataFrame,
    max_member_bytes: int = MAX_MEMBER_BYTES,
    opener: Callable[[str], BinaryIO] = open_range,
) -> DataFrame:
    """The members of an index with their content, as ``expand_archives`` gives them.

    Every row is read by its place, from whatever task it is in; rows of an archive that follow each
    other share an open file. A member above ``max_member_bytes`` or one that cannot be read becomes a
    row with ``error``.
    """

    def content(held: BinaryIO, row) -> bytes:
        held.seek(row.place)
        size = struct.calcsize(LOCAL_HEADER)
        fields = struct.unpack(LOCAL_HEADER, held.read(size))
        if fields[0] != LOCAL_SIGNATURE:
            raise ValueError("no member at its place in the index")
        held.seek(row.place + size + fields[9] + fields[10])
        packed = held.read(row.packed_bytes)
        if row.method == STORED:
            found = packed
        elif row.method == DEFLATED:
            found = zlib.decompressobj(-zlib.MAX_WBITS).decompress(packed, row.bytes + 1)
        else:
            raise ValueError(f"compression method {row.method} is not supported")
        if len(found) != row.bytes or zlib.crc32(found) != row.crc:
            raise ValueError("content does not match its checksum")
        return found

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        held, at = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                found, error = None, row.error
                if error is None and row.bytes > max_member_bytes:
                    error = "member is too large"
                if error is None:
                    try:
                        if at != row.archive:
                            if held is not None:
                                held.close()
                            held, at = None, None
                            held, at = opener(row.archive), row.archive
                        found = content(held, row)
                    except Exception as problem:
                        error = str(problem)
                yield row.archive, row.entry, row.member, found, error
        if held is not None:
            held.close()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Numbers may be missing in rows with an error.
        typed = (b.astype({c: "Int64" for c in ("place", "packed_bytes", "bytes", "method", "crc")}).astype(object) for b in batches)
        return _blocks(members(typed), MEMBER_SCHEMA, lambda row: len(row[3] or b""))

    return index.mapInPandas(read, MEMBER_SCHEMA)


def expand_stored_archives(
    files: DataFrame,
    path: str = "path",
    max_member_bytes: int = MAX_MEMBER_BYTES,
    task_bytes: int = TASK_BYTES,
    opener: Callable[[str], BinaryIO] = open_range,
) -> DataFrame:
    """The members of archives that lie in a store that every task can read.

    Like ``expand_archives``, but no archive is ever one cell or one task: its directory becomes rows,
    which are dealt to tasks so that each reads about ``task_bytes``, and a task reads its members only.
    """
    index = stored(index_archives(files, path, opener), "archive-index")
    total = index.agg(F.coalesce(F.sum("packed_bytes"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // task_bytes))
    if tasks > 1:
        # Neighbours in an archive stay together in runs of a task's sixteenth, and runs are dealt out.
        run = F.floor(F.col("place") / max(1, task_bytes // 16))
        index = index.repartition(int(tasks), "archive", run).sortWithinPartitions("archive", "place")
    return read_members(index, max_member_bytes, opener)
