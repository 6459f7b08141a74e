"""Token ids in Parquet list columns: delta and dictionary encoding, small row groups, page indexes."""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rolefit.llm.common import whole

END_ID = 2
REMEMBERED = 600_000
LONGEST_REMEMBERED = 64
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
# Texts of up to so many characters are cut at once.
SLICE_CHARS = 1 << 21
# Kinds of characters. Texts with any white space but blanks and newlines go as a whole.
GAP, LETTER, MARK, OTHER_SPACE = range(4)
JOINED = re.compile(rb"[ \n](?s:.*)[^ \n]").fullmatch
_kinds: list[np.ndarray] = []


def kinds_of(text: str) -> np.ndarray:
    """The kind of every character: blank or newline, letter or digit, mark, other white space."""
    if not _kinds:
        chars = [chr(i) for i in range(0x110000)]
        kind = [LETTER if c.isalnum() else OTHER_SPACE if c.isspace() else MARK for c in chars]
        kind[ord(" ")] = kind[ord("\n")] = GAP
        _kinds.append(np.array(kind, np.uint8))
    if text.isascii():
        return np.frombuffer(text.encode().translate(_kinds[0][:256].tobytes()), np.uint8)
    return _kinds[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


class TextEncoder:
    """Whole texts through a byte-level tokenizer, each stretch of text only once while remembered.

    The tokenizer first cuts a text where white space follows another character and where anything
    else follows letters and digits, and merges within the cuts only. A stretch reaches from one such
    place to the next; its ids do not depend on its neighbours, so those seen before are known.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.library = Tokenizer.from_file(path)
        self.remembered = remembered
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # A byte-level vocabulary has one character for every byte.
        tokens = map(self.library.id_to_token, range(self.library.get_vocab_size()))
        self.lengths = np.array([len(t) for t in tokens])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def cut_apart(self, stretches: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """The ids of stretches that begin with white space and end otherwise, from one text of many.

        The tokenizer cuts before their white space; the byte lengths of the tokens tell where.
        """
        for start in range(0, len(stretches), 2000):
            part = stretches[start : start + 2000]
            ids = self.plain([b"".join(part).decode()])[0]
            ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
            stops = np.searchsorted(ends, np.cumsum([len(s) for s in part])) + 1
            cuts = [0, *(4 * stops).tolist()]
            yield from zip(part, (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True)

    def known(self, stretches: list[bytes]) -> list[bytes]:
        """The ids of distinct stretches."""
        found = [*map(self.young.get, stretches)]
        places = [i for i, ids in enumerate(found) if ids is None]
        missing = []
        for i in places:
            ids = self.old.get(stretches[i])
            if ids is None:
                missing.append(stretches[i])
            else:
                self.young[stretches[i]] = ids
        self.young.update(self.cut_apart([s for s in missing if JOINED(s)]))
        apart = [s for s in missing if not JOINED(s)]
        for start in range(0, len(apart), 2000):
            part = apart[start : start + 2000]
            self.young.update(zip(part, self.plain([s.decode() for s in part]), strict=True))
        for i in places:
            found[i] = self.young[stretches[i]]
        for stretch in missing:
            if len(stretch) > LONGEST_REMEMBERED:
                del self.young[stretch]
        if len(self.young) >= self.remembered:
            self.old, self.young = self.young, {}
        return found

    def encode_slice(self, texts: list[str]) -> list[bytes]:
        """Cuts all texts at once; each distinct stretch is looked up once and its ids dealt by Arrow."""
        joined = "".join(texts)
        kinds = kinds_of(joined)
        starts = np.cumsum([0, *map(len, texts)])
        if (kinds == OTHER_SPACE).any() or any(s in joined for s in self.special):
            odd = [
                (kinds[a:b] == OTHER_SPACE).any() or any(s in t for s in self.special)
                for t, a, b in zip(texts, starts, starts[1:], strict=False)
            ]
            # A special token may also stand where two texts meet.
            if any(odd):
                cut = iter(self.encode_slice([t for t, whole in zip(texts, odd, strict=True) if not whole]))
                return [self.plain([t])[0] if whole else next(cut) for t, whole in zip(texts, odd, strict=True)]
        if not joined:
            return [b""] * len(texts)
        # A stretch is white space with letters, or with marks and letters after them.
        gap, new = kinds == GAP, np.zeros(len(kinds) + 1, bool)
        new[1:-1] = (gap[1:] & ~gap[:-1]) | ((kinds[1:] == MARK) & (kinds[:-1] == LETTER))
        new[starts] = True
        at = np.flatnonzero(new)
        raw = joined.encode()
        places = at
        if len(raw) > len(joined):
            firsts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            places = np.append(firsts, len(raw))[at]
        held = pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw)
        coded = pa.LargeStringArray.from_buffers(len(at) - 1, *held).dictionary_encode()
        _, ends, held = coded.dictionary.buffers()
        ends, held = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1].tolist(), held.to_pybytes()
        stretches = [held[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        found = pa.array(self.known(stretches), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(at)]
        ids, cuts = found.buffers()[2].to_pybytes(), ends[np.searchsorted(at, starts)].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, part, size = [], [], 0
        for text in texts:
            if part and size + len(text) > SLICE_CHARS:
                ids += self.encode_slice(part)
                part, size = [], 0
            part.append(text)
            size += len(text)
        return ids + self.encode_slice(part) if part else ids


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def encode_tokens(docs: DataFrame, tokenizer: str, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Replace the text column by ``n_tokens`` and ``ids``, the token ids with ``end_id`` after them.

    Whole texts; a null text is empty. Rows keep their order, other columns pass; columns named
    ``ids`` or ``n_tokens`` are replaced.
    """
    kept = docs.drop("ids", "n_tokens").withColumn("_text", whole(text)).drop(text)
    schema = kept.drop("_text").schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for large in batches:
            for start in range(0, large.num_rows, 1000):
                batch = large.slice(start, 1000)
                found = own.encode(batch.column("_text").to_pylist())
                lengths = np.array([len(f) // 4 + 1 for f in found], np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = np.frombuffer(b"".join(f + end for f in found), "<u4").astype(np.int32)
                names = [n for n in batch.schema.names if n != "_text"]
                columns = [batch.column(n) for n in names]
                columns += [
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_tokens", "ids"])

    return kept.mapInArrow(encoded, schema)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_column: str = "doc_id",
    text: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode ``docs`` and write them in ascending id order below ``path``.

    ``path/part=N`` holds the N-th range of ids, sorted (null ids first). Ids of documents and counts
    are delta encoded, token ids dictionary encoded; ``row_group_bytes`` and ``page_bytes`` bound row
    groups and pages, and the files carry page indexes, so a reader of a few documents, or of the
    counts only, reads those pages and columns only. ``path-index`` gets the first token of every
    part, ``path-schema`` the columns, so that an empty table can be read too.
    An existing path is an error. Rows with equal ids are separate documents, side by side. Columns named
    ``ids``, ``n_tokens`` or ``part`` are replaced.
    """
    ranged = docs.repartitionByRange(id_column).sortWithinPartitions(id_column)
    encoded = encode_tokens(ranged, tokenizer, text).withColumn("part", F.spark_partition_id())
    settings = {
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.write-checksum.enabled": "true",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "compression": "zstd",
    }
    encoded.limit(0).write.parquet(f"{path}-schema")
    encoded.write.options(**settings).partitionBy("part").parquet(path)
    order = W.partitionBy().orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = read_tokens(docs.sparkSession, path).groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    parts = parts.withColumn("first_token", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    parts.coalesce(1).write.parquet(f"{path}-index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of ``path`` with their ``part``; select columns and filter by id to read less."""
    return spark.read.schema(spark.read.parquet(f"{path}-schema").schema).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``part, tokens, first_token`` of ``path``."""
    return spark.read.parquet(f"{path}-index")


def with_starts(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """``id, part, n_tokens, start``: where each document begins; reads no token ids."""
    inside = W.partitionBy("part").orderBy(id_column).rowsBetween(W.unboundedPreceding, -1)
    counts = read_tokens(spark, path).select(id_column, "part", "n_tokens")
    placed = counts.withColumn("_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    index = read_index(spark, path).select("part", "first_token")
    return placed.join(index, "part").select(
        id_column, "part", "n_tokens", (F.col("first_token") + F.col("_before")).alias("start")
    )


def token_digests(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, from the files."""
    read = read_tokens(spark, path).select(id_column, "part", "ids")
    schema = read.drop("ids").schema.add("n_tokens", "long").add("ids_crc32", "long")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            columns = [batch.column(id_column), batch.column("part")]
            columns += [pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = read.mapInArrow(summed, schema)
    inside = W.partitionBy("part").orderBy(id_column, "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    placed = found.withColumn("_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    index = read_index(spark, path).select("part", "first_token")
    return placed.join(index, "part").select(
        id_column, (F.col("first_token") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32", "part"
    )
