"""Removing repeated strings: shards of a suffix array that hold every place where a string may repeat."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import stored, whole
from rolefit.llm.shingles import mixed
from rolefit.llm.suffixes import BASE, Sums, common_prefixes, suffix_array

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM + 1
SLICE_BYTES = 1 << 20
SHARD_BYTES = 2 << 20
# Anchors with more different stretches than this are compared window by window.
HOT_STRETCHES = 4096
PLACE = np.uint64((1 << 24) - 1)


class _Powers:
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                powers = np.full(n + SLICE_BYTES, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def anchors(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``owner, start, stop, anchor, stretch`` of all windows of LENGTH bytes of some texts, by anchor.

    A window's anchor is the gram in it with the least hash, the leftmost of equals, so equal windows
    have equal anchors. Windows ``start`` to ``stop`` of a text share one; ``stretch`` hashes the
    bytes they cover. ``ends`` are the ends of the texts in ``raw``.
    """
    n = len(raw)
    if n < LENGTH:
        return
    up, down = _Powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    owner = np.searchsorted(ends, np.arange(n - LENGTH + 1), side="right")
    starts = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= ends[owner])
    if not len(starts):
        return
    least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32, 64):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: n - LENGTH + 1], least[REACH - 128 : REACH - 128 + n - LENGTH + 1])
    at = (least[starts] & PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    begin, stop = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    size = stop - begin + LENGTH
    stretch = mixed((sums[begin + size] - sums[begin]) * down[begin] + size.astype(np.uint64))
    of = owner[begin]
    origin = np.concatenate(([0], ends[:-1]))[of]
    yield of, begin - origin, stop - origin, grams[at[first]], stretch


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a batch: the first row's number, and the bytes of its texts."""
    part, size, first = [], 0, 0
    for k, value in enumerate(batch.column("text")):
        coded = value.as_py().encode()
        if part and size + len(coded) > SLICE_BYTES:
            yield first, part
            part, size, first = [], 0, k
        part.append(coded)
        size += len(coded)
    if part:
        yield first, part


def all_anchors(rows: DataFrame) -> DataFrame:
    """``row, start, stop, anchor, stretch`` of all texts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for first, part in _texts(batch):
                pieces = [(first, 0, b"".join(part), np.cumsum([len(p) for p in part]))]
                if len(part) == 1 and len(part[0]) > 8 * SLICE_BYTES:
                    step = 8 * SLICE_BYTES
                    pieces = [
                        (first, a, part[0][a : a + step + LENGTH - 1], None) for a in range(0, len(part[0]), step)
                    ]
                for row, shift, raw, ends in pieces:
                    ends = np.array([len(raw)]) if ends is None else ends
                    for of, start, stop, anchor, stretch in anchors(np.frombuffer(raw, np.uint8), ends):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[row + of]),
                                pa.array(start + shift),
                                pa.array(stop + shift),
                                pa.array(anchor.view(np.int64)),
                                pa.array(stretch.view(np.int64)),
                            ],
                            names=["row", "start", "stop", "anchor", "stretch"],
                        )

    return rows.mapInArrow(found, "row long, start long, stop long, anchor long, stretch long")


def repeated_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """Of each stretch of bytes, the starts of windows that occur at another place in any of them.

    The stretches form one text with an end mark after each; neighbours in its suffix array with a
    common prefix of LENGTH bytes, within their stretches, are repeats.
    """
    sizes = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"\x00".join([*pieces, b""]), np.uint8).astype(np.int16) + 2
    begins = np.cumsum(sizes + 1) - sizes - 1
    raw[begins + sizes] = 1
    raw = np.append(raw[: int(sizes.sum()) + len(sizes)], np.int16(0))
    left = np.append(np.repeat(begins + sizes, sizes + 1), len(raw) - 1) - np.arange(len(raw))
    array = suffix_array(raw, 258)
    before, common = common_prefixes(raw, array, left)
    again = np.zeros(len(raw), bool)
    repeats = common >= LENGTH
    again[repeats] = True
    again[before[repeats]] = True
    return [np.flatnonzero(again[b : b + s]) for b, s in zip(begins, sizes, strict=True)]


def _runs(row: int, start: int, windows: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(windows):
        for run in np.split(windows, np.flatnonzero(np.diff(windows) > 1) + 1):
            yield row, start + int(run[0]), start + int(run[-1])


SPANS = "row long, start long, stop long"


def _spans(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "start", "stop"])


def shard_repeats(stretches: DataFrame) -> DataFrame:
    """Repeated windows, as ``row, start, stop``, of stretches that share an anchor, shard by shard."""

    def sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def solved() -> pa.RecordBatch:
            found = repeated_windows([s[2] for s in shard])
            return _spans([x for s, w in zip(shard, found, strict=True) for x in _runs(s[0], s[1], w)])

        for batch in batches:
            for anchor, row, start, raw in zip(
                *(batch.column(c).to_pylist() for c in ("anchor", "row", "start", "bytes")), strict=True
            ):
                if anchor != last and size > SHARD_BYTES:
                    yield solved()
                    shard, size = [], 0
                shard.append((row, start, raw))
                size += len(raw) + 1
                last = anchor
        if shard:
            yield solved()

    return stretches.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sorted_shards, SPANS)


def window_repeats(stretches: DataFrame) -> DataFrame:
    """The same for anchors with many stretches: windows are counted by hash, in any number of tasks."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, start, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "start", "bytes")), strict=True):
                at = np.arange(len(raw) - LENGTH + 1)
                hashes = mixed(Sums(np.frombuffer(raw, np.uint8)).hashes(at, LENGTH))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), row)), pa.array(at + start)],
                    names=["window", "row", "start"],
                )

    windows = stored(stretches.mapInArrow(hashed, "window long, row long, start long"), "windows")
    often = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    return windows.join(often, "window").select("row", "start", F.col("start").alias("stop"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """Remove every byte that a string of LENGTH bytes covers which also starts at another place.

    Returns ``id_column, n_bytes, n_removed, n_spans, kept_sha256``, and with ``with_bytes`` the bytes
    left as ``kept``. Texts are read as UTF-8 and judged as they came; matches may overlap and may lie
    in one text, but never reach over its end.

    All places of a string have the same anchor, so a shard of anchors finds all repeats. A stretch
    that occurs more than once is repeated as a whole; only stretches that occur once, and one copy
    of the others with their anchor, are sorted. Strings are told apart by 64-bit hashes.

    A null text is empty; texts shorter than LENGTH lose nothing. Equal rows are each other's repeats.
    Null ids pass, an empty table gives an empty result, other columns are not looked at.
    """
    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.col("id").cast("string"), "text"))
    light = rows.select("row", "text")
    found = stored(all_anchors(light), "anchors")
    stretches = found.groupBy("anchor", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "stop")).alias("one")
    )
    stretches = stored(stretches, "stretches")
    kinds = stretches.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("places"))
    kinds = stored(kinds.filter("places > 1"), "kinds")
    again = stretches.filter("n > 1").select("anchor", "stretch")
    wholly = found.join(again, ["anchor", "stretch"]).select("row", "start", "stop")
    checked = stretches.join(kinds.filter("kinds > 1"), "anchor").select("anchor", "kinds", "one.*")
    by_row = checked.groupBy("row").agg(F.collect_list(F.struct("anchor", "kinds", "start", "stop")).alias("parts"))
    fetched = light.join(by_row, "row").select("row", F.encode("text", "UTF-8").alias("raw"), F.explode("parts").alias("p"))
    fetched = fetched.select(
        "p.anchor", "p.kinds", "row", "p.start",
        F.substring("raw", (F.col("p.start") + 1).cast("int"), (F.col("p.stop") - F.col("p.start") + LENGTH).cast("int")).alias("bytes"),
    )
    fetched = stored(fetched, "fetched")
    spans = wholly.union(shard_repeats(fetched.filter(F.col("kinds") <= HOT_STRETCHES).drop("kinds")))
    spans = spans.union(window_repeats(fetched.filter(F.col("kinds") > HOT_STRETCHES)))
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    both = rows.join(spans, "row", "left").select("id", "text", "spans.start", "spans.stop")
    kind = {"bigint": "long"}.get(docs.schema[id_column].dataType.simpleString(), docs.schema[id_column].dataType.simpleString())
    schema = f"{id_column} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for at in range(0, large.num_rows, 500):
                batch = large.slice(at, 500)
                out = ([], [], [], [], [])
                for value, start, stop in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    raw = value.encode()
                    runs, kept = 0, raw
                    if start:
                        edges = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(edges, np.array(start), 1)
                        np.add.at(edges, np.array(stop) + LENGTH, -1)
                        gone = np.cumsum(edges[:-1]) > 0
                        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    for o, x in zip(
                        out, (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None), strict=True
                    ):
                        o.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))],
                    names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    result = both.mapInArrow(removed, schema)
    return result if with_bytes else result.drop("kept")
