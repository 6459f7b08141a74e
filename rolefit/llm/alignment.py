"""Alignment of two tokenizers' tokens over the same texts."""

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from rolefit.llm.common import stored, whole
from rolefit.llm.tokenfiles import TextEncoder
from rolefit.plans.joins import salted_join

# UTF-8 bytes of texts whose windows are numbered together.
CHUNK_BYTES = 4 << 20
# Windows, and stretches of text, that a worker remembers; tokens spelled at once.
REMEMBERED = 150_000
REMEMBERED_STRETCHES = 100_000
SPELLED = 1 << 18
# Rows encoded at once: what they share is met once.
SLICE_ROWS = 400
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
SCORES = ("n_best", "count_sum")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Aligns texts with memoised windows; windows are cut where both tokenizers start a new word.

    A window is the token ids of both between two anchors: ends that both share, verified by byte
    offsets, before tokens that both begin with a blank. Its groups and links follow from its ids alone.
    """

    def __init__(self, tokenizer: str, model: str):
        self.a = TextEncoder(tokenizer, REMEMBERED_STRETCHES)
        self.a.library.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=model)
        alphabet = _byte_alphabet()
        size = self.a.library.get_vocab_size()
        special = self.a.library.get_added_tokens_decoder()
        self.bytes_a = [
            special[i].content.encode() if i in special else bytes(map(alphabet.__getitem__, self.a.library.id_to_token(i)))
            for i in range(size)
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in b]) for b in (self.bytes_a, self.bytes_b))
        size = max(len(self.bytes_a), len(self.bytes_b))
        self.decimals = np.array([[f"{i}{sign}" for i in range(size)] for sign in (",", "|", ";", "")], object)
        self.spaced_a, self.spaced_b = (np.array([t[:1] == b" " for t in b]) for b in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(b), np.uint8) for b in (self.bytes_a, self.bytes_b))
        # Odd numbers have an inverse modulo 2 ** 64.
        self.bases = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
        self.powers: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.groups: list[str] = []
        self.n_groups = array("q")
        self.links = array("q")
        self.ends = array("q", [0])

    def _learn(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Align windows that were not met before, side by side.

        A link ends where one of its tokens does, so every distinct end has one; a group ends where both do.
        """
        ids_a, ids_b = (np.frombuffer(b"".join(k), "<u4").astype(np.int64) for k in zip(*keys, strict=True))
        ends_a, ends_b = np.cumsum(self.lengths_a[ids_a]), np.cumsum(self.lengths_b[ids_b])
        stops_a = np.cumsum([len(a) // 4 for a, _ in keys])
        places = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, places), np.searchsorted(ends_b, places)
        shared = places[(ends_a[at_a] == places) & (ends_b[at_b] == places)]
        last = ends_a[stops_a - 1]
        n_groups = np.diff(np.searchsorted(shared, last, "right"), prepend=0)

        # Each group's tokens of A, then of B, each with the sign behind it.
        side = np.concatenate([2 * np.searchsorted(shared, ends_a), 2 * np.searchsorted(shared, ends_b) + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([ids_a, ids_b])[order]
        closing = np.append(side[1:] != side[:-1], True)
        sign = np.where(closing, np.where(side % 2 == 0, 1, 2), 0)
        stops = np.searchsorted(side, 2 * np.cumsum(n_groups) - 1, "right")
        sign[stops - 1] = 3
        signed = self.decimals[sign, ids].tolist()
        base = self.ends[-1]
        self.links.frombytes((ids_a[at_a] << 32 | ids_b[at_b]).tobytes())
        self.ends.frombytes((base + np.searchsorted(places, last, "right")).astype(np.int64).tobytes())
        self.known.update(zip(keys, range(len(self.groups), len(self.groups) + len(keys)), strict=True))
        stops = stops.tolist()
        self.groups += ["".join(signed[p:q]) for p, q in zip([0, *stops[:-1]], stops, strict=True)]
        self.n_groups.frombytes(n_groups.astype(np.int64).tobytes())

    def align(self, texts: list[str]) -> list[tuple]:
        """``n_a, n_b, groups, windows`` of each text; None where its tokens do not give back its bytes."""
        spaced = [" " + t for t in texts]
        raw = [t.encode() for t in spaced]
        packed = self.a.encode(spaced)
        listed = self.b.encode(texts, num_threads=1)
        counts_a, counts_b = [len(p) // 4 for p in packed], [len(p) for p in listed]
        ids_a = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        ids_b = np.fromiter(chain.from_iterable(listed), np.int64, sum(counts_b))
        joined = b"".join(raw)
        good = range(len(texts))
        if not (_spell(ids_a, self.lengths_a, self.flat_a, joined) and _spell(ids_b, self.lengths_b, self.flat_b, joined)):
            own_a, own_b = (np.split(i, np.cumsum(c)[:-1]) for i, c in ((ids_a, counts_a), (ids_b, counts_b)))
            good = [
                k
                for k, own in enumerate(raw)
                if _spell(own_a[k], self.lengths_a, self.flat_a, own) and _spell(own_b[k], self.lengths_b, self.flat_b, own)
            ]
            if not good:
                return [None] * len(texts)
            ids_a, ids_b = (np.concatenate([own[k] for k in good]) for own in (own_a, own_b))
        # Two windows lie side by side only behind a verified end, so texts can follow each other here:
        # behind the last token of one comes the first of the next, which begins with a blank in both.
        ends_a, ends_b = np.cumsum(self.lengths_a[ids_a]), np.cumsum(self.lengths_b[ids_b])
        at_b = np.searchsorted(ends_b, ends_a)
        shared_a = np.flatnonzero(ends_b[at_b] == ends_a)
        shared_b = at_b[shared_a]
        anchor = np.ones(len(shared_a), bool)
        anchor[:-1] = self.spaced_a[ids_a[shared_a[:-1] + 1]] & self.spaced_b[ids_b[shared_b[:-1] + 1]]
        stops_a, stops_b = shared_a[anchor] + 1, shared_b[anchor] + 1
        windows = self._numbers(ids_a, ids_b, stops_a, stops_b)
        cuts = np.searchsorted(stops_a, np.cumsum([counts_a[k] for k in good]), "right")
        named = self.groups.__getitem__
        found: list = [None] * len(texts)
        for k, own in zip(good, np.split(windows, cuts[:-1]), strict=True):
            found[k] = (counts_a[k], counts_b[k], ";".join(map(named, own.tolist())), own)
        return found

    def _numbers(self, ids_a: np.ndarray, ids_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> np.ndarray:
        """The number of every window. Equal windows are found by a hash and compared id by id.

        The hash of ids i, j, k … is i + j * b + k * b ** 2 …, from running sums over all ids: those
        of a window are its sum divided by the power at its start.
        """
        sides = []
        total = np.zeros(len(stops_a), np.uint64)
        for ids, stops, base in ((ids_a, stops_a, self.bases[0]), (ids_b, stops_b, self.bases[1])):
            starts = np.concatenate(([0], stops[:-1]))
            powers, inverse = (self._powers(b, len(ids)) for b in (base, pow(base, -1, 1 << 64)))
            sums = np.cumsum((ids + 1).astype(np.uint64) * powers[: len(ids)])
            own = np.diff(sums[stops - 1], prepend=np.uint64(0)) * inverse[starts]
            total = total * np.uint64(0x9E3779B97F4A7C15) + own
            sides.append((ids, starts, stops - starts))
        _, first, same = np.unique(total, return_index=True, return_inverse=True)
        like = first[same]
        for ids, starts, sizes in sides:
            equal = np.array_equal(sizes, sizes[like])
            if not (equal and np.array_equal(ids, ids[np.arange(len(ids)) + np.repeat(starts[like] - starts, sizes)])):
                first = same = np.arange(len(total))
                break
        keys = []
        for ids, starts, sizes in sides:
            raw = ids.astype("<u4").tobytes()
            low = 4 * starts[first]
            keys.append([raw[p:q] for p, q in zip(low.tolist(), (low + 4 * sizes[first]).tolist(), strict=True)])
        pairs = list(zip(*keys, strict=True))
        if new := [k for k in dict.fromkeys(pairs) if k not in self.known]:
            self._learn(new)
        return np.array([self.known[k] for k in pairs], np.int64)[same]

    def _powers(self, base: int, size: int) -> np.ndarray:
        """Powers of ``base`` from 0 on, modulo 2 ** 64; those for usual batches are kept."""
        known = self.powers.get(base)
        if known is None or len(known) < size:
            known = np.full(max(size, 1 << 18), base, np.uint64)
            known[0] = 1
            known = np.cumprod(known)
            if len(known) <= 1 << 20:
                self.powers[base] = known
        return known

    def links_of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of the given windows, one after the other, with their and the groups' number in each."""
        ends = np.frombuffer(self.ends, np.int64)
        starts, counts = ends[windows], ends[windows + 1] - ends[windows]
        places = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        return np.frombuffer(self.links, np.int64)[places], counts, np.frombuffer(self.n_groups, np.int64)[windows]


def _spell(ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray, raw: bytes) -> bool:
    """Whether the bytes of the tokens, one after the other, are ``raw``; block by block."""
    if lengths[ids].sum() != len(raw):
        return False
    starts, done = np.cumsum(lengths) - lengths, 0
    for block in range(0, len(ids), SPELLED):
        own = ids[block : block + SPELLED]
        sizes = lengths[own]
        ends = np.cumsum(sizes)
        spelled = flat[np.repeat(starts[own] - ends + sizes, sizes) + np.arange(ends[-1])]
        if spelled.tobytes() != raw[done : done + len(spelled)]:
            return False
        done += len(spelled)
    return True


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(tokenizer: str, model: str) -> Aligner:
    if (tokenizer, model) not in _aligners:
        _aligners[tokenizer, model] = Aligner(tokenizer, model)
    return _aligners[tokenizer, model]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.LargeListArray.from_arrays(offsets.astype(np.int64), pa.array(values.astype(kind.to_pandas_dtype()), kind)).cast(
        pa.list_(kind)
    )


def _segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[ends] - sums[ends - lengths]


def _windows(docs: DataFrame, tokenizer: str, model: str, keep_groups: bool, chunk_bytes: int) -> DataFrame:
    """Every row of ``docs`` (text in ``_text``) with its counts and the windows of its text.

    Windows and id pairs are numbered per chunk of texts; the first row of a chunk also has the links
    of its windows and its pairs with their counts.
    """
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema if f.name != "_text"]
    schema = T.StructType(fields)
    for name in RESULTS[:4]:
        schema.add(name, "long")
    schema.add("groups_sha256", "string")
    if keep_groups:
        schema.add("groups", "string")
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    schema.add("_chunk", "long").add("_windows", ints).add("_lengths", ints).add("_links", ints)
    schema.add("_pairs", longs).add("_counts", longs)

    def chunk(own: Aligner, number: int, rows: list[pa.RecordBatch], found: list) -> pa.RecordBatch:
        kept = pa.Table.from_batches(rows).combine_chunks()
        lengths = np.array([0 if f is None else len(f[3]) for f in found], np.int64)
        windows = np.concatenate([np.zeros(0, np.int64), *(f[3] for f in found if f)])
        distinct, local = np.unique(windows, return_inverse=True)
        links, counts, n_groups = own.links_of(distinct)
        pairs, link = np.unique(links, return_inverse=True)
        times = np.repeat(np.bincount(local, minlength=len(distinct)), counts)
        totals = np.bincount(link, weights=times, minlength=len(pairs)).astype(np.int64)
        first = lambda values, kind: _lists([values, *[values[:0]] * (len(found) - 1)], kind)
        arrays = [kept.column(n).combine_chunks() for n in kept.schema.names if n != "_text"]
        arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        arrays += [pa.array([0 if f is None else f[k] for f in found], pa.int64()) for k in (0, 1)]
        arrays += [pa.array(_segment_sums(v[local], lengths), pa.int64()) for v in (n_groups, counts)]
        arrays.append(pa.array(["" if f is None else f[4] for f in found]))
        if keep_groups:
            arrays.append(pa.array(["" if f is None else f[2] for f in found]))
        arrays.append(pa.array([number] * len(found), pa.int64()))
        arrays.append(_lists(np.split(local, np.cumsum(lengths)[:-1]), pa.int32()))
        arrays += [first(counts, pa.int32()), first(link, pa.int32()), first(pairs, pa.int64()), first(totals, pa.int64())]
        if len(own.groups) > REMEMBERED:
            own.forget()
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def digested(one: tuple | None) -> tuple | None:
        if one is None:
            return None
        n_a, n_b, groups, windows = one
        digest = hashlib.sha256(groups.encode()).hexdigest()
        return n_a, n_b, groups if keep_groups else None, windows.astype(np.int32), digest

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(tokenizer, model)
        number = TaskContext.get().partitionId() << 32
        rows, found, held = [], [], 0
        for large in batches:
            for start in range(0, large.num_rows, SLICE_ROWS):
                batch = large.slice(start, SLICE_ROWS)
                texts = batch.column("_text").to_pylist()
                rows.append(batch.drop_columns(["_text"]) if batch.num_columns > 1 else batch)
                aligned = iter(own.align([t for t in texts if t]) if any(texts) else ())
                found += [digested(next(aligned)) if t else None for t in texts]
                held += sum(map(len, texts))
                if held >= chunk_bytes:
                    yield chunk(own, number, rows, found)
                    rows, found, held, number = [], [], 0, number + 1
        if rows:
            yield chunk(own, number, rows, found)

    return docs.mapInArrow(windowed, schema)


def align_tokens(
    docs: DataFrame,
    tokenizer: str,
    model: str,
    text: str = "text",
    keep_groups: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Replace the text column by the alignment of its tokens under ``tokenizer`` (A) and ``model`` (B).

    A encodes the text behind a blank, B the text, to which it adds one. ``n_a`` and ``n_b`` are their
    tokens, ``n_groups`` the parts between byte offsets where tokens of both end, ``n_links`` the pairs
    of tokens that overlap. A pair of ids counts as often as it is linked in all of ``docs``; ``count_sum``
    adds up the counts of a text's links, ``n_best`` is how many of them have the highest count of their
    B id, ties included. ``groups_sha256`` digests ``groups`` (kept if asked for).

    A text that is null or empty, or whose tokens do not give back its bytes, has zeros and no groups.
    Repeated rows and equal ids are separate texts and all count. Columns named like the results are
    replaced, others pass; names with an underscore are reserved. An empty table gives an empty result.

    Counts are summed per chunk of texts before they are shuffled, and go back to the chunks, each of
    which is put together with its texts' window numbers; texts are not moved.
    """
    kept = docs.drop(*RESULTS, *SCORES, "groups").withColumn("_text", whole(text)).drop(text)
    found = stored(_windows(kept, tokenizer, model, keep_groups, chunk_bytes), "windows")
    pair = F.posexplode(F.arrays_zip("_pairs", "_counts")).alias("_index", "_pair")
    pairs = found.filter(F.size("_pairs") > 0).select("_chunk", pair)
    pairs = pairs.select("_chunk", "_index", F.col("_pair._pairs").alias("_pair"), F.col("_pair._counts").alias("_count"))
    totals = pairs.groupBy("_pair").agg(F.sum("_count").alias("_total"))
    of_b = W.partitionBy(F.col("_pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    totals = totals.withColumn("_best", F.col("_total") == F.max("_total").over(of_b))
    scored = salted_join(pairs.drop("_count"), stored(totals, "pair-counts"), ["_pair"], spread="_chunk")
    scored = scored.select(F.col("_chunk").alias("_of"), "_index", "_total", "_best")

    names = [n for n in found.columns if not n.startswith("_")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in found.select(names).schema])
    for name in SCORES:
        schema.add(name, "long")

    def summed(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        size = texts.num_rows
        lengths = texts.column("_windows").combine_chunks().value_lengths().to_numpy()
        result = [np.zeros(size, np.int64)] * 2
        if pairs.num_rows:
            place = np.argsort(pairs.column("_index").to_numpy())
            flat = lambda name: texts.column(name).combine_chunks().flatten().to_numpy()
            links, of_window, windows = flat("_links"), flat("_lengths"), flat("_windows")
            for k, name in enumerate(("_best", "_total")):
                values = pairs.column(name).to_numpy().astype(np.int64)[place]
                result[k] = _segment_sums(_segment_sums(values[links], of_window)[windows], lengths)
        columns = [texts.column(n) for n in names] + [pa.array(r, pa.int64()) for r in result]
        return pa.Table.from_arrays(columns, names=schema.names)

    texts = found.select(*names, "_chunk", "_windows", "_lengths", "_links")
    return texts.groupBy("_chunk").cogroup(scored.groupBy("_of")).applyInArrow(summed, schema)
