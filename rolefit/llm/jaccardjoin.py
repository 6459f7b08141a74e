"""Exact n-gram Jaccard join: tiles by size with bitmaps that bound the overlap, then intersection."""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import stored
from rolefit.llm.components import components
from rolefit.llm.shingles import mixed, shingle_sets
from rolefit.plans.joins import sized_join

# Similarity as a fraction: links need MOST * intersection >= LEAST * union.
LEAST, MOST = 75, 100
# The most frequent shingles come last in the order of keys; so many are told to every task.
FREQUENT = 1 << 16
# Keys with more sets than this go through tiles of at most about TILE sets from either side.
PAIRED = 12
TILE = 2048
# A tile that is intersected exactly takes at most about so many shingles from either side.
TILE_SHINGLES = 1 << 21
BATCH = 500
# A set that is the first of more pairs meets its partners in several tasks.
PARTNERS = 2048
# Sets whose keys a task has already given are remembered up to this number.
REMEMBERED = 1 << 17
# Linked sets are at most one band of sizes apart; the margin outweighs rounding.
BAND = math.log(MOST / LEAST + 1e-6)


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for large in batches:
        for start in range(0, large.num_rows, rows):
            yield large.slice(start, rows)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def frequent_shingles(docs: DataFrame, text: str, most: int = FREQUENT) -> np.ndarray:
    """Hashes of shingles that many documents share, ``most`` at most, sorted.

    Every batch of rows reports what several of its documents share. This decides only in which
    order shingles are tried as keys; any order finds the same links.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 5000):
            sets = [*shingle_sets(batch.column(0).to_pylist())]
            if not sets:
                continue
            found, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(4, len(sets) // 500)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(found[often])), pa.array(counts[often])], names=["shingle", "n"]
            )

    top = (
        docs.select(text)
        .mapInArrow(shared, "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "shingle")
        .limit(most)
        .toPandas()["shingle"]
        .to_numpy(np.int64)
    )
    return np.sort(top.view(np.uint64))


def prefix_length(n: int) -> int:
    """How many of the first shingles are keys.

    Linked sets share LEAST/MOST of the larger or more; so they share one of the first shingles in any
    common order.
    """
    return n - -(-LEAST * n // MOST) + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit per hash value: whether an odd number of shingles has it; as many bits as shingles or up to twice.

    Every shingle that two sets do not share flips one bit, so their bitmaps differ in no more bits than that.
    """
    width = max(128, 1 << int(len(shingles) - 1).bit_length())
    counts = np.bincount((mixed(shingles) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def set_number(shingles: np.ndarray) -> int:
    """A hash of a whole set."""
    return int(_signed(mixed(shingles + np.uint64(7)).sum(dtype=np.uint64)[None])[0])


def signatures(docs: DataFrame, id_column: str, text: str, frequent: np.ndarray) -> DataFrame:
    """``id, n, set_id, bits, keys`` of every document.

    A task gives the keys of a set with its first copy, and leaves them out of copies that it remembers.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in _batches(batches, BATCH):
            rows = ([], [], [], [])
            for s in shingle_sets(batch.column(1).to_pylist()):
                n = len(s)
                rows[0].append(n)
                if not n:
                    for r, empty in zip(rows[1:], (None, None, []), strict=True):
                        r.append(empty)
                    continue
                number = set_number(s)
                rows[1].append(number)
                rows[2].append(bitmap(s))
                if (number, n) in given:
                    rows[3].append([])
                    continue
                if len(given) >= REMEMBERED:
                    given.clear()
                given.add((number, n))
                at = np.searchsorted(frequent, s)
                late = np.zeros(n, bool)
                if len(frequent):
                    late = frequent[np.minimum(at, len(frequent) - 1)] == s
                ordered = np.concatenate((s[~late], s[late])) if late.any() else s
                rows[3].append(_signed(ordered[: prefix_length(n)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(rows[0], pa.int64()),
                    pa.array(rows[1], pa.int64()),
                    pa.array(rows[2], pa.binary()),
                    pa.array(rows[3], pa.list_(pa.int64())),
                ],
                names=["id", "n", "set_id", "bits", "keys"],
            )

    return docs.select(F.col(id_column).cast("long").alias("id"), text).mapInArrow(
        signed, "id long, n long, set_id long, bits binary, keys array<long>"
    )


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, np.ndarray | pa.Array]]:
    """Runs of whole groups from rows sorted by ``by``; a run ends where a batch does or later."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        last = np.ones(table.num_rows, bool)
        for name in by:
            column = table.column(name).to_numpy()
            last &= column == column[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sizes_link(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    return MOST * small >= LEAST * large


PAIR = "a long, a_n long, b long, b_n long"
SHARED = "key long, set_id long, n long, before long, before_n long"


def shared_keys(rows: DataFrame) -> DataFrame:
    """From ``key, set_id, n``: the rows of keys that several sets have, once each.

    ``before`` is the set of the key that comes before in order of size, where the sizes allow a link.
    Rows are dealt by ranges of (key, n, set), so a key of any number of sets is spread. The first and
    last key of a task may go on in another one and are always kept.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_again, last, edge = None, False, None, None

        def made(rows: np.ndarray, before: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            fits = (before[1] > 0) & _sizes_link(before[1], rows[2])
            columns = [pa.array(c[keep]) for c in rows] + [pa.array(c[keep], mask=~fits[keep]) for c in before]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SHARED.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in ("key", "set_id", "n")])
            edge = rows[0, 0] if edge is None else edge
            if held is not None:
                rows = np.concatenate((held, rows), axis=1)
            rows = rows[:, _starts(*rows)]
            again = np.append(held_again, rows[0, 1:] == rows[0, :-1])
            before = np.zeros((2, rows.shape[1]), np.int64)
            before[:, 1:] = np.where(again[1:], rows[1:, :-1], 0)
            if held_again:
                before[:, 0] = last
            keep = again | np.append(again[1:], False) | (rows[0] == edge)
            # The last row waits for the next batch, which may go on with its key.
            keep[-1] = False
            yield made(rows, before, keep)
            last, held, held_again = before[:, -1], rows[:, -1:], bool(again[-1])
        if held is not None:
            yield made(held, last[:, None], np.ones(1, bool))

    ordered = rows.repartitionByRange("key", "n", "set_id").sortWithinPartitions("key", "n", "set_id")
    return ordered.select("key", "set_id", "n").mapInArrow(found, SHARED)


class Tile:
    """Sets of one tile in order of size, with their bitmaps by width."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n = n
        widths = np.array([len(b) for b in bits])
        self.at = np.zeros(len(n), np.int64)
        self.width = widths
        self.rows, self.bits, self.half = {}, {}, {}
        for w in np.unique(widths):
            of = np.flatnonzero(widths == w)
            words = np.frombuffer(b"".join([bits[i] for i in of]), np.uint64).reshape(len(of), -1)
            self.rows[w], self.bits[w] = of, words
            if w >= 16:
                self.half[w] = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
            self.at[of] = np.arange(len(of))

    def linkable(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of the sets ``others``, those whose overlap with set i may be large enough."""
        w, found = self.width[i], []
        for v in (w // 2, w, w * 2):
            of = others[self.width[others] == v]
            if not len(of):
                continue
            mine = self.half[w][self.at[i]] if v < w else self.bits[w][self.at[i]]
            theirs = (self.half[v] if v > w else self.bits[v])[self.at[of]]
            differ = np.bitwise_count(theirs ^ mine).sum(1, dtype=np.int64)
            total = self.n[i] + self.n[of]
            most = (total - differ) // 2
            found.append(of[MOST * most >= LEAST * (total - most)])
        return np.concatenate(found) if found else others[:0]


def _tiled(rows: DataFrame, find: Callable, columns: list[str], made: str) -> DataFrame:
    """What ``find`` makes of every tile (``key``, ``block``) of ``rows``, given ``columns`` in order of size.

    ``find`` returns the columns of ``made``; none may be made of a tile with one set.
    """
    names = [part.split()[0] for part in made.split(", ")]

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "block"]):
            key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
            starts = _starts(key, block)
            for a, b in zip(starts, np.append(starts[1:], len(key)), strict=True):
                if b - a < 2:
                    continue
                tile = table.slice(a, b - a)
                found = find(*(_column(tile, c) for c in columns))
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    placed = rows.repartition("key", "block").sortWithinPartitions("key", "block", "n", "set_id")
    return placed.select(*dict.fromkeys(["key", "block", *columns])).mapInArrow(tested, made)


def _column(tile: pa.Table, name: str) -> np.ndarray | list[bytes]:
    column = tile.column(name)
    return column.to_pylist() if pa.types.is_binary(column.type) else column.to_numpy()


def _pairs(found: Iterator[tuple[int, int]], sid: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns of PAIR of pairs of places, the smaller set first."""
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    i, j = pairs[:, 0], pairs[:, 1]
    swap = (n[i] > n[j]) | ((n[i] == n[j]) & (sid[i] > sid[j]))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return sid[i], n[i], sid[j], n[j]


def _apart(tile: Tile, label: np.ndarray, sent: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every sent set with those of the tile that it may be linked with and whose label is another.

    ``label`` may be changed between two of them.
    """
    there = np.flatnonzero(~sent)
    for i in np.flatnonzero(sent):
        low = -(-LEAST * tile.n[i] // MOST)
        a = np.searchsorted(tile.n[there], low)
        b = np.searchsorted(tile.n[there], MOST * tile.n[i] // LEAST, side="right")
        others = there[a:b]
        others = others[label[others] != label[i]]
        if len(others):
            yield int(i), tile.linkable(i, others)


def _touched(main, sid, n, label, sent, bits) -> tuple[np.ndarray, ...]:
    """The sets of a tile that may be linked with one of another label."""
    near = np.zeros(len(sid), bool)
    for i, others in _apart(Tile(n, bits), label, sent):
        near[others] = True
        near[i] |= len(others) > 0
    return tuple(x[near] for x in (main, sid, n, label))


def _linked(sid, n, label, sent, shingles: list[bytes]) -> tuple[np.ndarray, ...]:
    """Links by exact intersection, only as many as connect the labels of a tile."""
    sets = [np.frombuffer(s, np.uint64) for s in shingles]
    label = np.unique(label, return_inverse=True)[1]

    def joined() -> Iterator[tuple[int, int]]:
        for i, others in _apart(Tile(n, [bitmap(s) for s in sets]), label, sent):
            if not len(others):
                continue
            flat = np.concatenate([sets[j] for j in others])
            at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            starts = np.concatenate(([0], np.cumsum(n[others])[:-1]))
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
            for j in others[MOST * both >= LEAST * (n[i] + n[others] - both)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    yield i, int(j)

    return _pairs(joined(), sid, n)


def shingles_of(classes: DataFrame, docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``set_id, n, shingles`` of some classes, from the texts of their representatives."""
    texts = docs.select(F.col(id_column).cast("long").alias("rep"), F.col(text).alias("text"))
    found = sized_join(texts, classes.select("rep", "set_id", "n"), ["rep"]).select("set_id", "n", "text")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, BATCH):
            ids, sizes = batch.column("set_id").to_numpy(), batch.column("n").to_numpy()
            sets = [*shingle_sets(batch.column("text").to_pylist())]
            # Another row with the id of the representative may have another text.
            of = [
                len(s) == m and set_number(s) == i for s, i, m in zip(sets, ids.tolist(), sizes.tolist(), strict=True)
            ]
            packed = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_id"), batch.column("n"), packed], names=["set_id", "n", "shingles"]
            ).filter(pa.array(of, pa.bool_()))

    return found.mapInArrow(taken, "set_id long, n long, shingles binary")


def _pairs_apart(rows: DataFrame) -> DataFrame:
    """Pairs of the sets of a key, PAIRED at most, whose labels differ and whose sizes allow a link, once each."""
    sets = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "set_id", "label"))).alias("sets"))
    pairs = sets.select("sets", F.posexplode("sets").alias("at", "x"))
    later = F.filter(
        F.slice("sets", F.col("at") + 2, PAIRED),
        lambda y: (y["label"] != F.col("x.label")) & (y["n"] * LEAST <= F.col("x.n") * MOST),
    )
    pairs = pairs.select("x", F.explode(later).alias("y"))
    return pairs.select(
        F.col("x.set_id").alias("a"), F.col("x.n").alias("a_n"), F.col("y.set_id").alias("b"), F.col("y.n").alias("b_n")
    ).distinct()


def _grid(rows: DataFrame) -> DataFrame:
    """``block, sent`` for rows ``key, main, set_id, n, label``; those outside the main component are also sent.

    Sets are placed by key and band of sizes and sent to the bands around theirs; bands where nothing
    sent meets another component go. A tile takes a part of the sets of a band and a part of those sent,
    so neither side outgrows a task.
    """
    own = rows.withColumn("band", F.floor(F.log("n") / BAND)).withColumn("sent", F.lit(False))
    around = F.array(*(F.col("band") + d for d in (-1, 0, 1)))
    sent = own.filter("label <> main").withColumn("band", F.explode(around)).withColumn("sent", F.lit(True))
    both = own.unionByName(sent)
    parts = lambda c, size: F.greatest(F.lit(1), F.ceil(F.greatest(c / TILE, size / TILE_SHINGLES)))
    side = lambda is_sent: parts(
        F.count_if(F.col("sent") == is_sent), F.coalesce(F.sum(F.when(F.col("sent") == is_sent, F.col("n"))), F.lit(0))
    )
    sizes = both.groupBy("key", "band").agg(
        side(False).alias("down"),
        side(True).alias("across"),
        (F.bool_or("sent") & ~F.bool_and("sent") & (F.min("label") < F.max("label"))).alias("meet"),
    )
    both = both.join(sizes.filter("meet").drop("meet"), ["key", "band"])
    part_of = lambda parts: F.pmod(F.xxhash64("set_id"), F.col(parts))
    other = F.when(F.col("sent"), F.col("down")).otherwise(F.col("across"))
    both = both.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    block = F.when(F.col("sent"), F.col("at") * F.col("across") + part_of("across")).otherwise(
        part_of("down") * F.col("across") + F.col("at")
    )
    both = both.withColumn("block", F.col("band") * F.lit(1 << 40) + block)
    return both.select("key", "block", "main", "set_id", "n", "label", "sent")


def _represented(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: the ids of the representatives of pairs of sets."""
    for side in ("a", "b"):
        rep = classes.select(
            F.col("set_id").alias(side), F.col("n").alias(f"{side}_n"), F.col("rep").alias(f"{side}_rep")
        )
        pairs = pairs.join(rep, [side, f"{side}_n"])
    return pairs.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Those of the pairs of sets ``a, a_n, b, b_n`` that are similar enough, by intersection.

    The text of ``a`` is sent once for up to PARTNERS of its pairs, that of ``b`` once per pair.
    """
    sides = pairs.select(F.col("a").alias("set_id"), F.col("a_n").alias("n")).union(pairs.select("b", "b_n"))
    needed = stored(classes.select("rep", "set_id", "n").join(sides.distinct(), ["set_id", "n"]), "needed")
    texts = docs.select(F.col(id_column).cast("long").alias("rep"), F.col(text).alias("text"))
    # Texts stay where they are as long as the list of those needed is measured to fit every task.
    texts = stored(sized_join(texts, needed, ["rep"]).select("set_id", "n", "text"), "texts")
    parts = pairs.groupBy("a", "a_n").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    of_a = texts.select(F.col("set_id").alias("a"), F.col("n").alias("a_n"), "text").join(parts, ["a", "a_n"])
    none = F.lit(None).cast("long")
    firsts = of_a.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "a", "a_n", "part", none.alias("b"), none.alias("b_n"), "text"
    )
    of_b = texts.select(F.col("set_id").alias("b"), F.col("n").alias("b_n"), "text")
    dealt = pairs.join(parts, ["a", "a_n"]).withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    seconds = dealt.join(of_b, ["b", "b_n"]).select("a", "a_n", "part", "b", "b_n", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, of = None, None
        for batch in _batches(batches, BATCH):
            a, a_n, b, b_n = (batch.column(c).to_pylist() for c in ("a", "a_n", "b", "b_n"))
            keep = np.zeros(batch.num_rows, bool)
            for i, s in enumerate(shingle_sets(batch.column("text").to_pylist())):
                # Another row with the id of a representative may have another text.
                if (set_number(s), len(s)) != ((a[i], a_n[i]) if b[i] is None else (b[i], b_n[i])):
                    continue
                if b[i] is None:
                    first, of = s, (a[i], a_n[i])
                elif of == (a[i], a_n[i]):
                    both = len(np.intersect1d(first, s, assume_unique=True))
                    keep[i] = MOST * both >= LEAST * (len(first) + len(s) - both)
            yield batch.select(["a", "a_n", "b", "b_n"]).filter(pa.array(keep))

    placed = firsts.union(seconds).repartition("a", "a_n", "part").sortWithinPartitions("a", "a_n", "part", "b")
    return placed.mapInArrow(compared, PAIR).distinct()


def _labels(links: DataFrame, classes: DataFrame) -> DataFrame:
    """``set_id, n, label`` of all classes."""
    found = components(links)
    return classes.select("set_id", "n", "rep").join(
        found.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("set_id", "n", F.coalesce("component", "rep").alias("label"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column, n_shingles, component_id`` of every row of ``docs``.

    A document's set holds its distinct five-word shingles (all its words if fewer). Two documents
    are linked from a similarity of LEAST/MOST on; ``component_id`` is the least id reachable.

    Equal sets form one class. Sets that share one of their first shingles, frequent ones last, are
    compared, in two passes. In the first, every set meets at most one set: of those that come right before
    it in one of its keys, the one whose bitmap allows the most. The second takes the keys whose sets are
    still in several components. Those of up to PAIRED sets give their pairs, once for all keys; larger
    ones go into tiles by band of sizes. Bitmaps bound the overlap from above, and what remains is
    intersected, in tiles handing on only links that join components. So none of those is lost; shingles
    are told apart by 64-bit hashes.

    A null or empty text, or one without words, has no shingles and is its own component. Rows with
    a null id have a null component and link nothing. Rows with equal ids count as one document
    whose rows all get the least component of any. An empty table gives an empty result; ids must be
    integers; other columns are not looked at.
    """
    frequent = frequent_shingles(docs, text)
    signed = stored(signatures(docs, id_column, text, frequent), "signatures")
    linked = signed.filter("n > 0 AND id IS NOT NULL")
    classes = stored(
        linked.groupBy("set_id", "n").agg(F.min("id").alias("rep"), F.any_value("bits").alias("bits")), "classes"
    )
    keyed = linked.select("set_id", "n", F.explode("keys").alias("key"))
    shared = stored(shared_keys(keyed), "keys")
    bits = classes.select("set_id", "n", "bits")
    named = shared.filter("before IS NOT NULL").select(
        F.col("before").alias("a"), F.col("before_n").alias("a_n"), F.col("set_id").alias("b"), F.col("n").alias("b_n")
    )
    bounded = _bounded(named.distinct(), bits)
    best = F.max_by(F.struct("a", "a_n"), F.struct("most", "a", "a_n")).alias("best")
    first = stored(bounded.groupBy("b", "b_n").agg(best).select("best.a", "best.a_n", "b", "b_n"), "pairs")
    links = stored(_represented(verified(first, classes, docs, id_column, text), classes), "links")
    labels = stored(_labels(links, classes), "labels")

    labelled = stored(shared.select("key", "set_id", "n").join(labels, ["set_id", "n"]), "labelled")
    counts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    mains = counts.groupBy("key").agg(
        F.max(F.struct("c", "label"))["label"].alias("main"), F.sum("c").alias("sets"), F.count(F.lit(1)).alias("labels")
    )
    mains = stored(mains.filter("labels > 1").drop("labels"), "mains")
    apart = stored(labelled.join(mains, "key"), "apart")
    small = _bounded(_pairs_apart(apart.filter(F.col("sets") <= PAIRED)).join(first, ["a", "a_n", "b", "b_n"], "left_anti"), bits)
    small = stored(small.drop("most"), "pairs")
    links = links.union(_represented(verified(small, classes, docs, id_column, text), classes))
    rows = _grid(apart.filter(F.col("sets") > PAIRED).drop("sets"))
    touched = _tiled(
        rows.join(bits, ["set_id", "n"]), _touched, ["main", "set_id", "n", "label", "sent", "bits"],
        "key long, set_id long, n long, label long",
    )
    # Keys around one component share most of their sets: these meet once for all keys.
    touched = stored(touched.distinct(), "touched")
    needed = stored(classes.drop("bits").join(touched.select("set_id", "n").distinct(), ["set_id", "n"]), "needed")
    sets = stored(shingles_of(needed, docs, id_column, text), "sets")
    more = _tiled(
        _grid(touched.withColumn("main", F.col("key"))).join(sets, ["set_id", "n"]),
        _linked, ["set_id", "n", "label", "sent", "shingles"], PAIR,
    )
    more = stored(_represented(more, classes), "links")
    final = _labels(links.union(more), classes)
    result = signed.select("id", "n", "set_id").join(final, ["set_id", "n"], "left")
    return result.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("component_id"),
    )


def _bounded(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow a link, with the ``most`` similarity that they allow."""
    for side in ("a", "b"):
        pairs = pairs.join(
            bits.select(
                F.col("set_id").alias(side), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits")
            ),
            [side, f"{side}_n"],
        )

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 2000):
            n, m = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            bound = []
            for x, y, i, j in zip(batch.column("a_bits").to_pylist(), batch.column("b_bits").to_pylist(), n, m, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(y) > len(x):
                    y = y[: len(x)] ^ y[len(x) :]
                most = (i + j - int(np.bitwise_count(x ^ y).sum())) // 2
                bound.append(most / (i + j - most) if MOST * most >= LEAST * (i + j - most) else -1.0)
            found = batch.select(["a", "a_n", "b", "b_n"]).append_column("most", pa.array(bound, pa.float64()))
            yield found.filter(pa.array([m >= 0 for m in bound], pa.bool_()))

    return pairs.select("a", "a_n", "b", "b_n", "a_bits", "b_bits").mapInArrow(tested, PAIR + ", most double")
