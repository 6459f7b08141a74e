"""A hashed maximum-entropy language model with a class-factored softmax."""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import stored, whole

# Words that every task knows, at most: a bound on what is told to all. The others meet their counts by a join.
HEAD = 1 << 16
# Counts are told apart by so many steps from one power of two to the next where the head ends.
COUNT_STEPS = 64
FORMS, BINS, TAILS = 8, 7, 8
END_CLASS = FORMS * BINS
CLASSES = END_CLASS + 1 + TAILS
# Hashed features: the word before, the class two before, and both together.
BEFORE = 2048
BLOCKS = 64
IN_BLOCK = BEFORE // BLOCKS
PAIRS = 1024
ROUNDS, STEPS, RATE, PRIOR = 4, 8, 0.5, 4.0
END = b""
CELLS = (CLASSES + 1) * CLASSES


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes split at exactly the white space that separates words."""
    return (text or "").encode().lower().split()


# Words counted apart before they are handed on, and rows of a slice: bounds on a worker's memory.
COUNTED = 1 << 18
SLICE_ROWS = 250


def _slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for large in batches:
        for start in range(0, large.num_rows, rows):
            yield large.slice(start, rows)


def word_counts(training: DataFrame, text: str) -> DataFrame:
    """``word, n`` of all words and ends of the training texts, counted by stretches of rows, then by word."""

    def rows_of(counts: Counter[bytes]) -> pa.RecordBatch:
        columns = [pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in _slices(batches):
            for value in batch.column(0):
                counts.update(words_of(value.as_py()))
            counts[END] += batch.num_rows
            if len(counts) >= COUNTED:
                yield rows_of(counts)
                counts = Counter()
        yield rows_of(counts)

    return training.select(text).mapInArrow(counted, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n")
    )


def least_head_count(counts: DataFrame) -> int:
    """The count from which on a word belongs to the head: HEAD words have it at most.

    Words are counted by the logarithm of their count, so a few thousand sums reach the driver; words
    of the step that would go beyond HEAD are all left out.
    """
    step = F.floor(F.log2("n") * COUNT_STEPS)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    words, least = 0, (1 << 63) - 1
    for row in steps.orderBy(F.desc("step")).collect():
        words += row["words"]
        if words > HEAD:
            break
        least = row["least"]
    return least


def tail_form(word: bytes) -> int:
    """The class of a word outside the head, by its last two bytes."""
    return zlib.crc32(word[-2:]) % TAILS


def word_forms(words: list[bytes]) -> np.ndarray:
    """A form cluster for every word: spherical k-means over hashed byte pairs, from a fixed start."""
    grams = np.zeros((len(words), 64), np.float32)
    for i, word in enumerate(words):
        padded = b"^" + word + b"$"
        for a, b in zip(padded, padded[1:], strict=False):
            grams[i, (a * 31 + b * 7) % 64] += 1
    grams -= grams.mean(0)
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-6)
    centers = grams[np.linspace(0, len(words) - 1, FORMS).astype(int)].copy()
    form = np.zeros(len(words), np.int64)
    for _ in range(8):
        form = (grams @ centers.T).argmax(1)
        for k in range(FORMS):
            if (form == k).any():
                centers[k] = grams[form == k].mean(0)
                centers[k] /= max(float(np.linalg.norm(centers[k])), 1e-6)
    return form


class Vocabulary(dict):
    """Numbers of head words; any other word has a number by its form, after the head."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.counts = counts
        form = word_forms(words)
        self.classes = np.zeros(len(words) + TAILS, np.int64)
        for k in range(FORMS):
            of = np.flatnonzero(form == k)
            mass = np.cumsum(counts[of]) / max(1, counts[of].sum())
            self.classes[of] = k * BINS + np.minimum((mass * BINS).astype(np.int64), BINS - 1)
        if END in self:
            self.classes[self[END]] = END_CLASS
        self.classes[len(words) :] = END_CLASS + 1 + np.arange(TAILS)
        totals = np.bincount(self.classes[: len(words)], counts, CLASSES)
        self.in_class = np.log10(counts / np.maximum(totals[self.classes[: len(words)]], 1))
        self.before = (np.arange(len(words) + TAILS, dtype=np.uint64) * np.uint64(2654435761)) >> np.uint64(7)
        self.before = (self.before % np.uint64(BEFORE - 1)).astype(np.int64) + 1

    def __missing__(self, word: bytes) -> int:
        return len(self.counts) + tail_form(word)

    def contexts(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: bucket of the word before, class two before, own class. ``first`` starts texts."""
        own = self.classes[numbers]
        before, skip = np.zeros(len(numbers), np.int64), np.full(len(numbers), CLASSES, np.int64)
        before[1:] = self.before[numbers[:-1]]
        skip[2:] = own[:-2]
        before[first] = 0
        skip[first] = CLASSES
        second = first + 1
        skip[second[second < len(numbers)]] = CLASSES
        return before, skip, own


def numbered(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Numbers of all tokens, the ends included, where each text begins, and the words."""
    words = [[*words_of(t), END] for t in texts]
    sizes = np.array([len(w) for w in words])
    of = vocabulary.__getitem__
    numbers = np.fromiter((n for w in words for n in map(of, w)), np.int64, int(sizes.sum()))
    return numbers, np.cumsum(sizes) - sizes, words


def context_counts(training: DataFrame, text: str, shared) -> DataFrame:
    """``block, counts``: how often each class follows each hashed context, summed over all texts."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = shared.value, np.zeros(BEFORE * CELLS, np.int32)
        for batch in _slices(batches):
            numbers, first, _ = numbered(batch.column(0).to_pylist(), vocabulary)
            before, skip, own = vocabulary.contexts(numbers, first)
            np.add.at(total, (before * (CLASSES + 1) + skip) * CLASSES + own, 1)
        for block, part in enumerate(total.reshape(BLOCKS, -1)):
            found = np.flatnonzero(part).astype(np.int32)
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int32()),
                        pa.array([found.tobytes()], pa.binary()),
                        pa.array([part[found].tobytes()], pa.binary()),
                    ],
                    names=["block", "cells", "n"],
                )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                total = totals.setdefault(block, np.zeros(IN_BLOCK * CELLS, np.int64))
                total[np.frombuffer(cells, np.int32)] += np.frombuffer(n, np.int32)
        for block, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"]
            )

    parts = training.select(text).mapInArrow(gathered, "block int, cells binary, n binary")
    return parts.repartition(BLOCKS, "block").mapInArrow(summed, "block int, counts binary")


PAIR_OF = (np.arange(IN_BLOCK * (CLASSES + 1)) * 2654435761 >> 5) % PAIRS


class Weights:
    """Feature weights of one block of contexts, with those that all blocks share."""

    def __init__(self, bias: np.ndarray, skip: np.ndarray, own: bytes | None):
        self.bias, self.skip = bias, skip
        sizes = (IN_BLOCK * CLASSES, PAIRS * CLASSES)
        flat = np.zeros(sum(sizes)) if own is None else np.frombuffer(own, np.float32).astype(np.float64)
        self.before = flat[: sizes[0]].reshape(IN_BLOCK, CLASSES)
        self.pairs = flat[sizes[0] :].reshape(PAIRS, CLASSES)

    def bytes(self) -> bytes:
        return np.concatenate((self.before.ravel(), self.pairs.ravel())).astype(np.float32).tobytes()

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Natural logarithms, a row per context of the block."""
        before, skip = np.divmod(contexts, CLASSES + 1)
        x = self.bias + self.skip[skip] + self.before[before] + self.pairs[PAIR_OF[contexts]]
        x -= x.max(1, keepdims=True)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    def step(self, counts: np.ndarray) -> np.ndarray:
        """One gradient step on the block's own weights; returns observed and expected counts by class."""
        contexts = np.arange(len(counts))
        expected = np.exp(self.log_probabilities(contexts)) * counts.sum(1, keepdims=True)

        def updated(weights: np.ndarray, observed: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            slope = observed - wanted - PRIOR * weights
            return weights + RATE * slope / (np.maximum(observed, wanted) + PRIOR)

        square = (IN_BLOCK, CLASSES + 1, CLASSES)
        self.before = updated(
            self.before, counts.reshape(square).sum(1), expected.reshape(square).sum(1)
        )
        by_pair = [np.zeros((PAIRS, CLASSES)), np.zeros((PAIRS, CLASSES))]
        np.add.at(by_pair[0], PAIR_OF, counts)
        np.add.at(by_pair[1], PAIR_OF, expected)
        self.pairs = updated(self.pairs, *by_pair)
        return np.stack((counts.reshape(square).sum(0), expected.reshape(square).sum(0)))


def class_table(bias: np.ndarray, skip: np.ndarray, own: dict[int, bytes]) -> np.ndarray:
    """log10 probability of every class in every context: BEFORE x (CLASSES + 1) rows of fixed number."""
    contexts = np.arange(IN_BLOCK * (CLASSES + 1))
    table = np.empty((BLOCKS, len(contexts), CLASSES), np.float32)
    for block in range(BLOCKS):
        table[block] = Weights(bias, skip, own.get(block)).log_probabilities(contexts) / np.log(10)
    return table.reshape(-1, CLASSES)


def trained(statistics: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
    """Weights by rounds of distributed gradient updates.

    In a round every block improves its own weights; the gradients of the shared ones are added up.
    The driver gets weights only: their number is fixed.
    """
    bias = np.zeros(CLASSES)
    skip = np.zeros((CLASSES + 1, CLASSES))
    state = statistics.withColumn("own", F.lit(None).cast("binary"))
    for number in range(ROUNDS):

        def improved(batches, bias=bias, skip=skip, steps=STEPS if number else 0):
            for batch in batches:
                for block, counts, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    counts = np.frombuffer(counts, np.int64).reshape(-1, CLASSES)
                    weights = Weights(bias, skip, own)
                    for _ in range(steps):
                        weights.step(counts)
                    kept = weights.bytes()
                    sums = weights.step(counts.astype(np.float64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block], pa.int32()),
                            pa.array([counts.tobytes()], pa.binary()),
                            pa.array([kept], pa.binary()),
                            pa.array([sums.tobytes()], pa.binary()),
                        ],
                        names=["block", "counts", "own", "sums"],
                    )

        done = stored(
            state.mapInArrow(improved, "block int, counts binary, own binary, sums binary"), "weights"
        )
        sums = sum(
            (np.frombuffer(r["sums"], np.float64).reshape(2, CLASSES + 1, CLASSES) for r in done.select("sums").toLocalIterator()),
            np.zeros((2, CLASSES + 1, CLASSES)),
        )
        observed, expected = sums
        if number == 0:
            bias = np.log(observed.sum(0) + 0.5)
        else:
            skip = skip + RATE * (observed - expected - PRIOR * skip) / (np.maximum(observed, expected) + PRIOR)
        state = done.drop("sums")
    own = {r["block"]: bytes(r["own"]) for r in state.select("block", "own").toLocalIterator()}
    return bias, skip, own


def score_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", held_out: int = 2, folds: int = 7) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Texts whose crc32 of the id modulo ``folds`` is not ``held_out`` are learned from; all are scored.
    ``base_score`` is the add-one unigram score, ``score`` the model's log10 probability: of the
    token's class given the two tokens before, times that of the token within its class. Head words
    have their share of the class; the others are counted in TAILS classes by form, with one more
    place for all words never seen. Counts are exact over all training texts.

    A null text is empty and has its end only; a null id counts as empty text. Equal rows are scored
    alike and learned from as often as they stand. Without training texts both scores are base scores.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"),
        whole(text).alias("text"),
        (F.pmod(F.crc32(name.cast("binary")), F.lit(folds)) == held_out).alias("held_out"),
    )
    training = rows.filter(~F.col("held_out"))
    counts = stored(word_counts(training, "text"), "words")
    train_tokens, known_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = least_head_count(counts)
    top = sorted((-r["n"], bytes(r["word"])) for r in counts.filter(F.col("n") >= least).toLocalIterator())
    vocabulary = Vocabulary([w for _, w in top] or [END], np.array([-n for n, _ in top] or [1], np.int64))
    shared = spark.sparkContext.broadcast(vocabulary)
    statistics = stored(context_counts(training, "text", shared), "contexts")
    bias, skip, own = trained(statistics)
    model = spark.sparkContext.broadcast((bias, skip, own))
    space = float(train_tokens + known_words + 1)
    seen = train_tokens > 0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = shared.value, class_table(*model.value)
        base_of = np.log10((vocabulary.counts + 1) / space) if seen else np.zeros(len(vocabulary.counts))
        size = len(vocabulary.counts)
        for batch in _slices(batches):
            numbers, first, words = numbered(batch.column("text").to_pylist(), vocabulary)
            before, skip, own = vocabulary.contexts(numbers, first)
            score = table[before * (CLASSES + 1) + skip, own].astype(np.float64)
            head = numbers < size
            score[head] += vocabulary.in_class[numbers[head]]
            base = np.where(head, base_of[np.minimum(numbers, size - 1)], 0.0)
            sizes = np.diff(np.append(first, len(numbers)))
            tails = []
            for d, (a, k) in enumerate(zip(first, sizes, strict=True)):
                at = np.flatnonzero(~head[a : a + k])
                tails.append(Counter(words[d][i] for i in at) if len(at) else {})
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in tails]))).astype(np.int32)
            tail_words = pa.ListArray.from_arrays(offsets, pa.array([w for t in tails for w in t], pa.binary()))
            tail_counts = pa.ListArray.from_arrays(offsets, pa.array([n for t in tails for n in t.values()], pa.int64()))
            add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "held_out", "row")),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(add(head.astype(np.int64)).astype(np.int64) * seen),
                    pa.array(add(base)),
                    pa.array(add(score)),
                    tail_words,
                    tail_counts,
                ],
                names=["id", "held_out", "row", "n_tokens", "head_known", "head_base", "head_score", "tail", "tail_n"],
            )

    kind = {"bigint": "long"}.get(docs.schema[id_column].dataType.simpleString(), docs.schema[id_column].dataType.simpleString())
    rows = rows.withColumn("row", F.xxhash64(F.col("id").cast("string"), "text"))
    parts = stored(
        rows.mapInArrow(
            scored,
            f"id {kind}, held_out boolean, row long, n_tokens long, head_known long, head_base double, "
            "head_score double, tail array<binary>, tail_n array<long>",
        ),
        "scored",
    )
    ranks = counts.filter(F.col("n") < least)
    ranks = stored(ranks.withColumn("form", F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS))), "tail")
    forms = ranks.groupBy("form").agg((F.sum("n") + F.count(F.lit(1)) + 1).alias("places"))
    places = F.lit(None).cast("double")
    for form, n in forms.collect():
        places = F.when(F.col("form") == form, F.lit(float(n))).otherwise(places)
    tails = parts.filter(F.size("tail") > 0).dropDuplicates(["row"]).select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t"))
    tails = tails.select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("k"))
    tails = tails.join(ranks.select("word", "n"), "word", "left")
    tails = tails.withColumn("form", F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS)))
    seen_n = F.coalesce("n", F.lit(0))
    sums = tails.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("known"),
        F.sum(F.col("k") * F.log10((seen_n + 1) / F.lit(space))).alias("base"),
        F.sum(F.col("k") * F.log10((seen_n + 1) / F.coalesce(places, F.lit(1.0)))).alias("more"),
    )
    joined = parts.drop("tail", "tail_n").join(sums, "row", "left")
    base = F.col("head_base") + F.coalesce("base", F.lit(0.0))
    score = F.col("head_score") + F.coalesce("more", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(train_tokens)).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (score if seen else base).alias("score"),
    )
