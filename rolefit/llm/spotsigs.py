"""SpotSigs: signatures of content words that follow common words, and their Jaccard likeness."""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import whole
from rolefit.llm.shingles import SLICE_BYTES, mixed, word_hashes

CHAIN = 2
# Anchors: common words of English, French, German and Spanish.
ANCHORS = (
    "the a an of and to in is that for it was on be with as by this are at from "
    "le la les de des du un une et est que dans pour par sur avec en au qui pas "
    "der die das und den von zu mit sich auf ist im ein eine für dem nicht "
    "el los las del una y es se por con para al"
).split()
# Ranges of ids that go to one place together; only their bounds are known to all.
MOST_RANGES = 4096
TOKEN = np.uint64(0x9FB21C651E98DF25)


def _anchor_hashes() -> np.ndarray:
    return np.unique(word_hashes([" ".join(ANCHORS).encode()])[0])


def spot_signatures(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text.

    At every anchor the next CHAIN words that are no anchors give one. A text without any gets the
    pairs of neighbouring words instead, or its only word; a text without words has none.
    """
    anchors = _anchor_hashes()
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < SLICE_BYTES):
            part.append(texts[at].encode())
            size += len(part[-1])
            at += 1
        words, owner = word_hashes(part, marks=True)
        anchor = np.isin(words, anchors)
        content = np.flatnonzero(~anchor)
        spots = np.flatnonzero(anchor)
        first = np.searchsorted(content, spots)
        fits = first + CHAIN <= len(content)
        spots, first = spots[fits], first[fits]
        fits = owner[content[first + CHAIN - 1]] == owner[spots] if len(spots) else fits[:0]
        spots, first = spots[fits], first[fits]
        chained = words[spots]
        for k in range(CHAIN):
            chained = chained * TOKEN + words[content[first + k]]
        signed = (mixed(chained) >> np.uint64(32)).astype(np.uint32)
        bounds = np.searchsorted(owner[spots], np.arange(len(part) + 1))
        ends = np.searchsorted(owner, np.arange(len(part) + 1))
        for d in range(len(part)):
            found = signed[bounds[d] : bounds[d + 1]]
            if not len(found) and ends[d + 1] > ends[d]:
                own = words[ends[d] : ends[d + 1]]
                pairs = own[:-1] * TOKEN + own[1:] if len(own) > 1 else own
                found = (mixed(pairs) >> np.uint64(32)).astype(np.uint32)
            yield np.unique(found)


def fingerprint(signatures: np.ndarray) -> str:
    """A signature set as text: base64 of the sorted numbers, least byte first."""
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 at once if their lengths alone keep it below ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last third replaced by the beginning of another text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _placed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``range, last, order, id, text``: every document in its range of descending ids, and the first
    document of a range also at the end of the range before (of the last one, for the first).

    What all tasks know is the bounds of MOST_RANGES ranges at most.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(1 << 63))).alias("order"),
        whole(text).alias("text"),
    )
    wanted = min(MOST_RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / wanted for k in range(1, wanted)]
    bounds = rows.agg(F.percentile_approx("order", shares, 10 * wanted)).first()[0] or []
    bounds = F.array(*(F.lit(b) for b in sorted(set(bounds)))).cast("array<bigint>")
    number = F.size(F.filter(bounds, lambda b: b >= F.col("order")))
    rows = rows.withColumn("range", number)
    firsts = rows.groupBy("range").agg(F.max("order").alias("first")).orderBy("range").collect()
    if not firsts:
        return rows.withColumn("last", F.lit(False))
    before = {row["first"]: firsts[k - 1]["range"] for k, row in enumerate(firsts)}
    pairs = [x for first, r in before.items() for x in (F.lit(first), F.lit(r))]
    also = F.create_map(*pairs)[F.col("order")]
    own = F.struct(F.col("range"), F.lit(False).alias("last"))
    sent = F.struct(also.alias("range"), F.lit(True).alias("last"))
    places = F.when(also.isNull(), F.array(own)).otherwise(F.array(own, sent))
    return rows.withColumn("place", F.explode(places)).select("id", "order", "text", "place.range", "place.last")


def spot_fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document, of its edited text, and the likeness of both and of the next.

    Returns ``id_column, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next,
    n_signatures``. The next document is the one with the next lower id (after the last, the first);
    the edited text has its last third replaced by the beginning of the next. Equal ids are ordered
    by a hash of their texts, null ids come last. A null text is empty; two empty fingerprints have
    likeness 1. A single document is its own next; an empty table gives an empty result. Other
    columns are not looked at. Texts are moved once.
    """
    placed = _placed(docs, id_column, text).withColumn("hash", F.xxhash64("text"))
    placed = placed.repartition("range").sortWithinPartitions("range", "last", F.desc("order"), "hash")
    kind = docs.schema[id_column].dataType.simpleString()
    kind = {"bigint": "long"}.get(kind, kind)
    schema = (
        f"{id_column} {kind}, n_chars long, edited_text string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double, n_signatures long"
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for large in batches:
            for start in range(0, large.num_rows, 400):
                table = pa.Table.from_batches([large.slice(start, 400)])
                table = pa.concat_tables([rest, table]) if rest is not None else table
                rest = table.slice(table.num_rows - 1)
                if table.num_rows < 2:
                    continue
                texts = table.column("text").to_pylist()
                ranges = table.column("range").to_pylist()
                last = table.column("last").to_pylist()
                ids = table.column("id").to_pylist()
                has = [k for k in range(len(texts) - 1) if not last[k] and ranges[k] == ranges[k + 1]]
                changed = [edited(texts[k], texts[k + 1]) for k in has]
                own = [*spot_signatures(texts)]
                new = [*spot_signatures(changed)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in has], table.column("id").type),
                        pa.array([len(texts[k]) for k in has], pa.int64()),
                        pa.array(changed, pa.string()),
                        pa.array([fingerprint(own[k]) for k in has], pa.string()),
                        pa.array([fingerprint(x) for x in new], pa.string()),
                        pa.array([likeness(own[k], x) for k, x in zip(has, new, strict=True)], pa.float64()),
                        pa.array([likeness(own[k], own[k + 1]) for k in has], pa.float64()),
                        pa.array([len(own[k]) for k in has], pa.int64()),
                    ],
                    names=[
                        id_column, "n_chars", "edited_text", "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next", "n_signatures",
                    ],
                )

    return placed.select("id", "text", "range", "last").mapInArrow(compared, schema)
