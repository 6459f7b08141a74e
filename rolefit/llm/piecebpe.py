"""Merge-type subword encoding by a table of every prefix's last piece, and decoding."""

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import whole

BLANK = "▁"
# Words that are remembered per Python worker, in each of two generations.
REMEMBERED = 600_000
LONGEST_REMEMBERED = 64


class PieceEncoder:
    """Encodes as the library does with a BPE model that has byte fallback and no text rules.

    For every prefix of a word exactly one piece can be the last of its encoding: a piece that ends
    there and is compatible with the last piece of the prefix before it, that is, merging the
    characters of both gives the two again. The automaton lists the pieces that end at a position;
    ids are read backwards from the end of the table. No piece has a blank after another character
    and none crosses a character outside the vocabulary, so words are independent.

    Several pieces of blanks only share one score and then merge by position, which the table cannot
    tell; words that begin with two blanks or more are merged step by step.
    """

    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.library.get_piece_size()
        plain = [
            i
            for i in range(size)
            if not (
                self.library.is_control(i)
                or self.library.is_unknown(i)
                or self.library.is_byte(i)
                or self.library.is_unused(i)
            )
        ]
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        self.scores = {piece: self.library.get_score(i) for piece, i in self.ids.items()}
        for piece in self.ids:
            if BLANK in piece.lstrip(BLANK) or "\n" in piece:
                raise ValueError("pieces that cross words are not supported")
        spec = self.library.encode("a  b ")
        if self.library.decode(spec) != "a  b ":
            raise ValueError("models that rewrite white space are not supported")
        coded = lambda i: np.array([i], "<u4").tobytes()
        self.coded = {piece: coded(i) for piece, i in self.ids.items()}
        self.bytes = [coded(self.library.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 and self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # Marks that follow nothing but blanks and themselves in a piece: a word can be cut before them.
        inner = {b for piece in self.ids for a, b in zip(piece, piece[1:], strict=False) if a not in (BLANK, b)}
        marks = re.escape("".join(c for c in ".,;:!?|&" if c not in inner))
        mark, other = (f"[{marks}]+", f"[^ \n{marks}]") if marks else ("(?!)", "[^ \n]")
        self.words = re.compile(f" *{other}+| *{mark}{other}*| +|\n+")
        self.begin, self.end = coded(self.library.bos_id()), coded(self.library.eos_id())

    def merged(self, word: str) -> list[str]:
        """Merge the best-scored pair, the leftmost of equals, until none is a piece."""
        parts: list[str | None] = list(word)
        after, before = [*range(1, len(parts) + 1)], [*range(-1, len(parts) - 1)]
        queue = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(parts):
                both = parts[left] + parts[right]
                if (score := self.scores.get(both)) is not None:
                    queue.append((-score, left, both))

        for i in range(len(parts) - 1):
            offer(i)
        heapify(queue)
        waiting, queue = queue, []
        while waiting:
            _, left, both = heappop(waiting)
            if parts[left] is None or after[left] >= len(parts):
                continue
            right = after[left]
            if parts[left] + parts[right] != both:
                continue
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            for i in (left, before[left]):
                if i >= 0:
                    offer(i)
            while queue:
                heappush(waiting, queue.pop())
        return [p for p in parts if p is not None]

    def compatible(self, left: str, right: str) -> bool:
        pair = (left, right)
        if (known := self.pairs.get(pair)) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[pair] = not self.crosses(left, right)
        return known

    def crosses(self, left: str, right: str) -> bool:
        """Whether merging the characters of both does not give the two again."""
        parts, bound, scores = [*left, *right], len(left), self.scores
        gains = [scores.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, gain in enumerate(gains):
                if gain is not None and (best is None or gain > best):
                    best, at = gain, i
            if at < 0:
                return parts != [left, right]
            if at == bound - 1:
                return True
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at < bound:
                bound -= 1
            if at:
                gains[at - 1] = scores.get(parts[at - 1] + parts[at])
            if at < len(gains):
                gains[at] = scores.get(parts[at] + parts[at + 1])

    def pieces(self, word: str) -> list[str]:
        """The encoding of a word, read backwards from the table of last pieces."""
        last, done, pairs = [*word], -1, self.pairs
        for end, (piece, size) in self.automaton.iter(word):
            if end == done:
                continue
            start = end - size
            if start >= 0:
                fits = pairs.get((last[start], piece))
                if fits is None:
                    fits = self.compatible(last[start], piece)
                if not fits:
                    continue
            last[end] = piece
            done = end
        out, at = [], len(word) - 1
        while at >= 0:
            piece = last[at]
            out.append(piece)
            at -= len(piece)
        out.reverse()
        return out

    def ids_of(self, word: str) -> bytes:
        """Ids of a word that is not among the young; it is remembered unless it is long."""
        known = self.old.get(word)
        if known is None:
            marked = word.replace(" ", BLANK)
            parts = self.merged(marked) if word.startswith("  ") else self.pieces(marked)
            coded = self.coded
            known = b"".join(
                [
                    coded[p] if p in coded else b"".join([self.bytes[b] for b in p.encode()])
                    for p in parts
                ]
            )
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = known
        return known

    def forget(self) -> None:
        """Drop the words and pairs that are remembered."""
        self.pairs, self.young, self.old = {}, {}, {}

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.begin + self.end
        words = self.words.findall(" " + text.replace(BLANK, " "))
        get, of = self.young.get, self.ids_of
        found = [get(word) or of(word) for word in words]
        return b"".join((self.begin, *found, self.end))

    def decode(self, ids: list[bytes]) -> list[str]:
        return [self.library.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]


_encoders: dict[str, PieceEncoder] = {}


def encoder(model: str) -> PieceEncoder:
    """One encoder per Python worker and model."""
    if model not in _encoders:
        _encoders[model] = PieceEncoder(model)
    return _encoders[model]


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Encode and decode every row of ``docs``: adds ``ids`` (binary, little-endian unsigned 32-bit) and
    ``decoded``; the text column is dropped, all others pass.

    Ids have begin and end. A null text is empty: begin and end only. Rows are independent, so
    repeated rows, null ids and empty tables need no rule, and nothing is shuffled. Columns named
    ``ids`` or ``decoded`` are replaced.
    """
    kept = docs.drop("ids", "decoded").withColumn("_text", whole(text)).drop(text)
    schema = kept.drop("_text").schema.add("ids", "binary").add("decoded", "string")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        try:
            for large in batches:
                for start in range(0, large.num_rows, 500):
                    batch = large.slice(start, 500)
                    ids = [own.encode(t.as_py()) for t in batch.column("_text")]
                    columns = [batch.column(n) for n in batch.schema.names if n != "_text"]
                    names = [n for n in batch.schema.names if n != "_text"]
                    columns += [pa.array(ids, pa.binary()), pa.array(own.decode(ids), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", "decoded"])
        finally:
            # The worker waits for other tasks, also of later steps, and holds no words meanwhile.
            own.forget()

    return kept.mapInArrow(encoded, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of encoded rows."""
    return encoded.withColumns(
        {
            "n_tokens": (F.length("ids") / 4).cast("bigint"),
            "ids_sha256": F.sha2("ids", 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("ids", "decoded")
