"""Alignment of tokens against overlaps found pair by pair."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rolefit.llm.alignment import Aligner, align_tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(3)
    words = "the naïve Straße 日本 C++ ci/cd 12345 don't UPPER x_y https://a.b/c ... Привет".split()
    line = lambda n: rng.choice([" ", "  ", "\n", " \t"]).join(rng.choice(words) for _ in range(n))
    odd = [None, "", " ", "\n", "a<|endoftext|>b </s> <0x41>", " \n\n  x\t y ▁z", "ß € 😀 日本語 \x00", "é ﬁ Ａ b"]
    odd += ["nospace" * 60, "nospace" * 60, "ab" * 40_000]
    return odd + [line(rng.randrange(1, 60)) for _ in range(60)]


def expected(rows):
    a_lib, b_lib = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    tokens = Aligner(BYTES, PIECES)
    spans, counts = [], Counter()
    for _, text in rows:
        if not text:
            spans.append(None)
            continue
        own, raw = [], (" " + text).encode()
        for ids, parts in ((a_lib.encode(" " + text, add_special_tokens=False).ids, tokens.bytes_a), (b_lib.encode(text), tokens.bytes_b)):
            place, found = 0, []
            for i in ids:
                found.append((place, place + len(parts[i]), i))
                place += len(parts[i])
            own.append(found if b"".join(parts[i] for i in ids) == raw else None)
        if None in own:
            spans.append(None)
            continue
        ends = sorted({e for _, e, _ in own[0]} & {e for _, e, _ in own[1]})
        groups, links, start, at = [], [], 0, [0, 0]
        for end in ends:
            pair = []
            for k in (0, 1):
                stop = at[k]
                while stop < len(own[k]) and own[k][stop][1] <= end:
                    stop += 1
                pair.append(own[k][at[k] : stop])
                at[k] = stop
            groups.append("|".join(",".join(str(i) for _, _, i in side) for side in pair))
            links += [(x[2], y[2]) for x in pair[0] for y in pair[1] if x[0] < y[1] and y[0] < x[1]]
            start = end
        assert start == len(raw)
        counts.update(links)
        spans.append((len(own[0]), len(own[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    for (key, _), found in zip(rows, spans, strict=True):
        if found is None:
            yield key, 0, 0, 0, 0, "", 0, 0
        else:
            n_a, n_b, n_groups, links, digest = found
            n_best = sum(counts[x] == best[x[1]] for x in links)
            yield key, n_a, n_b, n_groups, len(links), digest, n_best, sum(counts[x] for x in links)


@pytest.fixture(scope="module")
def rows():
    found = [(None if i == 20 else i // 2, t) for i, t in enumerate(texts())]
    return [*found, found[15], found[15]]


@pytest.mark.parametrize("chunk_bytes", [500, 8 << 20])
def test_equals_overlaps_pair_by_pair(spark, rows, chunk_bytes):
    wide = [(*r, "clash", 5) for r in rows]
    docs = spark.createDataFrame(wide, "doc_id long, text string, n_a string, lang int").repartition(4)
    got = align_tokens(docs, BYTES, PIECES, chunk_bytes=chunk_bytes)
    assert set(got.columns) == {"doc_id", "lang", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"}
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows), key=repr)


def test_groups_are_the_digested_ones(spark):
    docs = spark.createDataFrame([(1, "don't panic"), (2, None)], "doc_id long, text string")
    first, second = align_tokens(docs, BYTES, PIECES, keep_groups=True).orderBy("doc_id").collect()
    assert hashlib.sha256(first.groups.encode()).hexdigest() == first.groups_sha256
    a = [int(x) for g in first.groups.split(";") for x in g.split("|")[0].split(",")]
    assert Tokenizer.from_file(BYTES).decode(a) == " don't panic"
    assert second.groups == second.groups_sha256 == "" and second.n_links == second.count_sum == 0


def test_windows_are_remembered_and_forgotten():
    own = Aligner(BYTES, PIECES)
    (first,) = own.align(["one two one two three"])
    one, two, again, twice, three = first[3].tolist()
    assert (one, two) == (again, twice) and {one, two, three} == {0, 1, 2} == set(own.known.values())
    assert [f[3].tolist() for f in own.align(["one three two", "one"])] == [[one, three, two], [one]]
    assert len(own.known) == 3
    own.forget()
    assert own.align(["one two one two three"])[0][:3] == first[:3] and len(own.known) == 3


def test_equal_hashes_are_told_apart():
    own, plain = Aligner(BYTES, PIECES), Aligner(BYTES, PIECES)
    own._powers = lambda base, size: np.zeros(size, np.uint64)
    texts = ["one two three one", "three don't", "one"]
    assert [f[:3] for f in own.align(texts)] == [f[:3] for f in plain.align(texts)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokens(none, BYTES, PIECES).count() == 0
