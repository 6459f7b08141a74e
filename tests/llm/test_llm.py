"""Operators of the llm package against brute force on small tables with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolefit.llm import jaccardjoin, linededup, mixing, oracles, quality, spotsigs, suffixdedup, surrogates, tokenfiles
from rolefit.llm import maxent, piecebpe
from rolefit.llm.maxent import score_texts
from rolefit.llm.piecebpe import PieceEncoder, digests, encode_pieces
from rolefit.llm.suffixes import suffix_array
from rolefit.session import scratch_path

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, size string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(7)
    words = [a + b for a in "ka lo mi su te von der the of and".split() for b in " ra ne to.".split(" ")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = line(60)
    texts: list[str | None] = [None, "", " \n\t ", "eins", "zwei drei vier", "\x00 a\x0bb", "ß € 😀 日本語 ▁▁  x"]
    base = "\n".join(line(12) for _ in range(12))
    texts += [base, base, base.replace("ka", "KA"), base + "\n" + line(9)]
    texts += [line(20) + "\n" + passage + "\n" + line(15) for _ in range(3)]
    texts += [" ".join(["same"] * 300), "ab" * 700, line(4000), passage.upper()]
    texts += ["\n".join(line(rng.randrange(1, 14)) for _ in range(rng.randrange(1, 9))) for _ in range(20)]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), "clash") for i, t in enumerate(texts)]
    return [*rows, rows[8]]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, FIELDS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def words_of(text):
    return (text or "").encode().lower().split()


def test_surrogates(spark, none):
    texts = [
        "Mr. Adam Smith wrote to ann.lee@mail3.example.com from 81.92.62.158.",
        "ANN.LEE@MAIL3.EXAMPLE.COM has card 4111 1111 1111 1111, phone +1 (704) 555-7114 or +17045557114",
        'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" and Frau Müller, г-жа Иванова',
        "nothing here, 12 apples", None, "",
    ]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "y")], "doc_id long, text string, entities string")
    found = sorted(surrogates.replace_personal_data(frame, "key").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [len(r.entities) for r in found] == [3, 4, 3, 0, 0, 0, 3]
    assert found[3].text == texts[3] and found[4].text is None and found[6].text == found[0].text
    mail = found[0].entities[1].surrogate
    assert found[1].text.startswith(mail.upper() + " has card ")
    card, first, second = (e.surrogate for e in found[1].entities[1:])
    assert card[4] == " " and card[0] == "4" and "".join(c for c in first if c.isdigit()) == second[1:]
    digits = [int(c) for c in card if c.isdigit()][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    name = found[0].entities[0].surrogate.split()
    assert name[0] == "Mr." and name[1] in surrogates.NAMES["m", "latin"]
    assert found[2].entities[2].surrogate.split()[1][0] in "БВГДЁЖЗИКЛМН"
    many = spark.createDataFrame([("name", f"Mr {a}{b}") for a in "ABCDEFGHIJ" for b in "abcdefghijklmnopqrst"], "kind string, canon string")
    given = [r.surrogate for r in surrogates.assigned(many, "key").collect()]
    assert len(given) == len(set(given)) == 200
    assert surrogates.replace_personal_data(none, "key").count() == 0


def test_names_of_one_person(spark):
    texts = [
        "Mr Smith met Dr. Smith. Mr. Smith is Mr. Adam Smith, and Dr. Adam Smith too. Then Smith left; Adam Smith's dog and Adam stayed.",
        "Ms. Eve Smith and Prof. Dr. Keller saw Smithers. Smith@mail3.example.com, Adam Smith@mail3.example.com",
        "Dr. Eve Smith wrote. Smithers and Adam have no title here.",
    ]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    a, b, c = (r.text for r in surrogates.replace_personal_data(frame, "key").orderBy("doc_id").collect())
    family = a.split()[1]
    given = a.split(" is Mr. ")[1].split()[0]
    assert family not in ("Smith", "Adam") and given in surrogates.NAMES["m", "latin"]
    assert a == texts[0].replace("Smith", family).replace("Adam", given)
    eve = b.split()[1]
    assert eve in surrogates.NAMES["f", "latin"] and b.split()[2] == family
    assert b.split()[4:6] == ["Prof.", "Dr."] and "Keller" not in b and " saw Smithers. " in b
    assert "Smith@" not in b and b.count(".example.org") == 2
    assert c == texts[2].replace("Eve Smith", f"{eve} {family}")


def test_detected_forms(spark):
    value = "kQzWvBnMxYpLrTdG"
    labelled = ["Password: {}", "API_KEY={}", "TOKEN={}", "client_secret_key = {}", '"api_key": "{}"', "env['Token'] = '{}'", "apiKey: {}", "secret => {}"]
    texts = [x.format(value) for x in labelled]
    texts += ["see AKIA" + value.upper() + " here", "ghp_" + value, "gho_" + value, "sk-" + value]
    plain = ["Secretary: Konstantinopel", "the tokenizer: straightforward", "a token of appreciation"]
    mails = ["jürgen.groß@mail3.example.com", "иван@mail3.example.com", "MÜLLER@MAIL3.EXAMPLE.COM", "anna@müller.de"]
    frame = spark.createDataFrame([*enumerate(texts + plain + mails)], "doc_id long, text string")
    got = surrogates.replace_personal_data(frame, "key").orderBy("doc_id").collect()
    for r, old in zip(got, texts, strict=False):
        assert [e.kind for e in r.entities] == ["secret"] and value not in r.text and value.upper() not in r.text, r
        assert len(r.text) == len(old)
    assert [r.text for r in got[len(texts) : -4]] == plain
    for r, old in zip(got[-4:], mails, strict=True):
        assert [e.kind for e in r.entities] == ["email"] and r.text == (r.entities[0].surrogate)
        assert r.text.lower().endswith(".example.org") and r.text.split("@")[0] != old.split("@")[0] and r.text.isascii()


def test_token_files(spark, docs, rows, none):
    path = scratch_path(spark, "tokens")
    tokenfiles.write_tokens(docs, path, BYTES)
    library = Tokenizer.from_file(BYTES)
    want, start = [], 0
    for i, text in sorted((r[0], r[1] or "") for r in rows):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokenfiles.token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want
    assert sorted(r.start for r in tokenfiles.with_starts(spark, path).collect()) == [w[1] for w in want]
    counts = tokenfiles.read_tokens(spark, path).filter("doc_id = 9").select("n_tokens")
    plan = counts._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1] and "EqualTo(doc_id,9)" in plan
    empty = scratch_path(spark, "tokens")
    tokenfiles.write_tokens(none, empty, BYTES)


def test_special_tokens_and_white_space():
    encoder, rng = tokenfiles.TextEncoder(BYTES), random.Random(2)
    parts = ["a", " ", "  ", "\n", "é", "日", "\x1c", "\x85", "<|endoftext|>", "'s", "12", "!!", "...", "\t", "_", "Ω"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(2000)]
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == want


def test_stretches_are_looked_up_once_a_slice(monkeypatch):
    encoder, rng, seen = tokenfiles.TextEncoder(BYTES, remembered=50), random.Random(4), []
    known = encoder.known
    monkeypatch.setattr(encoder, "known", lambda stretches: seen.append(stretches) or known(stretches))
    monkeypatch.setattr(tokenfiles, "SLICE_CHARS", 300)
    parts = ["a", "ab", " ", "\n", "é", "😀", "Straße", "'s", "12", "!!", "_", "²", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]
    # A special token where two texts meet is none; white space of other kinds sends its text as a whole.
    texts += ["", "a <|endof", "text|> b", "a\u2003b", "", "same same\n" * 200, "<|endoftext|>"]
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == want
    assert all(len(set(stretches)) == len(stretches) for stretches in seen)
    assert len(seen) < len(texts) and [b"same", b" same", b"\nsame", b"\n"] in seen


def test_pieces(docs, rows, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())] += 1
    got = digests(encode_pieces(docs, PIECES)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(tuple(r) for r in got.collect()) == want
    assert encode_pieces(none, PIECES).count() == 0
    encoder, rng = PieceEncoder(PIECES), random.Random(3)
    parts = ["a", " ", "  ", "\n", "▁", "é", "日", "the", "tion", "<s>", " " * 11, " " * 17, "1", "...", "ing"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_a_task_of_pieces_leaves_no_words_behind(spark, monkeypatch):
    rows = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, made, schema: made)
    task, batch = encode_pieces(rows, PIECES), pa.RecordBatch.from_pydict({"doc_id": [1, 2], "_text": ["one two", "in  on"]})
    encoder, made = piecebpe.encoder(PIECES), task(iter([batch, batch]))
    assert next(made).num_rows == 2 and encoder.young
    assert sum(b.num_rows for b in made) == 2
    assert not (encoder.young or encoder.old or encoder.pairs)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        text = np.append(rng.integers(1, rng.integers(2, 6), n), 0)
        assert suffix_array(text, 6).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(docs, rows, none, hot, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT_STRETCHES", hot)
    places = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        places.update(raw[p : p + 200] for p in range(len(raw) - 199))
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 199):
            if places[raw[p : p + 200]] > 1:
                gone[p : p + 200] = b"\x01" * 200
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        want[r[0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffixdedup.remove_repeats(docs).collect()) == want
    assert suffixdedup.remove_repeats(none).count() == 0


def brute_components(rows):
    sets = {}
    for r in rows:
        w = words_of(r[1])
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    found = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and found[a] < found[b]:
                    found[b], changed = found[a], True
    return {(i, len(sets[i]), found[i]) for i in sets}


@pytest.mark.parametrize("paired", [12, 1])
def test_jaccard_join(spark, docs, rows, none, paired, monkeypatch):
    monkeypatch.setattr(jaccardjoin, "PAIRED", paired)
    monkeypatch.setattr(jaccardjoin, "TILE", 3)
    monkeypatch.setattr(jaccardjoin, "TILE_SHINGLES", 500)
    monkeypatch.setattr(jaccardjoin, "PARTNERS", 2)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    near = []
    for i in range(40):
        words = base.copy()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        near.append((100 + i, " ".join(words), None, None, None, None))
    # One passage in texts of many sizes: a key of many sets, few of them linked.
    for i in range(60):
        words = base[:30] + [f"y{rng.randrange(40)}" for _ in range(rng.randrange(1, 25))]
        near.append((200 + i, " ".join(words), None, None, None, None))
    frame = docs.union(spark.createDataFrame(near, FIELDS))
    got = {tuple(r) for r in jaccardjoin.jaccard_components(frame).collect()}
    assert got == brute_components([*rows, *near])
    assert jaccardjoin.jaccard_components(none).count() == 0


def test_shared_keys(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3, *range(10, 200)]), rng.randrange(50), 1) for _ in range(600)]
    rows = [(k, s, 100 + s % 7) for k, s, _ in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        frame = spark.createDataFrame(rows, "key long, set_id long, n long")
        found = jaccardjoin.shared_keys(frame).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sets = defaultdict(set)
    for k, s, n in rows:
        sets[k].add((n, s))
    got = Counter((r.key, r.set_id, r.n) for r in found)
    assert {(k, s, n) for k in sets if len(sets[k]) > 1 for n, s in sets[k]} <= set(got)
    assert set(got) <= set(rows) and max(got.values()) == 1
    for r in found:
        before = (r.before_n, r.before)
        assert before == (None, None) or (before in sets[r.key] and before < (r.n, r.set_id))
    # Only the first set of a key, or of a task's piece of it, has none before.
    assert sum(r.before is None for r in found) <= len({r.key for r in found}) + 8


def test_language_model(docs, rows, none):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r[0]) for w in [*words_of(r[1]), b""])
    n, v = sum(counts.values()), len(counts)
    for r in score_texts(docs).collect():
        words = [*words_of(dict((x[0], x[1]) for x in rows)[r.doc_id]), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert abs(base - r.base_score) < 1e-6 * max(1, -base) and r.score < 0
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(words), n)
        assert r.n_known == sum(counts[w] > 0 for w in words)
    assert score_texts(none).count() == 0


@pytest.mark.parametrize("head", [40, 1 << 16])
def test_probabilities_token_by_token(spark, docs, rows, head, monkeypatch):
    """The score from the weights, one token after the other; probabilities of the next word sum to one."""
    monkeypatch.setattr(maxent, "HEAD", head)
    texts = [r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = Counter(w for t in texts for w in [*words_of(t), b""])
    table = spark.createDataFrame([*counts.items()], "word binary, n long")
    least = maxent.least_head_count(table)
    top = sorted((-n, w) for w, n in counts.items() if n >= least)
    assert len(top) <= head and (len(top) == len(counts) or head == 40)
    vocabulary = maxent.Vocabulary([w for _, w in top], np.array([-n for n, _ in top], np.int64))
    shared = spark.sparkContext.broadcast(vocabulary)
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    bias, skip, own = maxent.trained(maxent.stored(maxent.context_counts(training, "text", shared), "contexts"))

    def class_of(word):
        return int(vocabulary.classes[vocabulary[word]])

    def classes_after(before, two_before):
        """Softmax over the sums of weights, in plain Python; None stands for no word."""
        bucket = 0 if before is None else int(vocabulary.before[vocabulary[before]])
        far = maxent.CLASSES if two_before is None else class_of(two_before)
        block, row = divmod(bucket, maxent.IN_BLOCK)
        weights = maxent.Weights(bias, skip, own.get(block))
        pair = maxent.PAIR_OF[row * (maxent.CLASSES + 1) + far]
        sums = [
            bias[c] + skip[far][c] + weights.before[row][c] + weights.pairs[pair][c] for c in range(maxent.CLASSES)
        ]
        whole_sum = math.log(sum(math.exp(x - max(sums)) for x in sums)) + max(sums)
        return [math.exp(x - whole_sum) for x in sums]

    members = defaultdict(list)
    for word, n in counts.items():
        members[class_of(word)].append((word, n))

    def in_class(word):
        of = members[class_of(word)]
        if vocabulary[word] < len(top):
            return counts[word] / sum(n for _, n in of)
        return (counts[word] + 1) / (sum(n + 1 for _, n in of) + 1)

    for r in score_texts(docs).collect():
        words = [*words_of(dict((x[0], x[1]) for x in rows)[r.doc_id]), b""]
        total, past = 0.0, [None, None]
        for word in words[:300]:
            total += math.log10(classes_after(past[1], past[0])[class_of(word)] * in_class(word))
            past = [past[1], word]
        if len(words) <= 300:
            assert abs(total - r.score) < 1e-4 * max(1, -total)
    for before, two_before in ((None, None), (b"of", None), (b"vier", b"zwei"), (b"of", b"the")):
        chances = classes_after(before, two_before)
        known = sum(chances[class_of(w)] * in_class(w) for w in counts)
        # What is left belongs to words never seen, and to classes without a word.
        unseen = sum(
            p if not members[c] else p / (sum(n + 1 for _, n in members[c]) + 1) if c > maxent.END_CLASS else 0.0
            for c, p in enumerate(chances)
        )
        assert abs(known + unseen - 1) < 1e-9


def test_fingerprints(spark, docs, rows, none):
    found = defaultdict(set)
    ordered = sorted({(r[0], r[1] or "") for r in rows}, reverse=True)
    follower = {a[0]: b[1] for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True)}
    for r in spotsigs.spot_fingerprints(docs.dropDuplicates(["doc_id"])).collect():
        text = dict(ordered)[r.doc_id]
        third = len(text) // 3
        assert r.edited_text == text[: len(text) - third] + follower[r.doc_id][:third]
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1
        found[text].add(r.fingerprint)
    assert all(len(f) == 1 for f in found.values())
    assert spotsigs.spot_fingerprints(none).count() == 0
    assert spotsigs.spot_fingerprints(docs.filter("doc_id = 9")).first().near_next == 1.0


def test_line_dedup(docs, rows, none):
    once = sorted({(r[0], r[1]) for r in rows})
    lines = {i: [(k, x.strip(" \t\n\v\f\r")) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")] for i, t in once}
    seen, gone = set(), defaultdict(set)
    for i, _ in once:
        for p in range(len(lines[i])):
            size, q = 0, p
            while q < len(lines[i]) and size < linededup.MIN_RUN_WORDS:
                size += len(lines[i][q][1].encode().split())
                q += 1
            run = tuple(x for _, x in lines[i][p:q])
            if size < linededup.MIN_RUN_WORDS:
                continue
            if run in seen:
                gone[i].update(k for k, _ in lines[i][p:q])
            seen.add(run)
    for r in linededup.line_dedup(docs).collect():
        kept = None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id])
        assert (r.clean_text, r.n_lines, r.n_deleted) == (kept, len(lines[r.doc_id]), len(gone[r.doc_id])), r.doc_id
    assert linededup.line_dedup(none).count() == 0


def test_quality_rules(spark, docs, rows, none):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows) and {r.size for r in got} == {"clash"}
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        words = (text[r.doc_id] or "").encode().split()
        at = defaultdict(list)
        for p in range(len(words) - 4):
            at[tuple(words[p : p + 5])].append(p)
        repeat = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(5)}
        assert (r.n_words, r.n_repeat_words) == (len(words), len(repeat))
        assert r.base_failed == (len(words) < 10 or 100 * len(repeat) > 20 * len(words))
    notice = "all rights reserved by the owners of this fine site 2024"
    rng = random.Random(4)
    bodies = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30)) for _ in range(40)]
    body = bodies.__getitem__
    shared = [(i, f"{notice}\n{body(i)}" if i else notice, "h") for i in range(40)]
    judged = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(shared, "doc_id long, text string, source string"), with_text=True).collect()}
    assert not judged[0].kept and judged[1].kept and judged[1].clean_text == body(1)
    assert quality.quality_rules(none).count() == 0


def test_template_pages(spark):
    """Pages of one template count each: with only digits apart, and with one line of their own."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    template = [" ".join(word() for _ in range(8)) for _ in range(50)]
    rows = [(i, "\n".join(f"{line} {100 + i}" for line in template), "digits") for i in range(200)]
    rows += [(1000 + i, "\n".join([*template, word() + " " + word()]), "own") for i in range(400)]
    rows += [(2000 + i, "\n".join(" ".join(word() for _ in range(8)) for _ in range(5)), h) for h in ("digits", "own") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.quality_rules(frame).collect()
    with duckdb.connect() as base:
        base.register("documents", frame.withColumn("lang", F.lit(None).cast("string")).toPandas())
        stated = {r[0]: r[1:] for r in base.execute(f"SELECT doc_id, kept, n_common_words FROM ({oracles.QUALITY})").fetchall()}
    assert stated == {r.doc_id: (r.kept, r.n_common_words) for r in got}
    for r in got:
        assert not r.base_failed
        assert r.kept == (r.doc_id >= 2000), r
        assert r.n_common_words == (450 if r.source == "digits" else 400) * (r.doc_id < 2000)


def test_mixing(docs, rows, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 0.02 * sum(sizes.values()) for s in target)
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix_sources(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id for r in frame.select("doc_id").collect()}
        frame = stage(spark, frame, sf_dir)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r.doc_id for r in frame.select("doc_id").collect()}
        assert kept and kept <= before
    left = {r.doc_id: r.text for r in frame.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in final} == set(left)
    for r in final:
        ids = library.encode(left[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and np.frombuffer(r.piece_ids, "<u4").tolist() == ids
