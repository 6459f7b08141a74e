"""Mixing with texts: they wait in files once, and every row gets what its words give."""

import random
from collections import Counter

from pyspark.sql import functions as F

from rolefit.llm import mixing

FIELDS = "doc_id long, text string, source string, size string"


def test_texts_are_stored_once_and_rows_are_kept(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join("ab" for _ in range(rng.randrange(30))), rng.choice(["a", "b", None]), "x") for i in range(200)]
    rows += [(None, "one two", "a", "y"), (None, None, None, None), rows[7], rows[7], (7, "other words here", "b", "x")]
    docs = spark.createDataFrame(rows, FIELDS).repartition(5)
    kept = []
    store = mixing.stored

    def recorded(frame, label):
        kept.append("text" in frame.columns)
        return store(frame, label)

    monkeypatch.setattr(mixing, "stored", recorded)
    with_text = mixing.mix_sources(docs, keep_text=True)
    assert kept.count(True) == 1
    slim = mixing.mix_sources(docs)
    assert with_text.columns == ["doc_id", "text", "source", "size", "taken", "passes", "source_size", "target"]
    assert sorted(with_text.select("doc_id", "text", "source").collect(), key=repr) == sorted(
        docs.select("doc_id", "text", "source").collect(), key=repr
    )
    results = [f.select("doc_id", *slim.columns[2:]) for f in (with_text, slim)]
    assert sorted(results[0].collect(), key=repr) == sorted(results[1].collect(), key=repr)
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    assert with_text.filter(words != F.col("size")).isEmpty()


def test_pipeline_mixes_without_storing_texts(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, " ".join("ab" for _ in range(rng.randrange(30))), rng.choice(["a", "b", None]), "x") for i in range(200)]
    rows += [(None, "one two", "a", "y"), (None, "two ones", "a", "z"), (None, None, None, None), rows[7], rows[7]]
    docs = spark.createDataFrame(rows + [(7, "other words here", "b", "x")], FIELDS)
    kept = []
    store = mixing.stored

    def recorded(frame, label):
        kept.append("text" in frame.columns)
        return store(frame, label)

    monkeypatch.setattr(mixing, "stored", recorded)
    mixed = corpus_pipeline.mix_to_targets(spark, docs, "")
    assert kept and not any(kept)
    assert mixed.columns == docs.columns
    expected = Counter()
    for r in mixing.mix_sources(docs.select("doc_id", "text", "source")).filter("passes > 0").collect():
        expected[r.doc_id, r.source, r["size"]] += r.passes
    got = mixed.collect()
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in got) == expected
    assert {tuple(r) for r in got} <= set(map(tuple, docs.collect()))
