import random
import re

import pytest
from pyspark.sql import functions as F

from rolefit.functions import skills as sk
from rolefit.operators.skills import explode_skills, extract_skills
from rolefit.schemas import SCORES

CASES = [
    ("C++ and C# dev", ["c", "c#", "c++"]),
    ("R&D lead", ["r"]),
    ("Node.js, HTML5", ["html5", "node"]),
    ("JavaScript", ["javascript"]),
    ("MySQL/CI/CD", ["ci/cd", "mysql"]),
    ("machine  learning", []),
    ("machine\nlearning", []),
    ("Django REST Framework; REST APIs", ["django", "django rest framework"]),
    ("less is more, go!", ["go", "less"]),
    ("opéré r", ["r"]),
    ("Scikit-Learn", ["scikit-learn"]),
    ("github.com/x", ["github"]),
    ("", []),
]


def by_search(text, vocabulary):
    """The definition: the literal, with no letter or digit on either side."""
    lowered = text.lower()
    return sorted(
        s
        for s in set(vocabulary)
        if re.search("(?<![a-z0-9])" + re.escape(s) + "(?![a-z0-9])", lowered)
    )


def test_vocabulary():
    assert len(sk.DEFAULT_SKILLS) == len(set(sk.DEFAULT_SKILLS)) == 129


def test_default_vocabulary(values):
    assert values(sk.skills_in(F.col("v")), [c[0] for c in CASES]) == [c[1] for c in CASES]


@pytest.mark.parametrize("limit", [None, 0])
def test_vocabulary_table(spark, limit):
    texts = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "doc_id long, text string")
    vocabulary = spark.createDataFrame([(s,) for s in sk.DEFAULT_SKILLS], "skill string")
    got = extract_skills(texts, vocabulary, limit=limit).orderBy("doc_id").collect()
    assert [r.skills for r in got] == [c[1] for c in CASES]


@pytest.mark.parametrize("limit", [None, 0])
def test_hostile_vocabulary(spark, limit):
    vocabulary = [
        "c", "c++", "c#", ".net", "naïve", "a.b", "a b", "★", "++", "x(y)", "[z]", "$", "\\d",
        "a|b", "^", "b", "Upper", "é", "_", "-", "a-", "-a", "q*",
    ]
    rng = random.Random(5)
    pieces = vocabulary + ["asp", "net", "na", "ve", " ", ".", "\n", "C", "1", "ü", "Upper"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 8))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = spark.createDataFrame([(s,) for s in vocabulary + ["", None, "c"]], "skill string")
    got = {r.doc_id: r.skills for r in extract_skills(frame, words, limit=limit).collect()}
    assert got == {i: by_search(t, vocabulary) for i, t in enumerate(texts)}
    fixed = frame.select("doc_id", sk.skills_in(F.col("text"), vocabulary).alias("skills"))
    assert {r.doc_id: r.skills for r in fixed.collect()} == got


def test_match_is_a_partition_of_the_job(spark):
    frame = spark.createDataFrame(
        [(["c", "go", "sql"], ["sql", "c", "java"]), ([], ["c"]), (["c"], [])],
        "job array<string>, resume array<string>",
    )
    got = frame.select(
        sk.matched_skills(F.col("job"), F.col("resume")).alias("m"),
        sk.missing_skills(F.col("job"), F.col("resume")).alias("x"),
    ).collect()
    assert [(r.m, r.x) for r in got] == [(["c", "sql"], ["go"]), ([], []), ([], ["c"])]


def test_split_and_explode(spark, values):
    assert values(sk.split_skills(F.col("v")), ["a, b c", "", None, "x"]) == [
        ["a", "b c"], [], [], ["x"],
    ]
    scores = spark.createDataFrame(
        [(1, 1, 5, 50.0, "a, b", "c", "", None), (2, 2, 5, 0.0, "", "", "", None)], SCORES
    )
    assert sorted(map(tuple, explode_skills(scores).collect())) == [
        (1, 5, "a", "matched"), (1, 5, "b", "matched"), (1, 5, "c", "missing"),
    ]
