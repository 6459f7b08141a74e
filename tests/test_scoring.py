import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolefit.functions import scores as sc
from rolefit.functions.skills import DEFAULT_SKILLS
from rolefit.functions.text import default_stop_words
from rolefit.operators import scoring, similarity
from rolefit.schemas import JOBS, RESUMES
from tests.test_skills import by_search

STOPS = set(default_stop_words())
WORDS = (
    "python sql c++ machine learning go less the and über naïve 数据 数据库 x_y data-science "
    "R&D deep learning docker ci/cd node.js 42 7 team experience ünï"
).split(" ")


def round2(value):
    """Rounding of NumPy floats, which the scores are defined with."""
    return float(np.round(np.float64(value), 2))


def by_definition(a, b):
    """Two-document TF-IDF: raw counts, smooth idf, unit length, dot product."""
    counts = [
        Counter(t for t in re.findall(r"\b\w\w+\b", text.lower()) if t not in STOPS)
        for text in (a, b)
    ]
    if not counts[0] and not counts[1]:
        return None
    if not counts[0] or not counts[1]:
        return 0.0
    vectors = []
    for own, other in (counts, counts[::-1]):
        weights = {
            t: n * (math.log(3 / (1 + (1 + (t in other)))) + 1) for t, n in own.items()
        }
        length = math.sqrt(sum(w * w for w in weights.values()))
        vectors.append({t: w / length for t, w in weights.items()})
    cosine = sum(w * vectors[1].get(t, 0.0) for t, w in vectors[0].items())
    return round2(max(0.0, cosine) * 100)


def pair_score(resume, job):
    """Score, matched and missing skills of one pair."""
    if not resume or not job:
        return 0.0, [], []
    wanted = by_search(job, DEFAULT_SKILLS)
    if not wanted:
        return 0.0, [], []
    shown = set(by_search(resume, DEFAULT_SKILLS))
    matched = [s for s in wanted if s in shown]
    keyword = len(matched) / len(wanted) * 100
    tfidf = by_definition(resume, job)
    score = round2(keyword if tfidf is None else keyword * 0.5 + tfidf * 0.5)
    return score, matched, [s for s in wanted if s not in shown]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)

    def text(longest):
        return " ".join(rng.choices(WORDS, k=rng.randint(0, longest)))

    jobs = [
        (0, "C, R"), (1, "python sql"), (2, "friendly colleague"), (3, ""), (4, "go less"),
    ] + [(i, text(12)) for i in range(5, 12)]
    resumes = [
        (0, 0, "C"), (1, 0, "C python"), (2, 1, "python sql"), (3, 1, ""), (4, 2, "python"),
        (5, 3, "python"), (6, 4, "the go"), (7, 1, None), (8, 0, "!!"),
    ] + [(i, rng.randrange(12), text(25)) for i in range(9, 120)]
    job_frame = spark.createDataFrame([(i, f"Job {i}", t, None) for i, t in jobs], JOBS)
    resume_frame = spark.createDataFrame(
        [(c, j, f"{c}.pdf", t, None) for c, j, t in resumes], RESUMES
    )
    vocabulary = spark.createDataFrame([(s,) for s in DEFAULT_SKILLS], "skill string")
    return dict(jobs), resumes, job_frame, resume_frame, vocabulary


def test_stop_words():
    assert len(default_stop_words()) == len(STOPS) == 318


def test_term_frequencies(spark):
    texts = ["", "the and", "Data data_x x DATA über", "a1 a1 b", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, similarity.term_frequencies(frame).collect()))
    assert got == [(2, "data", 2), (2, "data_x", 1), (2, "über", 1), (3, "a1", 2)]


def test_tfidf_applied(corpus):
    jobs, resumes, job_frame, resume_frame, _ = corpus
    got = {
        r.candidate_id: r.tfidf
        for r in similarity.tfidf_applied(resume_frame, job_frame).collect()
    }
    assert got == {c: by_definition(t or "", jobs[j]) for c, j, t in resumes}


@pytest.mark.parametrize("limit", [None, 0])
def test_tfidf_all_pairs(corpus, limit, monkeypatch):
    jobs, resumes, job_frame, resume_frame, _ = corpus
    if limit is not None:
        force_salt(monkeypatch)
    got = {
        (r.candidate_id, r.job_id): r.tfidf
        for r in similarity.tfidf_all_pairs(resume_frame, job_frame).collect()
    }
    for c, _, text in resumes:
        for j, wanted in jobs.items():
            assert got.get((c, j), 0.0) == (by_definition(text or "", wanted) or 0.0)


PAIRS = [(c, j) for c in range(9) for j in range(5)] + [(1, 1), (999, 0), (0, 999), (None, 1)]


@pytest.mark.parametrize("salted", [False, True])
def test_given_pairs(spark, corpus, salted, monkeypatch):
    jobs, resumes, job_frame, resume_frame, vocabulary = corpus
    texts = {c: t for c, _, t in resumes}
    if salted:
        force_salt(monkeypatch)
    pairs = spark.createDataFrame(PAIRS, "candidate_id long, job_id long")
    similar = similarity.tfidf_pairs(pairs, resume_frame, job_frame).collect()
    scored = scoring.score_pairs(pairs, resume_frame, job_frame, vocabulary).collect()
    for rows in (similar, scored):
        assert Counter((r.candidate_id, r.job_id) for r in rows) == Counter(PAIRS)
    known = lambda r: r.candidate_id in texts and r.job_id in jobs
    for r in similar:
        text = texts.get(r.candidate_id) or ""
        assert r.tfidf == (by_definition(text, jobs[r.job_id]) if known(r) else None)
    for r in scored:
        expected = (None, None, None)
        if known(r):
            score, matched, missing = pair_score(texts[r.candidate_id], jobs[r.job_id])
            expected = (score, ", ".join(matched), ", ".join(missing))
        assert (r.matching_score, r.matched_skills, r.missing_skills) == expected


def test_given_pairs_with_embeddings(spark, corpus):
    _, _, job_frame, resume_frame, vocabulary = corpus
    pairs = spark.createDataFrame([(2, 1), (1, 0), (0, 0)], "candidate_id long, job_id long")
    semantic = spark.createDataFrame(
        [(2, 1, 50.0), (1, 0, 10.0)], "candidate_id long, job_id long, semantic double"
    )
    rows = scoring.score_pairs(pairs, resume_frame, job_frame, vocabulary, semantic).collect()
    assert {r.candidate_id: r.matching_score for r in rows} == {2: 85.0, 1: 23.0, 0: 50.0}


def force_salt(monkeypatch):
    """Send every sized join down the shuffle path with several copies of frequent keys."""
    from rolefit.plans import joins

    real = joins.fits_broadcast

    def only_hot(frame, limit=None, bound=None):
        return "_copies" in frame.columns and real(frame, limit)

    monkeypatch.setattr(joins, "fits_broadcast", only_hot)
    monkeypatch.setattr(joins, "HOT_KEY_ROWS", 3)


@pytest.mark.parametrize("limit", [None, 0])
def test_score_candidates(corpus, limit):
    jobs, resumes, job_frame, resume_frame, vocabulary = corpus
    rows = scoring.score_candidates(resume_frame, job_frame, vocabulary, limit=limit).collect()
    got = {
        r.candidate_id: (r.matching_score, r.matched_skills, r.missing_skills, r.explanation)
        for r in rows
    }
    assert len(rows) == len(got)
    expected = {}
    for c, j, text in resumes:
        if text:
            score, matched, missing = pair_score(text, jobs[j])
            expected[c] = (
                score, ", ".join(matched), ", ".join(missing),
                f"Matched {len(matched)} skills ({score}%).",
            )
    assert got == expected
    assert (got[0][0], got[1][0], got[2][0], got[4][0]) == (50.0, 25.0, 100.0, 0.0)


@pytest.mark.parametrize("limit", [None, 0])
def test_score_all_pairs(corpus, limit, monkeypatch):
    jobs, resumes, job_frame, resume_frame, vocabulary = corpus
    if limit is not None:
        force_salt(monkeypatch)
    rows = scoring.score_all_pairs(resume_frame, job_frame, vocabulary, limit=limit).collect()
    got = {
        (r.candidate_id, r.job_id): (r.matching_score, r.matched_skills, r.missing_skills)
        for r in rows
    }
    assert len(rows) == len(got)
    expected = {}
    for c, _, text in resumes:
        for j, wanted in jobs.items():
            score, matched, missing = pair_score(text, wanted)
            if score > 0:
                expected[c, j] = (score, ", ".join(matched), ", ".join(missing))
    assert got == expected


def test_many_skills_need_several_masks(spark):
    skills = [f"skill{i:03d}" for i in range(150)]
    jobs = spark.createDataFrame([(1, "", " ".join(skills), None)], JOBS)
    resume = spark.createDataFrame([(1, 1, "", " ".join(skills[::7]), None)], RESUMES)
    vocabulary = spark.createDataFrame([(s,) for s in skills], "skill string")
    row = scoring.score_all_pairs(resume, jobs, vocabulary).first()
    assert row.matched_skills == ", ".join(skills[::7])
    applied = scoring.score_candidates(resume, jobs, vocabulary).first()
    assert applied.matching_score == row.matching_score


def test_partitioning_does_not_change_scores(corpus):
    _, _, job_frame, resume_frame, vocabulary = corpus
    one, many = (
        sorted(
            map(
                tuple,
                scoring.score_candidates(resume_frame.repartition(n), job_frame, vocabulary)
                .drop("created_at")
                .collect(),
            )
        )
        for n in (1, 7)
    )
    assert one == many


def test_semantic_similarity(spark):
    vectors = [(1, 1, [1.0, 0.0]), (2, 1, [-1.0, 0.0]), (3, 1, None), (4, 2, [1.0, 1.0]),
               (5, 9, [1.0, 0.0]), (6, 1, [0.0, 0.0])]
    jobs = [(1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None)]
    got = similarity.semantic_similarity(
        spark.createDataFrame(vectors, "candidate_id long, job_id long, embedding array<float>"),
        spark.createDataFrame(jobs, "job_id long, embedding array<float>"),
    )
    assert {r.candidate_id: r.semantic for r in got.collect()} == {
        1: 100.0, 2: 0.0, 3: None, 4: 70.71, 5: None, 6: 0.0,
    }


def test_semantic_joins_the_score(spark, corpus):
    _, _, job_frame, resume_frame, vocabulary = corpus
    semantic = spark.createDataFrame([(2, 50.0), (1, 10.0)], "candidate_id long, semantic double")
    rows = scoring.score_candidates(resume_frame, job_frame, vocabulary, semantic).collect()
    got = {r.candidate_id: r.matching_score for r in rows}
    assert got[2] == 85.0  # 0.4*100 + 0.3*100 + 0.3*50
    assert got[1] == 23.0  # 0.4*50 + 0.3*0 + 0.3*10
    assert got[0] == 50.0


def test_blend_and_rounding(spark, values):
    frame = spark.createDataFrame(
        [(37.5, None, None), (50.0, 0.0, None), (100.0, 100.0, 50.0), (40.0, None, 90.0)],
        "k double, t double, s double",
    )
    got = frame.select(sc.blend_scores(F.col("k"), F.col("t"), F.col("s")).alias("b")).collect()
    assert [r.b for r in got] == [37.5, 25.0, 85.0, 40.0]
    assert values(sc.round2(F.col("v")), [3.125, 0.625, 9.375, 1.005], "double") == [
        3.12, 0.62, 9.38, 1.0,
    ]


def test_keyword_score(spark):
    wanted = [f"s{i}" for i in range(16)]
    frame = spark.createDataFrame(
        [(wanted[:6], wanted), (wanted[:3], wanted), ([], [])], "m array<string>, w array<string>"
    )
    got = frame.select(sc.keyword_score(F.col("m"), F.col("w")).alias("k")).collect()
    assert [r.k for r in got] == [37.5, 18.75, None]
