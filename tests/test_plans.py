"""Shapes of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from rolefit.operators import ranking, scoring, similarity
from rolefit.operators.profiles import parse_profiles
from rolefit.operators.skills import extract_skills
from rolefit.plans.screening import screen_resumes
from rolefit.schemas import RESUMES
from rolefit.session import size_shuffles


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")
    rows = [(c, c % 2, f"{c}.pdf", f"python sql number {c}", None) for c in range(40)]
    spark.createDataFrame(rows, RESUMES).write.parquet(f"{root}/resumes")
    spark.createDataFrame(
        [(0, "Dev", "python"), (1, "Ops", "sql linux")], "job_id long, title string, description string"
    ).write.parquet(f"{root}/jobs")
    spark.createDataFrame([("python",), ("sql",)], "skill string").write.parquet(f"{root}/vocab")
    return tuple(spark.read.parquet(f"{root}/{name}") for name in ("resumes", "jobs", "vocab"))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def text_side(plan):
    """The lines above and at the scan of the résumés, following the streamed side of joins."""
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "resume_text" in line and "FileScan" in line)
    depth = len(re.match(r"[ :+\-*()\d]*", lines[scan]).group(0))
    path = [lines[scan]]
    for line in reversed(lines[:scan]):
        indent = len(re.match(r"[ :+\-*()\d]*", line).group(0))
        if indent < depth:
            path.append(line)
            depth = indent
    return path


@pytest.mark.parametrize("kind", ["parse", "score", "tfidf", "screen"])
def test_text_is_not_shuffled(inputs, kind):
    resumes, jobs, vocabulary = inputs
    frame = {
        "parse": lambda: parse_profiles(resumes),
        "score": lambda: scoring.score_candidates(resumes, jobs, vocabulary),
        "tfidf": lambda: similarity.tfidf_applied(resumes, jobs),
        "screen": lambda: screen_resumes(resumes, jobs, vocabulary),
    }[kind]()
    path = text_side(plan_of(frame))
    assert not [line for line in path if "Exchange" in line or "Sort" in line.split("(")[0]]


def test_scan_reads_the_columns_it_needs(inputs):
    resumes, jobs, vocabulary = inputs
    plan = plan_of(scoring.score_candidates(resumes, jobs, vocabulary).drop("created_at"))
    schema = re.search(r"ReadSchema: struct<([^>]*resume_text[^>]*)>", plan).group(1)
    assert schema == "candidate_id:bigint,job_id:bigint,resume_text:string"
    assert "Not(EqualTo(resume_text,))" in plan
    counted = scoring.score_candidates(resumes, jobs, vocabulary).groupBy("job_id").count()
    assert "regexp_extract_all(lower(resume_text" not in plan_of(counted)


@pytest.mark.parametrize("kind", ["tfidf", "score", "all tfidf", "all scores"])
def test_pairs_shuffle_no_text(inputs, kind):
    resumes, jobs, vocabulary = inputs
    pairs = resumes.select("candidate_id", "job_id")
    frame = {
        "tfidf": lambda: similarity.tfidf_pairs(pairs, resumes, jobs),
        "score": lambda: scoring.score_pairs(pairs, resumes, jobs, vocabulary),
        "all tfidf": lambda: similarity.tfidf_all_pairs(resumes, jobs),
        "all scores": lambda: scoring.score_all_pairs(resumes, jobs, vocabulary),
    }[kind]()
    path = text_side(plan_of(frame))
    first = next(i for i, line in enumerate(path) if "Exchange" in line)
    assert not [line for line in path[first:] if "resume_text" in line or "lowered" in line]


def test_score_of_all_pairs_needs_no_list_of_skills(inputs):
    scored = scoring.score_all_pairs(*inputs)
    assert re.search(r"filter\((listed|job_skills)#", plan_of(scored))
    counted = plan_of(scored.groupBy("job_id").count())
    assert not re.search(r"filter\((listed|job_skills)#", counted) and "bit_count" in counted


def test_tokens_meet_the_vocabulary_in_place(inputs):
    resumes, _, vocabulary = inputs
    plan = plan_of(extract_skills(resumes, vocabulary, "candidate_id", "resume_text"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    frame = spark.range(10).select(
        F.col("id").alias("candidate_id"), (F.col("id") % 2).alias("job_id"), F.lit(1.0).alias("matching_score")
    )
    plan = plan_of(ranking.top_k_candidates(frame))
    assert re.search(r"WindowGroupLimit[^\n]*Partial", plan)


def test_shuffle_size(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 1) == spark.sparkContext.defaultParallelism
        assert size_shuffles(spark, 1 << 40) == 8192
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
