import random

import pytest

from rolefit.operators import similarity
from rolefit.plans import joins


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("least", [12.5, 60.0])
def test_equals_all_pairs(spark, least, limit, monkeypatch):
    """The same pairs as all pairs filtered, with the index broadcast and shuffled."""
    rng = random.Random(5)
    words = [a + b + c for a in "kilmo" for b in "aeu" for c in "nrst"]

    def text(n):
        return " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))

    jobs = [(j, "t", text(rng.randrange(1, 30)), None) for j in range(25)]
    jobs += [(25, "t", "", None), (26, "t", jobs[0][2], None), (27, "t", None, None)]
    resumes = [(c, c % 28, "f", text(rng.randrange(1, 40)), None) for c in range(120)]
    # Equal to a job, without terms, and null.
    resumes += [(120, 1, "f", jobs[3][2], None), (121, 1, "f", "", None), (122, 1, "f", None, None)]
    jobs = spark.createDataFrame(jobs, "job_id long, title string, description string, created_at timestamp")
    resumes = spark.createDataFrame(
        resumes, "candidate_id long, job_id long, filename string, resume_text string, created_at timestamp"
    )
    every = similarity.tfidf_all_pairs(resumes, jobs).collect()
    if limit is not None:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    found = similarity.tfidf_over(resumes, jobs, least).collect()
    wanted = sorted((r.candidate_id, r.job_id, r.tfidf) for r in every if r.tfidf and r.tfidf >= least)
    assert sorted((r.candidate_id, r.job_id, r.tfidf) for r in found) == wanted
    assert 0 < len(wanted) < len(every)


def test_odd_thresholds(spark):
    jobs = spark.createDataFrame([], "job_id long, title string, description string, created_at timestamp")
    resumes = spark.createDataFrame([(1, "kafka")], "candidate_id long, resume_text string")
    assert similarity.tfidf_over(resumes, jobs, 100.0).count() == 0
    with pytest.raises(ValueError):
        similarity.tfidf_over(resumes, jobs, 0.0)
