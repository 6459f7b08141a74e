"""Column layouts of the stored tables and of the frames that pass between operators."""

from pyspark.sql import types as T

JOBS = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

RESUMES = T.StructType(
    [
        T.StructField("candidate_id", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("resume_text", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

CANDIDATES = T.StructType(
    [
        T.StructField("candidate_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("experience_years", T.LongType()),
        T.StructField("experience_level", T.StringType()),
        T.StructField("resume_path", T.StringType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

SCORES = T.StructType(
    [
        T.StructField("score_id", T.LongType()),
        T.StructField("candidate_id", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("matching_score", T.DoubleType()),
        T.StructField("matched_skills", T.StringType()),
        T.StructField("missing_skills", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

VOCABULARY = T.StructType([T.StructField("skill", T.StringType())])

PAGE_ROWS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_no", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

TABLES = {"jobs": JOBS, "candidates": CANDIDATES, "scores": SCORES}
