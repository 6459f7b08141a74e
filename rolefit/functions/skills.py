"""The default skill vocabulary and skill expressions over single rows."""

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit.functions.binding import let
from rolefit.functions.text import word_tokens

# The default skill vocabulary.
DEFAULT_SKILLS = (
    "python", "java", "javascript", "typescript", "c", "c++", "c#", "ruby", "php", "swift",
    "kotlin", "go", "rust", "scala", "r", "matlab", "perl", "html", "css", "html5", "css3",
    "react", "angular", "vue", "node", "django", "flask", "fastapi", "spring", "express",
    "laravel", "bootstrap", "tailwind", "sass", "less", "redux", "webpack", "babel", "sql",
    "mysql", "postgresql", "mongodb", "sqlite", "oracle", "redis", "cassandra", "dynamodb",
    "elasticsearch", "mariadb", "firebase", "pandas", "numpy", "scipy", "matplotlib", "seaborn",
    "plotly", "scikit-learn", "tensorflow", "pytorch", "keras", "opencv", "nltk", "spacy",
    "transformers", "huggingface", "openai", "machine learning", "deep learning",
    "data science", "data analysis", "data visualization", "natural language processing",
    "nlp", "computer vision", "artificial intelligence", "generative ai",
    "reinforcement learning", "predictive modeling", "statistics", "git", "github", "gitlab",
    "bitbucket", "docker", "kubernetes", "jenkins", "aws", "azure", "gcp", "linux", "ubuntu",
    "bash", "shell", "powershell", "ansible", "terraform", "jira", "agile", "scrum",
    "rest api", "graphql", "soap", "microservices", "ci/cd", "devops", "testing", "selenium",
    "pytest", "unittest", "junit", "postman", "tableau", "power bi", "excel", "hadoop",
    "spark", "kafka", "airflow", "etl", "data warehousing", "big data", "celery", "rabbitmq",
    "gunicorn", "nginx", "apache", "django rest framework", "websocket", "tornado",
)

SKILL_SEPARATOR = ", "

# A literal may not touch a letter or digit on either side.
LEFT_EDGE = "(?<![a-z0-9])"
RIGHT_EDGE = "(?![a-z0-9])"


def is_plain(skill: Column) -> Column:
    """The skill is one run of letters and digits, so it equals a token of the text."""
    return skill.rlike(r"^[a-z0-9]+\z")


def first_token(skill: Column) -> Column:
    """The first run of letters and digits in the skill, empty if there is none."""
    return F.regexp_extract(skill, "[a-z0-9]+", 0)


def boundary_pattern(skill: Column) -> Column:
    """Regular expression that finds the literal skill between boundaries."""
    escaped = F.regexp_replace(skill, r"([^\p{L}\p{N}])", r"\\$1")
    return F.concat(F.lit(LEFT_EDGE), escaped, F.lit(RIGHT_EDGE))


def skills_in(text: Column, vocabulary: Sequence[str] = DEFAULT_SKILLS) -> Column:
    """Sorted distinct skills of a short fixed vocabulary that occur in the text.

    Works inside the row. For a vocabulary held in a table use ``operators.extract_skills``.
    """
    plain = sorted({s for s in vocabulary if re.fullmatch("[a-z0-9]+", s)})
    other = sorted({s for s in vocabulary if s and s not in plain})

    def hit(skill: str, lowered: Column, tokens: Column) -> Column:
        token = re.search("[a-z0-9]+", skill)
        pattern = LEFT_EDGE + re.escape(skill) + RIGHT_EDGE
        found = lowered.rlike(pattern)
        if token:
            found = F.array_contains(tokens, token.group(0)) & found
        return F.when(found, F.lit(skill))

    def collect(lowered: Column) -> Column:
        def from_tokens(tokens: Column) -> Column:
            found = F.array_intersect(F.array(*map(F.lit, plain)).cast("array<string>"), tokens)
            if other:
                found = F.concat(
                    found, F.array_compact(F.array(*(hit(s, lowered, tokens) for s in other)))
                )
            return F.sort_array(found)

        return let(word_tokens(lowered), from_tokens)

    return let(F.lower(text), collect)


def split_skills(joined: Column) -> Column:
    """Array of a stored skill list; empty or NULL gives an empty array."""
    return F.when(
        F.coalesce(joined, F.lit("")) == "", F.array().cast("array<string>")
    ).otherwise(F.split(joined, SKILL_SEPARATOR))


def join_skills(skills: Column) -> Column:
    """The stored form of a skill array."""
    return F.array_join(skills, SKILL_SEPARATOR)


def matched_skills(job_skills: Column, resume_skills: Column) -> Column:
    """Sorted skills the job asks for and the résumé shows."""
    return F.sort_array(F.array_intersect(job_skills, resume_skills))


def missing_skills(job_skills: Column, resume_skills: Column) -> Column:
    """Sorted skills the job asks for and the résumé lacks."""
    return F.sort_array(F.array_except(job_skills, resume_skills))
