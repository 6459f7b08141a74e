"""The same results in SQL for DuckDB, over the whole test tables."""

from rolefit.functions.scores import IDF_OF_ONE_SQUARED
from rolefit.functions.skills import DEFAULT_SKILLS
from rolefit.functions.text import default_stop_words
from rolefit.operators import notify

K2 = f"{IDF_OF_ONE_SQUARED!r}e0"
K2_MINUS_1 = f"{IDF_OF_ONE_SQUARED - 1.0!r}e0"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOPS = "(VALUES " + ", ".join(f"({_text(w)})" for w in default_stop_words()) + ") stops(word)"
SKILLS = "(VALUES " + ", ".join(f"({_text(s)})" for s in DEFAULT_SKILLS) + ") known(skill)"


def _strip_start(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+', '')"


def _title(value: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, length({value}) + 1), lambda i: "
        f"CASE WHEN i > 1 AND regexp_matches({value}[i-1], '[\\p{{Lu}}\\p{{Ll}}]') "
        f"THEN lower({value}[i]) ELSE upper({value}[i]) END), '')"
    )


def _email(text: str) -> str:
    return (
        f"regexp_extract({text}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', 0)"
    )


def _phone(text: str) -> str:
    return f"regexp_extract({text}, '(\\+?\\d{{10,13}}|\\+?\\d{{2,4}}[\\s\\-]?\\d{{6,8}})', 0)"


def _years(text: str) -> str:
    patterns = (
        "(\\d+)\\+?\\s*years?\\s*(?:of\\s*)?experience",
        "experience\\s*(?:of\\s*)?(\\d+)\\+?\\s*years?",
        "(\\d+)\\+?\\s*yrs?\\s*(?:of\\s*)?experience",
    )
    found = ", ".join(
        f"nullif(regexp_extract({text}, '{p}', 1, 'i'), '')" for p in patterns
    )
    return (
        f"CASE WHEN regexp_matches({text}, 'fresher', 'i') THEN CAST(0 AS BIGINT) "
        f"ELSE coalesce(TRY_CAST(coalesce({found}) AS BIGINT), CAST(0 AS BIGINT)) END"
    )


def _level(years: str) -> str:
    return (
        f"CASE WHEN {years} <= 1 THEN 'Fresher' WHEN {years} <= 3 THEN 'Junior' ELSE 'Senior' END"
    )


def _raw_label(text: str) -> str:
    pattern = (
        "(?:full\\s*name|name)\\s*[:\\-]\\s*"
        "([A-Za-z][A-Za-z.''\\-]*(?:[ \\t]+[A-Za-z][A-Za-z.''\\-]*){0,3})"
    )
    return f"regexp_extract(left({_strip_start(text)}, 600), '{pattern}', 1, 'i')"


def _label(raw: str) -> str:
    return (
        f"CASE WHEN {raw} <> '' AND len(regexp_split_to_array({raw}, '[ \\t]+')) BETWEEN 2 AND 4 "
        f"THEN {_title(raw)} END"
    )


def _file_stem(filename: str) -> str:
    return f"translate(regexp_replace({filename}, '\\.[^.]*$', ''), '_-', '  ')"


def _blank_list(joined: str) -> str:
    return (
        f"CASE WHEN coalesce({joined}, '') = '' THEN CAST([] AS VARCHAR[]) "
        f"ELSE string_split({joined}, ', ') END"
    )


JOBS = """jobs AS (
  SELECT item_id AS job_id, concat('Job ', item_id) AS title, text AS description,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(item_id % 7 AS INTEGER)) AS created_at
  FROM benchmark)"""

VOCABULARY = """vocab AS (
  SELECT DISTINCT skill FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS skill FROM benchmark)
  WHERE length(skill) >= 5)"""

RESUMES = """resumes AS (
  SELECT CASE WHEN unreadable THEN -1 - doc_id ELSE doc_id END AS candidate_id, wanted AS job_id,
    concat(source, '_', lang, '-doc-', doc_id, '.pdf') AS filename,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
    CASE WHEN unreadable THEN '' ELSE concat(
      CASE WHEN doc_id % 4 = 1 THEN concat('Full Name: ', lang, ' ', source, chr(10)) ELSE '' END,
      repeat(concat(b.text, ' '),
        CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 16 ELSE 0 END),
      d.text,
      CASE WHEN doc_id % 6 = 0 THEN concat(' ', doc_id % 9, ' years of experience') ELSE '' END,
      CASE WHEN doc_id % 3 = 0 THEN concat(' user', doc_id, '@example.com') ELSE '' END)
    END AS resume_text
  FROM (
    SELECT *, doc_id % (SELECT count(*) FROM benchmark) AS wanted,
      unnest(CASE WHEN doc_id % 50 = 49 THEN [false, true] ELSE [false] END) AS unreadable
    FROM documents) d
  JOIN benchmark b ON b.item_id = d.wanted)"""

CARDS = """cards AS (
  SELECT p_partkey AS doc_id,
    concat(CASE p_partkey % 3 WHEN 0 THEN 'Full Name: ' WHEN 1 THEN ' name - ' ELSE 'by ' END,
      p_name, chr(10),
      CASE p_partkey % 5 WHEN 0 THEN concat(p_size, ' years of experience')
        WHEN 1 THEN concat('Experience of ', p_size, ' years')
        WHEN 2 THEN concat(p_size, '+ yrs experience')
        WHEN 3 THEN concat('fresher, ', p_size, ' years experience')
        ELSE concat(p_size, ' years of professional experience') END, chr(10),
      CASE p_partkey % 4 WHEN 0 THEN 'C++, Machine Learning; Git'
        WHEN 1 THEN 'Scikit-Learn and CI/CD on Linux'
        WHEN 2 THEN 'Node.js, HTML5, Django REST Framework'
        ELSE 'R&D lead, machine  learning, MySQL' END, chr(10),
      p_brand, ' +91 ', 9000000000 + p_partkey, chr(10)) AS text,
    concat(replace(p_name, ' ', '_'), '-', replace(p_brand, '#', '.'), '.v', p_size, '.PDF')
      AS filename
  FROM part)"""

CANDIDATES = f"""raw_candidates AS (
  SELECT *, {_raw_label('resume_text')} AS label, {_file_stem('filename')} AS stem,
    {_email('resume_text')} AS found_email
  FROM resumes),
named_candidates AS (
  SELECT *, {_label('label')} AS labelled, {_title('stem')} AS from_file FROM raw_candidates),
aged_candidates AS (
  SELECT *, {_years('resume_text')} AS experience_years FROM named_candidates),
candidates AS (
  SELECT candidate_id, coalesce(labelled, from_file) AS name,
    CASE WHEN resume_text = '' THEN '' WHEN found_email = ''
      THEN concat('noemail_', candidate_id, '@ats.local') ELSE found_email END AS email,
    {_phone('resume_text')} AS phone, experience_years,
    {_level('experience_years')} AS experience_level,
    concat('resumes/', filename) AS resume_path, job_id, created_at
  FROM aged_candidates)"""


def _term_rows(name: str, source: str, key: str, text: str) -> str:
    return f"""{name} AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\pL\\pN_]{{2,}}')) AS term
    FROM {source})
  WHERE term NOT IN (SELECT word FROM {STOPS}) GROUP BY ALL)"""


def _cosine(dot: str, sa: str, sb: str, na: str, nb: str) -> str:
    return (
        f"CASE WHEN {na} = 0 AND {nb} = 0 THEN NULL WHEN {na} = 0 OR {nb} = 0 THEN 0.0::DOUBLE "
        f"ELSE round_even({dot}::DOUBLE / sqrt(({K2} * {na}::DOUBLE - {K2_MINUS_1} * {sa}::DOUBLE) "
        f"* ({K2} * {nb}::DOUBLE - {K2_MINUS_1} * {sb}::DOUBLE)) * 100 * 100, 0) / 100 END"
    )


TFIDF = f"""{_term_rows('resume_terms', 'resumes', 'candidate_id', 'resume_text')},
{_term_rows('job_terms', 'jobs', 'job_id', 'description')},
resume_norms AS (
  SELECT candidate_id, sum(tf * tf)::BIGINT AS na FROM resume_terms GROUP BY candidate_id),
job_norms AS (SELECT job_id, sum(tf * tf)::BIGINT AS nb FROM job_terms GROUP BY job_id),
shared AS (
  SELECT r.candidate_id, sum(t.tf * j.tf)::BIGINT AS dot, sum(t.tf * t.tf)::BIGINT AS sa,
    sum(j.tf * j.tf)::BIGINT AS sb
  FROM resumes r JOIN resume_terms t USING (candidate_id)
  JOIN job_terms j ON j.job_id = r.job_id AND j.term = t.term GROUP BY r.candidate_id),
sums AS (
  SELECT r.candidate_id, r.job_id, coalesce(dot, 0) AS dot, coalesce(sa, 0) AS sa,
    coalesce(sb, 0) AS sb, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb
  FROM resumes r LEFT JOIN shared USING (candidate_id) LEFT JOIN resume_norms USING (candidate_id)
  LEFT JOIN job_norms USING (job_id)),
tfidf AS (SELECT candidate_id, job_id, {_cosine('dot', 'sa', 'sb', 'na', 'nb')} AS tfidf FROM sums)"""

# The vocabulary of the test data has plain skills only, so a skill is a token.
MATCHES = """job_skills AS (
  SELECT DISTINCT job_id, skill FROM (
    SELECT job_id, unnest(regexp_extract_all(lower(description), '[a-z0-9]+')) AS skill FROM jobs)
  SEMI JOIN vocab USING (skill)),
resume_tokens AS (
  SELECT DISTINCT candidate_id, job_id, skill FROM (
    SELECT candidate_id, job_id,
      unnest(regexp_extract_all(lower(resume_text), '[a-z0-9]+')) AS skill FROM resumes)),
judged AS (
  SELECT r.candidate_id, r.job_id, s.skill, t.skill IS NOT NULL AS hit
  FROM resumes r JOIN job_skills s USING (job_id)
  LEFT JOIN resume_tokens t ON t.candidate_id = r.candidate_id AND t.skill = s.skill),
matches AS (
  SELECT r.candidate_id, r.job_id, count(skill) AS n_wanted,
    count(skill) FILTER (WHERE hit) AS n_matched,
    coalesce(string_agg(skill, ', ' ORDER BY skill) FILTER (WHERE hit), '') AS matched_skills,
    coalesce(string_agg(skill, ', ' ORDER BY skill) FILTER (WHERE NOT hit), '') AS missing_skills
  FROM resumes r LEFT JOIN judged j USING (candidate_id) GROUP BY r.candidate_id, r.job_id)"""

SCORES = f"""{TFIDF},
{MATCHES},
scored AS (
  SELECT candidate_id, job_id, n_matched, matched_skills, missing_skills,
    CASE WHEN n_wanted = 0 THEN 0.0::DOUBLE
      WHEN tfidf IS NULL THEN round_even(n_matched::DOUBLE / n_wanted * 100 * 100, 0) / 100
      ELSE round_even(((n_matched::DOUBLE / n_wanted * 100) * 0.5::DOUBLE
        + tfidf * 0.5::DOUBLE) * 100, 0) / 100 END AS matching_score
  FROM matches JOIN tfidf USING (candidate_id, job_id)),
scores AS (
  SELECT s.candidate_id AS score_id, s.candidate_id, s.job_id, matching_score, matched_skills,
    missing_skills,
    concat('Matched ', n_matched, ' skills (', CAST(matching_score AS VARCHAR), '%).')
      AS explanation, r.created_at
  FROM scored s JOIN resumes r USING (candidate_id) WHERE r.resume_text <> '')"""

PROFILES = """profiles AS (
  SELECT c.*, j.title AS job_title, s.score_id, s.matching_score, s.matched_skills,
    s.missing_skills, s.explanation
  FROM candidates c JOIN jobs j USING (job_id) LEFT JOIN scores s USING (candidate_id))"""

RANKED = """ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY job_id ORDER BY matching_score DESC NULLS LAST, candidate_id) AS rank
  FROM profiles)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (JOBS, RESUMES)
SCORED = (JOBS, VOCABULARY, RESUMES, SCORES)
PROFILED = (JOBS, VOCABULARY, RESUMES, CANDIDATES, SCORES, PROFILES)

MINUTES = "strftime(created_at, '%Y-%m-%d %H:%M') AS created_at"
ALL_COLUMNS = f"SELECT * REPLACE ({MINUTES}) FROM"

REPORT = """SELECT name AS "Candidate Name", email AS "Email", phone AS "Phone",
  job_title AS "Applied Job",
  CASE WHEN experience_years > 0 THEN concat(experience_level, ' (', experience_years, ' Yrs)')
    ELSE experience_level END AS "Experience",
  concat(CAST(coalesce(matching_score, 0.0::DOUBLE) AS VARCHAR), '%') AS "Match Score",
  CASE WHEN coalesce(matching_score, 0) >= 70 THEN 'Shortlisted'
    WHEN coalesce(matching_score, 0) >= 40 THEN 'Under Review' ELSE 'Not Recommended' END
    AS "Status",
  CASE WHEN score_id IS NULL THEN 'N/A' ELSE matched_skills END AS "Matched Skills",
  CASE WHEN score_id IS NULL THEN 'N/A' ELSE missing_skills END AS "Missing Skills",
  CASE WHEN score_id IS NULL THEN 'N/A' ELSE explanation END AS "AI Explanation",
  strftime(created_at, '%Y-%m-%d %H:%M') AS "Applied Date", """

DECISIONS = """decisions AS (
  SELECT *, CASE WHEN matching_score >= 80 THEN 'Shortlisted' ELSE 'Rejected' END AS status
  FROM profiles
  WHERE matching_score IS NOT NULL AND email <> '' AND NOT starts_with(email, 'noemail_'))"""


def _fill(template: str, without_skills: tuple[str, str]) -> str:
    matched, missing = without_skills
    values = {
        "name": "name",
        "job_title": "job_title",
        "status": "status",
        "score": "CAST(matching_score AS VARCHAR)",
        "matched_skills": f"coalesce(nullif(matched_skills, ''), {_text(matched)})",
        "missing_skills": f"coalesce(nullif(missing_skills, ''), {_text(missing)})",
    }
    sql = _text(template)
    for name, value in values.items():
        sql = f"replace({sql}, '{{{name}}}', {value})"
    return sql


def _by_status(shortlisted: str, rejected: str, without_skills: tuple[str, str]) -> str:
    return (
        f"CASE WHEN status = 'Shortlisted' THEN {_fill(shortlisted, without_skills)} "
        f"ELSE {_fill(rejected, without_skills)} END"
    )


MAILS = f"""SELECT candidate_id, job_id, email, status,
  {_fill(notify.SUBJECT, notify.BODY_WITHOUT_SKILLS)} AS subject,
  {_by_status(notify.SHORTLISTED_BODY, notify.REJECTED_BODY, notify.BODY_WITHOUT_SKILLS)} AS body
FROM decisions"""
OUTBOX = _with(*PROFILED, DECISIONS) + MAILS
SCREENED_TABLES = (
    _with(*PROFILED, DECISIONS, f"outbox AS ({MAILS})")
    + f"""SELECT c.* REPLACE ({MINUTES.replace('created_at,', 'c.created_at,')}), CAST(s.score_id AS VARCHAR) AS score_id,
  s.matching_score, s.matched_skills, s.missing_skills, s.explanation, o.status, o.subject, o.body
FROM candidates c LEFT JOIN scores s USING (candidate_id) LEFT JOIN outbox o USING (candidate_id)"""
)

ALL_PAIRS = (JOBS, "resumes AS (SELECT doc_id AS candidate_id, text AS resume_text FROM documents)")
ALL_PAIR_TFIDF = f"""{_term_rows('resume_terms', 'resumes', 'candidate_id', 'resume_text')},
{_term_rows('job_terms', 'jobs', 'job_id', 'description')},
resume_norms AS (
  SELECT candidate_id, sum(tf * tf)::BIGINT AS na FROM resume_terms GROUP BY candidate_id),
job_norms AS (SELECT job_id, sum(tf * tf)::BIGINT AS nb FROM job_terms GROUP BY job_id),
sums AS (
  SELECT t.candidate_id, j.job_id, sum(t.tf * j.tf)::BIGINT AS dot,
    sum(t.tf * t.tf)::BIGINT AS sa, sum(j.tf * j.tf)::BIGINT AS sb
  FROM resume_terms t JOIN job_terms j USING (term) GROUP BY ALL),
tfidf AS (
  SELECT candidate_id, job_id, {_cosine('dot', 'sa', 'sb', 'na', 'nb')} AS tfidf
  FROM sums JOIN resume_norms USING (candidate_id) JOIN job_norms USING (job_id))"""
ALL_PAIR_SKILLS = """job_skills AS (
  SELECT DISTINCT job_id, skill FROM (
    SELECT job_id, unnest(regexp_extract_all(lower(description), '[a-z0-9]+')) AS skill FROM jobs)
  SEMI JOIN vocab USING (skill)),
wanted AS (SELECT job_id, list(skill ORDER BY skill) AS skills FROM job_skills GROUP BY job_id),
resume_tokens AS (
  SELECT DISTINCT candidate_id, skill FROM (
    SELECT candidate_id, unnest(regexp_extract_all(lower(resume_text), '[a-z0-9]+')) AS skill
    FROM resumes)),
hits AS (
  SELECT candidate_id, job_id, list(skill ORDER BY skill) AS matched
  FROM resume_tokens JOIN job_skills USING (skill) GROUP BY ALL),
pairs AS (
  SELECT candidate_id, job_id, tfidf, matched
  FROM tfidf FULL JOIN hits USING (candidate_id, job_id)),
blended AS (
  SELECT p.candidate_id, p.job_id, w.skills, coalesce(matched, CAST([] AS VARCHAR[])) AS matched,
    CASE WHEN na IS NULL AND nb IS NULL THEN NULL ELSE coalesce(tfidf, 0.0::DOUBLE) END AS tfidf
  FROM pairs p JOIN wanted w USING (job_id) JOIN resumes r USING (candidate_id)
  LEFT JOIN resume_norms USING (candidate_id) LEFT JOIN job_norms USING (job_id)
  WHERE r.resume_text <> ''),
scored AS (
  SELECT candidate_id, job_id, array_to_string(matched, ', ') AS matched_skills,
    array_to_string(list_filter(skills, lambda s: NOT list_contains(matched, s)), ', ')
      AS missing_skills,
    round_even((CASE WHEN tfidf IS NULL THEN len(matched)::DOUBLE / len(skills) * 100
      ELSE (len(matched)::DOUBLE / len(skills) * 100) * 0.5::DOUBLE + tfidf * 0.5::DOUBLE END)
      * 100, 0) / 100 AS matching_score
  FROM blended)"""


PAIRS = """pairs AS (
  SELECT candidate_id,
    unnest(list_distinct([candidate_id % n, (candidate_id * 7 + 3) % n])) AS job_id
  FROM resumes, (SELECT count(*) AS n FROM benchmark))"""
PAIR_TFIDF = f"""{_term_rows('resume_terms', 'resumes', 'candidate_id', 'resume_text')},
{_term_rows('job_terms', 'jobs', 'job_id', 'description')},
resume_norms AS (
  SELECT candidate_id, sum(tf * tf)::BIGINT AS na FROM resume_terms GROUP BY candidate_id),
job_norms AS (SELECT job_id, sum(tf * tf)::BIGINT AS nb FROM job_terms GROUP BY job_id),
shared AS (
  SELECT p.candidate_id, p.job_id, sum(t.tf * j.tf)::BIGINT AS dot, sum(t.tf * t.tf)::BIGINT AS sa,
    sum(j.tf * j.tf)::BIGINT AS sb
  FROM pairs p JOIN resume_terms t USING (candidate_id)
  JOIN job_terms j ON j.job_id = p.job_id AND j.term = t.term GROUP BY ALL),
sums AS (
  SELECT p.candidate_id, p.job_id, coalesce(dot, 0) AS dot, coalesce(sa, 0) AS sa,
    coalesce(sb, 0) AS sb, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb
  FROM pairs p LEFT JOIN shared USING (candidate_id, job_id)
  LEFT JOIN resume_norms USING (candidate_id) LEFT JOIN job_norms USING (job_id)),
tfidf AS (SELECT candidate_id, job_id, {_cosine('dot', 'sa', 'sb', 'na', 'nb')} AS tfidf FROM sums)"""

SEMANTIC = """vectors AS (
  SELECT p.candidate_id, p.job_id, CAST(r.embedding AS DOUBLE[]) AS a,
    CAST(j.embedding AS DOUBLE[]) AS b
  FROM pairs p JOIN embeddings r ON r.vec_id = p.candidate_id
  JOIN embeddings j ON j.vec_id = p.job_id),
products AS (
  SELECT candidate_id, job_id, list_inner_product(a, b) AS ab,
    sqrt(list_inner_product(a, a)) AS na, sqrt(list_inner_product(b, b)) AS nb FROM vectors),
semantic AS (
  SELECT candidate_id, job_id, CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE
    ELSE round_even(greatest(0.0::DOUBLE, ab / (na * nb)) * 100 * 100, 0) / 100 END AS semantic
  FROM products)"""

PAIR_SCORES = """job_skills AS (
  SELECT DISTINCT job_id, skill FROM (
    SELECT job_id, unnest(regexp_extract_all(lower(description), '[a-z0-9]+')) AS skill FROM jobs)
  SEMI JOIN vocab USING (skill)),
resume_tokens AS (
  SELECT DISTINCT candidate_id, skill FROM (
    SELECT candidate_id, unnest(regexp_extract_all(lower(resume_text), '[a-z0-9]+')) AS skill
    FROM resumes)),
judged AS (
  SELECT p.candidate_id, p.job_id, s.skill, t.skill IS NOT NULL AS hit
  FROM pairs p JOIN resumes r USING (candidate_id) JOIN job_skills s ON s.job_id = p.job_id
  LEFT JOIN resume_tokens t ON t.candidate_id = p.candidate_id AND t.skill = s.skill
  WHERE r.resume_text <> ''),
matches AS (
  SELECT p.candidate_id, p.job_id, count(skill) AS n_wanted,
    count(skill) FILTER (WHERE hit) AS n_matched,
    coalesce(string_agg(skill, ', ' ORDER BY skill) FILTER (WHERE hit), '') AS matched_skills,
    coalesce(string_agg(skill, ', ' ORDER BY skill) FILTER (WHERE NOT hit), '') AS missing_skills
  FROM pairs p LEFT JOIN judged j USING (candidate_id, job_id) GROUP BY ALL),
scored AS (
  SELECT candidate_id, job_id, matched_skills, missing_skills,
    CASE WHEN n_wanted = 0 THEN 0.0::DOUBLE ELSE round_even((CASE
      WHEN tfidf IS NULL THEN n_matched::DOUBLE / n_wanted * 100
      WHEN semantic IS NULL
        THEN (n_matched::DOUBLE / n_wanted * 100) * 0.5::DOUBLE + tfidf * 0.5::DOUBLE
      ELSE (n_matched::DOUBLE / n_wanted * 100) * 0.4::DOUBLE + tfidf * 0.3::DOUBLE
        + semantic * 0.3::DOUBLE END) * 100, 0) / 100 END AS matching_score
  FROM matches JOIN tfidf USING (candidate_id, job_id)
  LEFT JOIN semantic USING (candidate_id, job_id))"""
APPLIED = "pairs AS (SELECT candidate_id, job_id FROM resumes)"


def _skill_pattern(skill: str) -> str:
    escaped = f"regexp_replace({skill}, '([!-/:-@\\[-`{{-~])', '\\\\\\1', 'g')"
    return f"concat('(^|[^a-z0-9])', {escaped}, '($|[^a-z0-9])')"


MEMBERS = """WITH packed AS (
  SELECT concat('batch-', doc_id // 10, '.zip') AS archive, text AS content,
    CASE doc_id % 5 WHEN 2 THEN concat('CV', doc_id, '.PDF')
      ELSE concat(lang, '/cv', doc_id, '.pdf') END AS entry
  FROM documents WHERE doc_id % 5 NOT IN (3, 4))
SELECT archive, entry, string_split(entry, '/')[-1] AS member, content,
  CAST(NULL AS VARCHAR) AS error FROM packed"""

ORACLES: dict[str, str] = {
    "classify_files": """WITH uploads AS (
  SELECT concat('in/', lang, '/', source, '-', doc_id, CASE doc_id % 4 WHEN 0 THEN '.pdf'
    WHEN 1 THEN '.PDF' WHEN 2 THEN '.Zip' ELSE '.docx' END) AS path FROM documents)
SELECT path, string_split(path, '/')[-1] AS name,
  CASE WHEN lower(path) LIKE '%.zip' THEN 'archive' ELSE 'document' END AS kind
FROM uploads WHERE lower(path) LIKE '%.zip' OR lower(path) LIKE '%.pdf'""",
    "expand_archives": MEMBERS,
    "expand_stored_archives": MEMBERS,
    "ingest_resumes": """WITH counted AS (SELECT count(*) AS n FROM benchmark),
texts AS (
  SELECT doc_id, lang, source, CASE WHEN doc_id % 50 = 49 THEN '' ELSE coalesce(text, '') END AS text,
    CAST(length(text) // 2 AS BIGINT) AS half FROM documents),
ended AS (
  SELECT *, CASE WHEN text = '' THEN '' ELSE text || chr(10) END AS page,
    CASE WHEN text[:half] = '' THEN '' ELSE text[:half] || chr(10) END AS page_1,
    CASE WHEN text[half + 1:] = '' THEN '' ELSE text[half + 1:] || chr(10) END AS page_2 FROM texts)
SELECT doc_id % n AS job_id, concat(source, '-', doc_id, CASE doc_id % 4 WHEN 0 THEN '.pdf' ELSE '.PDF' END) AS filename,
  page_1 || page_2 AS resume_text,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d %H:%M') AS created_at
FROM ended, counted WHERE doc_id % 4 < 2
UNION ALL
SELECT (doc_id // 10) % n, CASE doc_id % 5 WHEN 2 THEN concat('CV', doc_id, '.PDF') ELSE concat('cv', doc_id, '.pdf') END,
  page, strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id // 10), '%Y-%m-%d %H:%M')
FROM ended, counted WHERE doc_id % 5 < 3""",
    "assemble_text": """SELECT conv_id AS doc_id,
  coalesce(string_agg(concat(text, chr(10)), '' ORDER BY turn) FILTER (WHERE text <> ''), '')
    AS text
FROM conversations GROUP BY conv_id""",
    "write_and_read_table": _with(*SCORED) + f"{ALL_COLUMNS} scores",
    "export_csv": _with(*PROFILED) + REPORT + "job_id FROM profiles",
    "extract_email": _with(*BASE)
    + f"SELECT candidate_id, {_email('resume_text')} AS email FROM resumes",
    "extract_phone": _with(CARDS) + f"SELECT doc_id, {_phone('text')} AS phone FROM cards",
    "extract_experience_years": _with(CARDS)
    + f"SELECT doc_id, {_years('text')} AS years FROM cards",
    "experience_level": f"""SELECT p_partkey, CAST(p_size AS BIGINT) AS years,
  {_level('p_size')} AS level FROM part""",
    "extract_labelled_name": _with(CARDS)
    + f"""SELECT doc_id, {_label('label')} AS name
FROM (SELECT doc_id, {_raw_label('text')} AS label FROM cards)""",
    "title_case": f"""SELECT p_partkey, {_title('mixed')} AS titled FROM (
  SELECT p_partkey, concat(lower(p_type), ' o''', p_name, '-', upper(p_brand)) AS mixed
  FROM part)""",
    "name_from_filename": _with(CARDS)
    + f"""SELECT doc_id, {_title('stem')} AS name
FROM (SELECT doc_id, {_file_stem('filename')} AS stem FROM cards)""",
    "resolve_name": _with(CARDS)
    + f"""SELECT doc_id, coalesce({_label('label')}, {_title('stem')}) AS name FROM (
  SELECT doc_id, {_raw_label('text')} AS label, {_file_stem('filename')} AS stem FROM cards)""",
    "fill_contact_defaults": _with(*BASE)
    + f"""SELECT candidate_id, {_phone('resume_text')} AS phone,
  CASE WHEN found = '' THEN concat('noemail_', candidate_id, '@ats.local') ELSE found END AS email
FROM (SELECT *, {_email('resume_text')} AS found FROM resumes)""",
    "parse_profiles": _with(*BASE, CANDIDATES)
    + f"{ALL_COLUMNS} candidates",
    "split_skills": _with(*SCORED)
    + f"""SELECT candidate_id, len(skills) AS n_skills, array_to_string(skills, '|') AS skills
FROM (SELECT candidate_id, {_blank_list('missing_skills')} AS skills FROM scores)""",
    "explode_skills": _with(*SCORED)
    + f"""SELECT candidate_id, job_id, unnest({_blank_list('matched_skills')}) AS skill,
  'matched' AS kind FROM scores
UNION ALL
SELECT candidate_id, job_id, unnest({_blank_list('missing_skills')}) AS skill,
  'missing' AS kind FROM scores""",
    "format_experience": f"""SELECT p_partkey, CASE WHEN years > 0
  THEN concat({_level('years')}, ' (', years, ' Yrs)') ELSE {_level('years')} END AS experience
FROM (SELECT p_partkey, p_size - 10 AS years FROM part)""",
    "extract_skills": _with(VOCABULARY)
    + """, tokens AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS skill
  FROM documents)
SELECT d.doc_id, coalesce(string_agg(v.skill, ', ' ORDER BY v.skill), '') AS skills
FROM documents d LEFT JOIN (SELECT * FROM tokens SEMI JOIN vocab USING (skill)) v USING (doc_id)
GROUP BY d.doc_id""",
    "extract_default_skills": _with(CARDS)
    + f"""SELECT c.doc_id, coalesce(string_agg(skill, ', ' ORDER BY skill), '') AS skills
FROM cards c LEFT JOIN {SKILLS} ON regexp_matches(lower(c.text), {_skill_pattern('skill')})
GROUP BY c.doc_id""",
    "extract_document_fields": f"""SELECT doc_id, {_phone('text')} AS phone, {_years('text')} AS years,
  {_label('label')} AS name, skills
FROM (
  SELECT d.doc_id, d.text, {_raw_label('d.text')} AS label,
    coalesce(string_agg(skill, ', ' ORDER BY skill), '') AS skills
  FROM documents d LEFT JOIN {SKILLS} ON regexp_matches(lower(d.text), {_skill_pattern('skill')})
  GROUP BY d.doc_id, d.text)""",
    "extract_phrases": f"""WITH phrases AS (
  SELECT DISTINCT regexp_extract(lower(text), '[^ \n]+ [^ \n]+$', 0) AS skill FROM benchmark)
SELECT d.doc_id, coalesce(string_agg(skill, ', ' ORDER BY skill), '') AS skills
FROM documents d LEFT JOIN phrases ON skill <> ''
  AND regexp_matches(lower(d.text), {_skill_pattern('skill')})
GROUP BY d.doc_id""",
    "tfidf_pairs": _with(*ALL_PAIRS, PAIRS, PAIR_TFIDF)
    + "SELECT candidate_id, job_id, tfidf FROM tfidf",
    "score_pairs": _with(
        ALL_PAIRS[0], VOCABULARY, ALL_PAIRS[1], PAIRS, PAIR_TFIDF, SEMANTIC, PAIR_SCORES
    )
    + "SELECT candidate_id, job_id, matching_score, matched_skills, missing_skills FROM scored",
    "screen_with_embeddings": _with(
        JOBS, VOCABULARY, RESUMES, APPLIED, PAIR_TFIDF, SEMANTIC, PAIR_SCORES
    )
    + """SELECT candidate_id, job_id,
  CASE WHEN resume_text <> '' THEN matching_score END AS matching_score,
  CASE WHEN resume_text <> '' THEN matched_skills END AS matched_skills,
  CASE WHEN resume_text <> '' THEN missing_skills END AS missing_skills
FROM scored JOIN resumes USING (candidate_id, job_id)""",
    "match_skills": _with(JOBS, VOCABULARY, RESUMES, MATCHES)
    + "SELECT candidate_id, job_id, matched_skills, missing_skills FROM matches",
    "keyword_score": _with(JOBS, VOCABULARY, RESUMES, MATCHES)
    + """SELECT candidate_id, job_id,
  CASE WHEN n_wanted > 0 THEN n_matched::DOUBLE / n_wanted * 100 END AS keyword_score
FROM matches""",
    "term_frequencies": _with(_term_rows("terms", "documents", "doc_id", "text"))
    + "SELECT doc_id, term, tf FROM terms",
    "tfidf_applied": _with(*BASE, TFIDF) + "SELECT candidate_id, job_id, tfidf FROM tfidf",
    "tfidf_all_pairs": _with(*ALL_PAIRS, ALL_PAIR_TFIDF)
    + "SELECT candidate_id, job_id, tfidf FROM tfidf",
    "tfidf_over": _with(*ALL_PAIRS, ALL_PAIR_TFIDF)
    + "SELECT candidate_id, job_id, tfidf FROM tfidf WHERE tfidf >= 30",
    "semantic_similarity": """WITH pairs AS (
  SELECT r.vec_id AS candidate_id, j.vec_id AS job_id, CAST(r.embedding AS DOUBLE[]) AS a,
    CAST(j.embedding AS DOUBLE[]) AS b
  FROM embeddings r JOIN embeddings j ON j.vec_id = r.vec_id - r.vec_id % 25
  WHERE r.vec_id % 25 <> 0),
sums AS (
  SELECT candidate_id, job_id, list_inner_product(a, b) AS ab,
    sqrt(list_inner_product(a, a)) AS na, sqrt(list_inner_product(b, b)) AS nb FROM pairs)
SELECT candidate_id, job_id, CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE
  ELSE round_even(greatest(0.0::DOUBLE, ab / (na * nb)) * 100 * 100, 0) / 100 END AS semantic
FROM sums""",
    "blend_scores": """WITH parts AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity * 2 AS DOUBLE) AS kw,
    CASE WHEN l_linenumber <> 3 THEN round_even(CAST(l_discount AS DOUBLE) * 1000, 0) END AS tf,
    CASE WHEN l_linenumber < 3 THEN round_even(CAST(l_tax AS DOUBLE) * 1000, 0) END AS sem
  FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even((CASE
  WHEN sem IS NOT NULL AND tf IS NOT NULL
    THEN kw * 0.4::DOUBLE + tf * 0.3::DOUBLE + sem * 0.3::DOUBLE
  WHEN tf IS NOT NULL THEN kw * 0.5::DOUBLE + tf * 0.5::DOUBLE ELSE kw END) * 100, 0) / 100
  AS score FROM parts""",
    "score_candidates": _with(*SCORED) + f"{ALL_COLUMNS} scores",
    "score_all_pairs": _with(ALL_PAIRS[0], VOCABULARY, ALL_PAIRS[1], ALL_PAIR_TFIDF, ALL_PAIR_SKILLS)
    + """SELECT candidate_id, job_id, matching_score, matched_skills, missing_skills
FROM scored WHERE matching_score > 0""",
    "candidate_profiles": _with(*PROFILED)
    + f"SELECT * REPLACE ({MINUTES}, CAST(score_id AS VARCHAR) AS score_id) FROM profiles",
    "first_score": _with(*PROFILED)
    + """SELECT candidate_id, CAST(score_id AS VARCHAR) AS score_id,
  coalesce(matching_score, 0.0::DOUBLE) AS matching_score
FROM profiles""",
    "candidates_for_job": _with(*BASE, CANDIDATES)
    + f"{ALL_COLUMNS} candidates WHERE job_id = 7",
    "delete_jobs": _with(*SCORED)
    + """, gone AS (SELECT job_id FROM jobs WHERE contains(description, 'and'))
"""
    + "\nUNION ALL\n".join(
        f"SELECT '{label}' AS table_name, {key} AS id FROM {source} "
        "WHERE job_id NOT IN (SELECT job_id FROM gone)"
        for label, key, source in (
            ("jobs", "job_id", "jobs"),
            ("candidates", "candidate_id", "resumes"),
            ("scores", "score_id", "scores"),
        )
    ),
    "delete_candidates": _with(*SCORED)
    + """, gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
"""
    + "\nUNION ALL\n".join(
        f"SELECT '{label}' AS table_name, {key} AS id FROM {source} "
        "WHERE candidate_id NOT IN (SELECT doc_id FROM gone)"
        for label, key, source in (
            ("candidates", "candidate_id", "resumes"),
            ("scores", "score_id", "scores"),
        )
    ),
    "published_deletes": _with(*SCORED)
    + """, gone AS (SELECT job_id FROM jobs WHERE contains(description, 'and')),
toxic AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'jobs' AS table_name, job_id AS id FROM jobs WHERE job_id NOT IN (SELECT job_id FROM gone)
UNION ALL
"""
    + "\nUNION ALL\n".join(
        f"SELECT '{label}' AS table_name, {key} AS id FROM {source} "
        "WHERE job_id NOT IN (SELECT job_id FROM gone) AND candidate_id NOT IN (SELECT doc_id FROM toxic)"
        for label, key, source in (
            ("candidates", "candidate_id", "resumes"),
            ("scores", "score_id", "scores"),
        )
    ),
    "candidate_by_id": _with(*BASE, CANDIDATES)
    + f"{ALL_COLUMNS} candidates WHERE candidate_id = (SELECT max(candidate_id) FROM candidates)",
    "processed_counts": _with(*BASE)
    + """SELECT j.job_id, count(r.candidate_id) AS processed
FROM jobs j LEFT JOIN (SELECT * FROM resumes WHERE resume_text <> '') r USING (job_id)
GROUP BY j.job_id""",
    "candidate_counts": _with(*BASE)
    + """SELECT j.job_id, count(r.candidate_id) AS candidates
FROM jobs j LEFT JOIN resumes r USING (job_id) GROUP BY j.job_id""",
    "rank_candidates": _with(*PROFILED, RANKED)
    + """SELECT job_id, candidate_id, name, matching_score, matched_skills, missing_skills, rank
FROM ranked""",
    "top_k_candidates": _with(*PROFILED, RANKED)
    + """SELECT job_id, candidate_id, matching_score, rank, concat('rank-', rank) AS badge
FROM ranked WHERE rank <= 3""",
    "list_jobs": _with(JOBS)
    + f"SELECT job_id, title, {MINUTES} FROM jobs ORDER BY jobs.created_at DESC, job_id DESC",
    "latest_job_candidates": _with(*PROFILED, RANKED)
    + """SELECT job_id, candidate_id, matching_score, rank FROM ranked WHERE job_id = (
  SELECT job_id FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 1)""",
    "report_status": _with(*SCORED)
    + """SELECT candidate_id, CASE WHEN matching_score >= 70 THEN 'Shortlisted'
  WHEN matching_score >= 40 THEN 'Under Review' ELSE 'Not Recommended' END AS status
FROM scores""",
    "score_band": _with(*PROFILED)
    + """SELECT candidate_id, CASE WHEN matching_score IS NULL THEN NULL
  WHEN matching_score >= 75 THEN 'high' WHEN matching_score >= 50 THEN 'mid' ELSE 'low' END AS band
FROM profiles""",
    "candidate_report": _with(*PROFILED) + REPORT + "candidate_id FROM profiles",
    "notification_decisions": _with(*PROFILED, DECISIONS)
    + "SELECT candidate_id, job_id, email, matching_score, status FROM decisions",
    "notification_outbox": OUTBOX,
    "unsent_mails": f"SELECT * FROM ({OUTBOX}) WHERE job_id % 2 <> 0 OR candidate_id % 2 = 1",
    "email_prompts": _with(*PROFILED, DECISIONS)
    + "SELECT candidate_id, job_id, email, status, "
    + _by_status(notify.SHORTLISTED_PROMPT, notify.REJECTED_PROMPT, notify.PROMPT_WITHOUT_SKILLS)
    + " AS prompt FROM decisions",
    "screen_stream": SCREENED_TABLES,
    "screen_stream_late_jobs": SCREENED_TABLES,
}
