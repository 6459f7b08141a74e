"""The same results in DuckDB's SQL, written from the definitions."""

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH docs AS (
  SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM docs
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), windows AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS k
  FROM placed
), repeated AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows WHERE len(k) = 5
  ) WHERE n > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, i + unnest([0, 1, 2, 3, 4]) FROM repeated
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, md5(text) AS t, unnest(string_split(text, chr(10))) AS line FROM docs
), worded AS (
  SELECT doc_id, host, t, line, len(regexp_extract_all(line, '{WORD}')) AS n,
    translate(trim(regexp_replace(
      translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '{SPACE}+', ' ', 'g'), ' '), '123456789', '000000000') AS key
  FROM lines WHERE regexp_matches(line, '{WORD}')
), duplicates AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id
), hosts AS (
  SELECT host, count(DISTINCT t) AS n FROM worded GROUP BY host
), common AS (
  SELECT host, key FROM (
    SELECT host, key, count(DISTINCT t) AS n FROM worded GROUP BY host, key
  ) AS c JOIN hosts USING (host) WHERE c.n >= 30 AND c.n * 100 > hosts.n * 5
), removed AS (
  SELECT doc_id, sum(n) AS n FROM worded JOIN common USING (host, key) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_common_words
  FROM docs d JOIN words USING (doc_id) LEFT JOIN duplicates u USING (doc_id)
  LEFT JOIN covered c USING (doc_id) LEFT JOIN removed r USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_common_words > 0 AND (n_words - n_common_words < 10
      OR 100 * (n_words - n_common_words) < 30 * n_words) AS depleted
  FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT depleted AS kept, n_common_words
FROM judged
"""

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS o
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST([5, 2, 1][((o - 1) % 3) + 1] AS BIGINT) AS weight FROM totals
), filled AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS f FROM weighted
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(source_size) OVER (ORDER BY f, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)
    / sum(weight) OVER (ORDER BY f, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled
), targets AS (
  SELECT source, source_size, o, coalesce(least(source_size * 2.0::DOUBLE, weight * (
      SELECT arg_min(level, f) FROM levels WHERE f > level)), source_size * 2.0::DOUBLE) AS target
  FROM levels
), whole AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS words FROM targets
), summed AS (
  SELECT *, CAST(sum(words) OVER (ORDER BY o) AS BIGINT) AS upto, CAST(sum(words) OVER () AS BIGINT) AS total
  FROM whole
), shares AS (
  SELECT source, source_size, target,
    CAST(floor((upto - words)::DOUBLE / total::DOUBLE * 2147483648) AS BIGINT) AS low,
    CAST(floor(upto::DOUBLE / total::DOUBLE * 2147483648) AS BIGINT) AS high
  FROM summed
), size_of AS (
  SELECT CAST(least(1048576, greatest(1, floor(sum(target) / 262144))) AS BIGINT) AS block,
    CAST(ceil(sum(target) / least(1048576, greatest(1, floor(sum(target) / 262144)))) AS BIGINT) AS slots
  FROM targets
), points AS (
  SELECT range AS slot, (range * 1327217885) % 2147483648 AS point FROM range((SELECT slots FROM size_of))
), ranked AS (
  SELECT source, source_size, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r
  FROM points JOIN shares ON point >= low AND point < high
), takes AS (
  SELECT source, r % CAST(ceil(source_size / block) AS BIGINT) AS b, count(*) AS n
  FROM ranked, size_of WHERE r < 2 * CAST(ceil(source_size / block) AS BIGINT) GROUP BY ALL
), laid AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized
), pieces AS (
  SELECT doc_id, source, start, size, block, unnest(range(CAST(start // block AS BIGINT), CAST((start + size - 1) // block + 1 AS BIGINT))) AS b
  FROM laid, size_of WHERE size > 0
), taken AS (
  SELECT p.doc_id, sum((least(start + size, (p.b + 1) * block) - greatest(start, p.b * block)) * n) AS taken
  FROM pieces p JOIN takes t ON p.source IS NOT DISTINCT FROM t.source AND p.b = t.b GROUP BY p.doc_id
)
SELECT l.doc_id, l.size, s.source_size, s.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM laid l JOIN shares s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN taken t USING (doc_id)
"""

# A run starts at a line, ends at the first line with which it has 20 words, and is deleted unless it
# is the first with its lines.
LINES = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS nr FROM split
), worded AS (
  SELECT doc_id, nr, regexp_replace(raw, '^{SPACE}+|{SPACE}+$', '', 'g') AS line,
    len(regexp_extract_all(raw, '{WORD}')) AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS pos
  FROM lines WHERE regexp_matches(raw, '{WORD}')
), ends AS (
  SELECT a.doc_id, a.pos, min(b.pos) AS last
  FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM worded) a
  JOIN (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM worded) b
    ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= 20
  GROUP BY ALL
), runs AS (
  SELECT e.doc_id, e.pos, e.last, string_agg(w.line, chr(10) ORDER BY w.pos) AS run
  FROM ends e JOIN worded w ON w.doc_id = e.doc_id AND w.pos BETWEEN e.pos AND e.last GROUP BY ALL
), later AS (
  SELECT doc_id, pos, last FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS n FROM runs
  ) WHERE n > 1
), deleted AS (
  SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM later
), counted AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE b IS NULL OR b < pos - 1) AS runs FROM (
    SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM deleted) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.nr) AS text
  FROM lines l LEFT JOIN worded w USING (doc_id, nr) LEFT JOIN deleted d ON d.doc_id = w.doc_id AND d.pos = w.pos
  WHERE d.pos IS NULL GROUP BY l.doc_id
), sizes AS (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id)
SELECT s.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_deleted,
  CAST(coalesce(c.runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(k.text, '')) AS clean_sha256
FROM split s LEFT JOIN sizes z USING (doc_id) LEFT JOIN counted c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, w FROM words WHERE len(w) BETWEEN 1 AND 4
  )
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = d.doc_id
"""

# CRC-32 byte by byte with a table made by its rule. Trees level by level; a path is the list of steps
# 'L' or 'R' and the sibling on that side, 'N' without one.
MANIFEST = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8),
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) AS r(i)
), checked AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS crc
  FROM documents, crc_table
), parts AS (
  SELECT doc_id, lang, crc, n_chars, {doc_id} || {source} || {lang} AS head, {n_chars} AS n, {more} AS m, {text} AS tail
  FROM checked
), leaves AS (
  SELECT doc_id, lang, sha256(head || n || tail) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(head || m || tail) ELSE sha256(head || n || tail) END AS altered
  FROM parts
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS total
  FROM leaves
), nodes AS (
  SELECT lang, 0 AS lvl, idx, leaf AS hash, total FROM placed
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), max((total + 1) // 2)
  FROM nodes WHERE total > 1 GROUP BY lang, lvl, idx // 2
), subroots AS (
  SELECT lang, hash, lvl, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS total
  FROM nodes WHERE total = 1
), tops AS (
  SELECT 0 AS lvl, idx, hash, total FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), max((total + 1) // 2)
  FROM tops WHERE total > 1 GROUP BY lvl, idx // 2
), roots AS (
  SELECT hash AS root, lvl AS height FROM tops WHERE total = 1
), steps AS (
  SELECT p.lang, p.idx, l.lvl AS nr, (p.idx >> l.lvl) % 2 AS side, n.hash
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  JOIN (SELECT unnest(range(64)) AS lvl) l ON l.lvl < s.lvl
  LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.lvl = l.lvl AND n.idx = xor(p.idx >> l.lvl, 1)
  UNION ALL
  SELECT p.lang, p.idx, 64 + l.lvl, (s.idx >> l.lvl) % 2, n.hash
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  JOIN (SELECT unnest(range(64)) AS lvl) l ON l.lvl < (SELECT height FROM roots)
  LEFT JOIN tops n ON n.lvl = l.lvl AND n.idx = xor(s.idx >> l.lvl, 1)
), paths AS (
  SELECT lang, idx, list(CASE WHEN hash IS NULL THEN 'N' WHEN side = 1 THEN 'L' || hash ELSE 'R' || hash END ORDER BY nr) AS path
  FROM steps GROUP BY lang, idx
), proven AS (
  SELECT p.*, s.hash AS subroot, root, coalesce(path, []) AS path
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang, roots
  LEFT JOIN paths q ON q.lang IS NOT DISTINCT FROM p.lang AND q.idx = p.idx
), folds AS (
  SELECT *, list_reduce(path, lambda acc, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || acc WHEN 'R' THEN acc || x[2:] ELSE acc END), altered) AS folded_root
  FROM proven
)
SELECT doc_id, lang, leaf, subroot, root, sha256(list_aggregate(list_transform(path, lambda x: x[2:]), 'string_agg', '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folds
"""
for _name, _value in {"doc_id": "doc_id", "source": "source", "lang": "lang", "n_chars": "n_chars", "more": "(n_chars + 1)", "text": "text"}.items():
    _text = f"CAST({_value} AS VARCHAR)"
    _field = f"coalesce(CAST(octet_length(encode({_text})) AS VARCHAR) || ':' || {_text}, '-')"
    MANIFEST = MANIFEST.replace("{" + _name + "}", _field)

ORACLES = {
    "op4_jaccard_join": JACCARD,
    "op8_line_dedup": LINES,
    "op9_quality_rules": QUALITY,
    "op10_mix_sources": MIXING,
    "op11_merkle_manifest": MANIFEST,
}
