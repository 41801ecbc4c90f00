"""DuckDB SQL for the corpus queries that SQL can tell on whole tables.

Token counts, packing, byte-level BPE, line templates and token shards have
none; tests hold them against libraries and plain versions.
"""

from __future__ import annotations

from . import license_scan, quality_rules, secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Links of each vector and the smallest that they reach.
OP1 = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(n, m) AS (SELECT a, b FROM links UNION SELECT r.n, l.b FROM reach r JOIN links l ON l.a = r.m),
least_of AS (SELECT n, min(m) AS m FROM reach GROUP BY n),
counts AS (SELECT a AS n, count(*) AS k FROM links GROUP BY a)
SELECT v.vec_id, coalesce(k, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id <= coalesce(m, v.vec_id) AS kept
FROM embeddings v LEFT JOIN least_of l ON l.n = v.vec_id LEFT JOIN counts c ON c.n = v.vec_id
"""

#: Shingle sets of three words, pairs of 85 percent or more, and their components.
OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '{_WORD}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
g AS (SELECT doc_id, n, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, a || ' ' || b || ' ' || c AS s FROM g WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM s p JOIN s q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_.n >= 85 * (x.n + y.n - both_.n)),
pairs AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(n, m) AS (SELECT a, b FROM pairs UNION SELECT r.n, l.b FROM reach r JOIN pairs l ON l.a = r.m),
least_of AS (SELECT n, min(m) AS m FROM reach GROUP BY n)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least_of l ON l.n = d.doc_id
"""


def _fails(column: int) -> str:
    share = {"symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "word_length": "CASE WHEN unspaced THEN 0 ELSE word_chars / greatest(n_words, 1) END"}
    return " OR ".join(f"{share[rule[0]]} > {rule[column]}" for rule in quality_rules.RULES)


#: Counts of each document, failure rates by host under a fitted beta prior, verdicts.
OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
x AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, a || ' ' || lead(a, 1) OVER p || ' ' || lead(a, 2) OVER p AS g FROM x WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (SELECT d.r, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  2 * len(regexp_extract_all(t, '{quality_rules.UNSPACED}')) > length(array_to_string(w, '')) AS unspaced,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w ON w.r = d.r LEFT JOIN rep ON rep.r = d.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, CAST(count(*) FILTER (base_failed OR {_fails(1)}) AS DOUBLE) AS f FROM b GROUP BY host),
mo AS (SELECT least(greatest(avg(f / n), 1e-6), 1 - 1e-6) AS mean, var_pop(f / n) AS v, avg(1 / n) AS r, count(*) AS h FROM h),
sp AS (SELECT mean, h, greatest(v - mean * (1 - mean) * r, 0) AS spread FROM mo),
pr AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1e4) WHEN h > 1 THEN 1e4 ELSE 1 END AS k FROM sp),
hr AS (SELECT host, (mean * k + f) / (k + n) AS host_rate FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT CASE WHEN host_rate > {quality_rules.BAD_RATE} THEN {_fails(2)} ELSE {_fails(1)} END AS kept, round(host_rate, 9) AS host_rate
FROM b JOIN hr ON hr.host = b.host
"""


def _span_sql(kind: int, pattern: str, passes: str) -> str:
    """Spans (r, kind, start, end_, value) of the matches of a pattern."""
    p = _quoted(pattern)
    return f"""(SELECT r, {kind} AS kind, CAST(start AS BIGINT) AS start, CAST(start + length(m) AS BIGINT) AS end_, m FROM (
    SELECT r, m, sum(length(g)) OVER (PARTITION BY r ORDER BY i) + sum(length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS start FROM (
      SELECT r, unnest(regexp_extract_all(t, {p})) AS m, unnest(list_slice(string_split_regex(t, {p}), 1, len(regexp_extract_all(t, {p})))) AS g,
        generate_subscripts(regexp_extract_all(t, {p}), 1) AS i FROM d WHERE regexp_matches(t, {p}))) WHERE {passes})"""


_LEAD = _quoted("^" + secret_scan._LEAD)
_SPELL = "string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || end_, ',' ORDER BY start, kind)"

#: Spans of each kind, and which values stay with one owner.
OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
found AS MATERIALIZED (
  {_span_sql(0, secret_scan.BASE[0][1], f"length(regexp_replace(m, {_LEAD}, '')) >= 12")} UNION ALL
  {_span_sql(1, secret_scan.BASE[1][1], "length(m) >= 18")} UNION ALL
  {_span_sql(2, secret_scan.BASE[2][1], "length(m) >= 16")} UNION ALL
  {_span_sql(3, secret_scan.TOKEN, "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')")}),
valued AS (SELECT found.*, owner, CASE WHEN kind = 0 THEN regexp_replace(m, {_LEAD}, '') ELSE m END AS value FROM found JOIN d ON d.r = found.r),
held AS (SELECT value, count(DISTINCT coalesce('d' || doc_id, 'r' || r)) AS repositories, count(DISTINCT owner) AS owners FROM (SELECT value, valued.owner, doc_id, valued.r FROM valued JOIN d ON d.r = valued.r) GROUP BY value),
judged AS (SELECT v.r, kind, start, end_, owners < {secret_scan.EXAMPLE_OWNERS} AND repositories < {secret_scan.EXAMPLE_REPOSITORIES} AS live, repositories, owners FROM valued v JOIN held o ON o.value = v.value),
counts AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(repositories) AS repositories, max(owners) AS owners FROM judged GROUP BY r),
base AS (SELECT r, {_SPELL} AS spelt FROM judged WHERE kind < 3 GROUP BY r),
chosen AS (SELECT r, {_SPELL} AS spelt FROM judged j WHERE kind < 3 OR (live AND NOT EXISTS (
  SELECT 1 FROM judged b WHERE b.r = j.r AND b.kind < 3 AND b.start < j.end_ AND j.start < b.end_)) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base.spelt, '')) AS base_sha256, coalesce(chosen.spelt, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
  CAST(coalesce(repositories, 0) AS BIGINT) AS repositories, coalesce(owners, 0) AS owners
FROM d LEFT JOIN counts ON counts.r = d.r LEFT JOIN base ON base.r = d.r LEFT JOIN chosen ON chosen.r = d.r
"""


def _values(rows: list[tuple]) -> str:
    cell = lambda v: _quoted(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows) + ")"


_VOCABULARY = _values(list(enumerate(license_scan.WORDS)))
_POSTINGS = _values(license_scan.POSTINGS)
_KEYS = _values([(t, name, len(text.split()), f" ({key})") for t, (name, text, key) in enumerate(license_scan.TEMPLATES)])
_ANCHORS = ", ".join(str(license_scan.WORDS.index(w)) for w in license_scan.ANCHORS if w in license_scan.WORDS)
_NEAR = license_scan.NEAR_WORDS


def _places(phrase: str) -> str:
    words = phrase.split()
    first, n = _quoted(words[0]), len(words)
    return f"list_filter(range(1, len(w) - {n - 2}), lambda i: w[i] = {first} AND list_slice(w, i, i + {n - 1}) = [{', '.join(map(_quoted, words))}])"


_BASE_PLACES = ", ".join(_places(p) for p in license_scan.BASE)
_BASE_LABELS = ", ".join(f"CASE WHEN len({_places(p)}) > 0 THEN {_quoted(label)} END" for p, label in license_scan.BASE.items())

#: Base phrases, and templates whose rare words align at one shift with their key phrase near.
OP9 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
hits AS MATERIALIZED (SELECT r, code, i - 1 AS pos FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t) JOIN {_VOCABULARY} v(code, x) USING (x)),
total AS (SELECT count(*) AS n FROM t),
df AS (SELECT code, count(DISTINCT r) AS n FROM hits GROUP BY code),
idf AS (SELECT v.code, ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1 AS idf FROM {_VOCABULARY} v(code, x) CROSS JOIN total LEFT JOIN df ON df.code = v.code),
posts AS (SELECT template, place, p.code, idf, dense_rank() OVER (PARTITION BY template ORDER BY idf DESC, p.code) AS rank FROM {_POSTINGS} p(template, place, code) JOIN idf ON idf.code = p.code),
full_ AS (SELECT template, sum(idf) AS total FROM (SELECT DISTINCT template, code, idf FROM posts WHERE rank <= {license_scan.RARE_WORDS}) GROUP BY template),
votes AS (SELECT DISTINCT r, template, pos - place AS shift, rank, idf FROM hits JOIN posts USING (code)),
looked AS (SELECT *, dense_rank() OVER (PARTITION BY r, template ORDER BY rank) AS k FROM votes),
shifts AS (SELECT r, template, shift, round(sum(idf), 9) AS v FROM looked WHERE k <= {license_scan.RARE_WORDS} GROUP BY ALL),
best AS (SELECT r, template, shift, least(v / total, 1) AS share FROM (SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY v DESC, shift) AS k FROM shifts) JOIN full_ USING (template) WHERE k = 1),
near AS (SELECT t.r, pos, ' ' || array_to_string(list_slice(w, greatest(pos - {_NEAR}, 0) + 1, greatest(pos - {_NEAR}, 0) + {2 * _NEAR + 1}), ' ') || ' ' AS words FROM hits JOIN t ON t.r = hits.r WHERE code IN ({_ANCHORS})),
mine AS (SELECT b.r, list(DISTINCT k.label) AS labels, max(share) AS share FROM best b JOIN {_KEYS} k(template, label, size, key) USING (template)
  WHERE share >= {license_scan.MIN_SCORE} AND EXISTS (SELECT 1 FROM near n WHERE n.r = b.r AND n.pos >= shift - {_NEAR} AND n.pos <= shift + size + {_NEAR} AND regexp_matches(n.words, k.key)) GROUP BY b.r),
base AS (SELECT r, doc_id, len(w) AS n_words, list_sort(flatten([{_BASE_PLACES}])) AS places, list_sort(list_distinct(list_filter([{_BASE_LABELS}], lambda x: x IS NOT NULL))) AS labels FROM t)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(base.labels, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base.labels, coalesce(mine.labels, [])))), ',') AS labels,
  round(CASE WHEN len(base.labels) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END, 9) AS score
FROM base LEFT JOIN mine ON mine.r = base.r
"""

ORACLE_SQL = {"op1_embedding_dedup": OP1, "op3_minhash_dedup": OP3, "op4_quality_rules": OP4, "op5_secret_scan": OP5, "op9_license_scan": OP9}
