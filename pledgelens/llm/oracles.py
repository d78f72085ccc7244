"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

#: The contract's three expressions and the added ones: kind, expression, group, least characters of the group.
SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    (
        "private_key",
        "-----BEGIN [A-Z ]*PRIVATE KEY-----"
        r"(?:[^-]*(?:-[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----|(?:[\x20\t\r]*\n[A-Za-z0-9+/]{40,})*(?:={1,2}|[\x20\t\r]*\n[A-Za-z0-9+/]+={1,2})?)",
        0,
        1,
    ),
    ("code_host", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat_bot", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("cloud_key", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]

_TAILS = r"(INST\]|/INST\]|ROLE\]|/ROLE\]|END\]|s>|/s>|<SYS>>|</SYS>>)"


def _escaped(text: str) -> str:
    """Length of a text after escaping: a backslash for each control string."""
    return rf"length(regexp_replace({text}, '(\[|<)(\\*){_TAILS}', '\1\\\2\3', 'g'))"


CHAT = f"""
WITH rows AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
 SELECT conv_id, count(*) AS n, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text)[1] AS opening, strpos(list(text ORDER BY turn, role, text)[1], chr(10)) AS line_end,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum({_escaped('text')} + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 18 + {_escaped('role')} END) AS chars
 FROM rows GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, cast(chars AS bigint) AS formatted_chars,
 CASE WHEN roles = ['user', 'assistant'] THEN CASE WHEN line_end > 0 AND line_end < length(opening) THEN 'instruction_input_output' ELSE ['prompt_response', 'prompt_completion', 'question_answer', 'instruction_output'][((conv_id % 4) + 4) % 4 + 1] END
  WHEN roles = ['system', 'user', 'assistant'] THEN 'system_prompt_response' WHEN roles = ['user'] THEN 'text' WHEN n > 6 THEN 'from_value' ELSE 'messages' END AS layout
FROM g"""


def _secrets() -> str:
    """Matches and the pieces between them give the places, kind by kind."""
    parts, arrays = [], []
    for rank, (kind, pattern, value, least) in enumerate(SECRETS):
        p = pattern.replace("'", "''")
        parts.append(f"regexp_extract_all(body, '{p}') AS m{rank}, regexp_extract_all(body, '{p}', {value}) AS v{rank}, string_split_regex(body, '{p}') AS g{rank}")
        begin = f"(list_sum(list_transform(g{rank}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{rank}[1:i - 1], lambda x: length(x))), 0))"
        arrays.append(f"list_transform(list_filter(range(1, len(m{rank}) + 1), lambda i: length(v{rank}[i]) >= {least}), lambda i: {{'start': cast({begin} AS bigint), 'rank': {rank}, 'text': '{kind}:' || cast({begin} AS bigint) || ':' || cast({begin} + length(m{rank}[i]) AS bigint)}})")
    joined = "[]"
    for a in arrays:
        joined = f"list_concat({joined}, {a})"
    text = lambda cond: f"array_to_string(list_transform(list_filter(spans, lambda s: {cond}), lambda s: s.text), ',')"
    counts = ", ".join(f"len(list_filter(spans, lambda s: s.rank = {k})) AS n_{SECRETS[k][0]}" for k in range(3))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), f AS (SELECT doc_id, {', '.join(parts)} FROM d),
s AS (SELECT doc_id, list_sort({joined}) AS spans FROM f)
SELECT doc_id, {counts}, sha256({text('s.rank < 3')}) AS base_sha256, {text('true')} AS spans FROM s"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x AS double))) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.e, c.e) AS bigint) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, unnest(range(0, length(h) // 2 - 199)) AS p, h FROM d WHERE length(h) >= 400),
k AS (SELECT rid, p, md5(substr(h, 2 * p + 1, 400)) AS x FROM w),
r AS (SELECT rid, p FROM k WHERE x IN (SELECT x FROM k GROUP BY x HAVING count(*) > 1)),
i AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS island FROM (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT rid, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY rid, island),
t AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s),
g AS (SELECT t.rid, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM t JOIN d USING (rid) GROUP BY t.rid)
SELECT doc_id, length(h) // 2 AS n_bytes, cast(coalesce(gone, 0) AS bigint) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g USING (rid)"""

NEAR = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT array_to_string(w, ' ') AS words, any_value(w) AS w, min(doc_id) AS node FROM d GROUP BY 1),
s AS (SELECT node, x, count(*) AS k FROM (SELECT node, unnest(CASE WHEN len(w) < 5 THEN CASE WHEN len(w) = 0 THEN [] ELSE [words] END ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM n) GROUP BY 1, 2),
c AS (SELECT node, sum(k) AS n FROM s GROUP BY 1),
e AS (SELECT p.a, p.b FROM (SELECT s.node AS a, t.node AS b, sum(least(s.k, t.k)) AS shared FROM s JOIN s t ON s.x = t.x AND s.node < t.node GROUP BY 1, 2) p JOIN c ca ON ca.node = p.a JOIN c cb ON cb.node = p.b WHERE shared >= 0.8 * (ca.n + cb.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node, min(seen) AS class_id FROM r GROUP BY 1)
SELECT d.doc_id, m.class_id, d.doc_id = m.class_id AS kept FROM d JOIN n ON n.words = array_to_string(d.w, ' ') JOIN m ON m.node = n.node"""

RANKED = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n_docs, cast(sum(len(w)) AS bigint) AS total FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
t AS (SELECT term, cast(floor(1000 * ln((2 * n_docs + 2) / cast(2 * count(*) + 1 AS double))) AS bigint) AS weight FROM p, s GROUP BY term, n_docs),
x AS (SELECT q.item_id, d.doc_id, d.rid, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n_docs) // total)))) AS bigint) AS score
 FROM q JOIN p USING (term) JOIN t USING (term) JOIN d ON d.rid = p.rid, s GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS x, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast(('0x' || substr(x, cast(5 * (i // 4) + 1 AS bigint), 5)) AS bigint) >> cast(15 - 5 * (i % 4) AS bigint)) & 31 AS bigint), 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS digest_matches
FROM h"""

ORACLES = {"op12_ranked_search": RANKED, "op13_warc": WARC, "op1_chat_formatting": CHAT, "op4_secret_scan": _secrets(), "op5_repeated_strings": REPEATS, "op8_exact_top_k": TOP_K, "op10_near_duplicates": NEAR}
