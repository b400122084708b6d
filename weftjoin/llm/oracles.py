"""SQL (DuckDB) for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

from weftjoin.llm import chat_format, jaccard_join, near_vectors, url_filter

#: Links (a, b) among ids (id) closed to the smallest id reachable: the part that both similarity joins share.
_CLOSURE = """reach(id, seen) AS (SELECT id, id FROM ids UNION SELECT reach.id, e.b FROM reach JOIN edges e ON reach.seen = e.a),
lowest AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"""

JACCARD = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {jaccard_join.SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {jaccard_join.SHINGLE} + 2), lambda i: array_to_string(w[i:i + {jaccard_join.SHINGLE} - 1], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
linked AS (SELECT a, b, o, p.n AS na, q.n AS nb FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * o >= {jaccard_join.PERCENT} * (p.n + q.n - o)),
edges AS (SELECT a, b FROM linked), ids AS (SELECT doc_id AS id FROM documents),
equal AS (SELECT a, count(*) AS n FROM linked WHERE o = na AND o = nb GROUP BY a), degree AS (SELECT a, count(*) AS n FROM linked GROUP BY a), {_CLOSURE}
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, (coalesce(e.n, 0) + 1)::BIGINT AS set_size, coalesce(g.n, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN lowest c ON d.doc_id = c.id LEFT JOIN equal e ON d.doc_id = e.a LEFT JOIN degree g ON d.doc_id = g.a"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) / (x.norm * y.norm) >= {near_vectors.THRESHOLD}),
ids AS (SELECT vec_id AS id FROM embeddings), degree AS (SELECT a, count(*) AS n FROM edges GROUP BY a), {_CLOSURE}
SELECT v.vec_id, coalesce(g.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN lowest c ON v.vec_id = c.id LEFT JOIN degree g ON v.vec_id = g.a"""


def chat(t: chat_format.Template = chat_format.DEFAULT) -> str:
    """The digests from the table itself, and the length of the template's marks around escaped texts."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    escaped = "text"
    for control in t.controls():
        quoted = "".join(f"\\{c}" if not c.isalnum() else c for c in control)
        first = 2 if quoted[0] == "\\" else 1
        escaped = f"regexp_replace({escaped}, {text(f'({quoted[:first]})(~*)({quoted[first:]})')}, '\\1~\\2\\3', 'g')"
    marks = " ".join(f"WHEN {text(r)} THEN {len(m.opening) + len(m.closing)}" for r, m in t.roles.items())
    trained = ", ".join(text(r) for r, m in t.roles.items() if m.loss)
    steps = " OR ".join(f"(before = {text(a)} AND role = {text(b)})" for a, b in t.transitions)
    ends = ", ".join(map(text, t.accepting))
    said = text("</s>[INST] ok [/INST]")
    return f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
SELECT -1, * FROM (VALUES (0, 'user', {said}), (1, 'assistant', {said}))),
steps AS (SELECT *, coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w IS NULL AS is_last FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
facts AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({trained})), '') AS loss,
  sum(length({escaped}) + CASE role {marks} ELSE {len(t.other_opening) + len(t.other_opening_end) + len(t.other_closing)} + length(url_encode(role)) END) AS chars,
  bool_and({steps}) AND bool_and(NOT is_last OR role IN ({ends})) AS valid FROM steps GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars, valid FROM facts"""


def urls(rules: list[url_filter.Rule], damping: float = 0.85, steps: int = 200) -> str:
    """Rules by CASE; scores as sums over walks of up to ``steps`` steps, behind which no mass is left that could change a verdict."""
    upper, lower = url_filter._UPPER, url_filter._LOWER
    longest = sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict))
    fits = [(f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in longest]
    case = lambda pick: f"CASE {' '.join(f"WHEN {test} THEN '{pick(r)}'" for test, r in fits)} END"
    href = url_filter._HREF.replace("'", "''")
    return rf"""WITH RECURSIVE u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{url_filter._URL}', 1), '{upper}', '{lower}') AS host, regexp_extract(coalesce(url, ''), '{url_filter._URL}', 2) AS path FROM pages),
ruled AS (SELECT *, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS rule_verdict FROM u),
hosts AS (SELECT host, count(*) FILTER (rule_verdict = 'allow') AS a, count(*) FILTER (rule_verdict = 'block') AS b FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{href}', 1)), '{upper}', '{lower}') AS dst FROM u),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
steps AS (SELECT src AS here, dst AS there, n / sum(n) OVER (PARTITION BY src) AS w, 1 AS forth FROM edges UNION ALL SELECT dst, src, n / sum(n) OVER (PARTITION BY dst), 0 FROM edges),
mass AS (SELECT 0 AS i, host, {1 - damping} * a / greatest(1, (SELECT sum(a) FROM hosts)) AS t, {1 - damping} * b / greatest(1, (SELECT sum(b) FROM hosts)) AS d FROM hosts UNION ALL
SELECT i + 1, there, {damping} * sum(t * w * forth), {damping} * sum(d * w * (1 - forth)) FROM mass JOIN steps ON host = here WHERE i < {steps} AND t + d > 0 GROUP BY i + 1, there),
scores AS (SELECT host, sum(t) AS t, sum(d) AS d FROM mass GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(rule_verdict, CASE WHEN d > t AND d >= {url_filter.LEAST} / (SELECT count(*) FROM hosts) THEN 'block' END, 'allow') AS verdict
FROM ruled r LEFT JOIN scores s ON r.host = s.host"""
