"""SQL for the queries that SQL can express, run over the same whole tables.

The other queries depend on hash functions, a tokenizer or training, which SQL lacks;
tests hold them against brute force.
"""

from __future__ import annotations

from . import license_scan, quality_rules

W = r"[^\x20\x09-\x0D]+"

OP1 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM w UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.reach)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(reach) AS component_id FROM r GROUP BY id) c USING (doc_id)"""


def op2() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    forms = {license_scan.normalise(s): i for i, s in license_scan.SENTENCES.items()}
    known = ", ".join(f"({quote(f)}, {quote(i)})" for f, i in sorted(forms.items()))
    rules = ", ".join(f"({k}, {len(ids)}, {quote(name)}, {quote(license_scan.rule_pattern(ids))})" for k, (name, ids) in enumerate(license_scan.RULES))
    return rf"""WITH known(form, id) AS (VALUES {known}), rules(k, n, name, pattern) AS (VALUES {rules}),
c AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS x FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, trim(unnest(x)) AS form FROM c),
f AS (SELECT doc_id, count(*) AS n_known, string_agg(id, ' ' ORDER BY pos) AS ids FROM u JOIN known USING (form) GROUP BY doc_id),
m AS (SELECT doc_id, string_agg(DISTINCT name, ' ' ORDER BY name) AS licenses, arg_min(name, (-n, name)) AS license FROM f, rules WHERE regexp_matches(ids || ' ', pattern) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_known, 0) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, license FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN m USING (doc_id)"""


OP6 = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc(x, y) AS (VALUES (1, 1)),
k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 16 WHEN 'assistant' THEN 12 ELSE 20 + length(role) + 2 * length(regexp_replace(role, '[^%<\\[]', '', 'g')) END + length(text) + 2 * length(regexp_replace(text, '[^%<\\[]', '', 'g')) AS z FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(z) OVER (PARTITION BY conv_id ORDER BY i) AS cum FROM k)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(cum) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id""".replace("esc(x, y) AS (VALUES (1, 1)),\n", "")

OP7 = r"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule, h, p, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
b AS (SELECT page_id, max((length(rule), rule, r.verdict)) AS b FROM h JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id),
m AS (SELECT page_id, max(name) AS name FROM h JOIN (VALUES ('casino','casino'),('free-bets','free[-_.]?bets'),('cheap-pills','cheap[-_.]?pills'),('spam-farm','spam[-_.]?farm'),('adult-cams','adult[-_.]?cams'),('viagra','viagra'),('warez','warez')) v(name, x) ON regexp_matches(host, '\b' || x || '\b') GROUP BY page_id)
SELECT h.page_id, host, path, b[2] AS rule, CASE WHEN b IS NOT NULL THEN b[3] WHEN m.name IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, coalesce(b[2], m.name) AS matched FROM h LEFT JOIN b USING (page_id) LEFT JOIN m USING (page_id)"""


def op8() -> str:
    rules = quality_rules.RULES
    fails = ", ".join(f"sum(CASE WHEN {e} THEN 1 ELSE 0 END)::DOUBLE AS {r}" for r, e in rules.items())
    moments = ", ".join(f"avg({r} / n) AS m_{r}, var_pop({r} / n) AS v_{r}" for r in rules)
    spread = "(v_{r} - m_{r} * (1 - m_{r}) * inv)"
    weight = f"CASE WHEN {spread} > 0 THEN least(greatest(m_{{r}} * (1 - m_{{r}}) / {spread} - 1, 1), total) ELSE total END"
    weights = ", ".join(f"{weight.format(r=r)} AS w_{r}" for r in rules)
    rates = ", ".join(f"({r} + m_{r} * w_{r}) / (n + w_{r}) AS p_{r}" for r in rules)
    bad = " OR ".join(f"p_{r} - {quality_rules.DEVIATIONS} * sqrt(p_{r} * (1 - p_{r}) / (n + w_{r} + 1)) > least(greatest({quality_rules.TIMES} * m_{r}, {quality_rules.FLOOR}), {quality_rules.MOST})" for r in rules)
    base = " OR ".join(f"({rules[r]})" for r in quality_rules.BASE)
    return rf"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
d AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY doc_id),
l AS (SELECT doc_id, len(x) - len(list_distinct(x)) AS n_dup_lines FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{W}')) AS x FROM w)),
m AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id) JOIN l USING (doc_id)),
h AS (SELECT source, count(*)::DOUBLE AS n, {fails} FROM m GROUP BY source), a AS (SELECT sum(n) AS total, avg(1 / n) AS inv, {moments} FROM h), x AS (SELECT h.*, a.*, {weights} FROM h, a), y AS (SELECT *, {rates} FROM x), v AS (SELECT source, NOT ({bad}) AS host_kept FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({base}) AND host_kept AS kept FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source"""


OP10 = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) > 49)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
o AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM g JOIN f USING (g) WHERE first < doc_id)),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM w),
k AS (SELECT u.doc_id, count(o.j) AS n_removed, string_agg(x, ' ' ORDER BY u.j) FILTER (WHERE o.j IS NULL) AS kept FROM u LEFT JOIN o ON o.doc_id = u.doc_id AND o.j = u.j GROUP BY u.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1,
    "op2_license_scan": op2(),
    "op6_chat_format": OP6,
    "op7_url_filter": OP7,
    "op8_quality_rules": op8(),
    "op10_substring_dedup": OP10,
}
