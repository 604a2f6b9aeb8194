"""DuckDB SQL for the queries of this subpackage that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from . import chat_trees, secrets_scan, url_rules

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat() -> str:
    fixed = len(chat_trees.START) + 1 + len(chat_trees.END) + 1
    controls = " + ".join(f"(length(text) - length(replace(text, {_quoted(c)}, ''))) // {len(c)}" for c in chat_trees.CONTROLS)
    probe = _quoted("</s>[INST] ok [/INST]")
    return f"""WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {probe} UNION ALL SELECT -7, 1, 'assistant', {probe})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length(url_encode(role)) + length(text) + length(text) - length(replace(text, chr(92), '')) + {controls}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""


DECONTAMINATION = f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, row_number() OVER () AS uid, {WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT uid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT uid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT p.uid, p.i, p.n, v.item_id FROM places p JOIN windows v ON v.n = p.n AND v.k = p.k),
hit AS (SELECT uid, count(DISTINCT place) AS n_hit FROM (SELECT uid, unnest(generate_series(i, i + n - 1)) AS place FROM found) GROUP BY uid),
who AS (SELECT uid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (uid) LEFT JOIN who USING (uid)"""


def secrets() -> str:
    parts = []
    for i, k in enumerate(secrets_scan.KINDS):
        p = _quoted(k.pattern)
        parts.append(
            f"""SELECT uid, source, lang, {i} AS ord, '{k.name}' AS kind, {k.least} AS least, unnest(regexp_extract_all(text, {p})) AS m, unnest(regexp_extract_all(text, {p}, {k.group})) AS v,
  unnest(list_slice(string_split_regex(text, {p}), 1, len(regexp_extract_all(text, {p})))) AS gap, unnest(generate_series(1, len(regexp_extract_all(text, {p})))) AS place FROM d WHERE regexp_matches(text, {p})"""
        )
    n_base = sum(k.base for k in secrets_scan.KINDS)
    return f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY uid, ord ORDER BY place) AS BIGINT) AS e FROM raw),
spans AS (SELECT uid, source, lang, ord, kind, e - length(m) AS s, e, sha256(v) AS h FROM placed WHERE length(v) >= least),
every AS (SELECT count(DISTINCT coalesce('=' || source, '')) AS owners FROM d),
freq AS (SELECT h, count(DISTINCT coalesce('=' || source, '')) AS n_owners, count(DISTINCT (coalesce('=' || source, ''), coalesce('=' || lang, ''))) AS n_repos FROM spans GROUP BY h),
judged AS (SELECT spans.*, n_owners > greatest({secrets_scan.MOST_OWNERS}, {secrets_scan.OWNER_SHARE} * (SELECT owners FROM every)) OR (n_owners > 1 AND n_repos > {secrets_scan.MOST_REPOS}) AS copied, kind || ':' || s || ':' || e AS t FROM spans JOIN freq USING (h)),
told AS (SELECT uid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(t, ',' ORDER BY s, ord) FILTER (ord < {n_base}) AS base, string_agg(t, ',' ORDER BY s, ord) FILTER (ord < {n_base} OR NOT copied) AS spans,
  count(*) FILTER (copied) AS n_copied, count(*) FILTER (NOT copied) AS n_live FROM judged GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN told USING (uid)"""


def nearest(k: int = 20, size: int = 64) -> str:
    """Sums coordinate by coordinate, so that scores are the same to the last bit."""
    score = " + ".join(f"CAST(q.embedding[{i}] AS DOUBLE) * CAST(c.embedding[{i}] AS DOUBLE)" for i in range(1, size + 1))
    return f"""WITH c AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {score} AS score FROM c q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""


NEAR_COPIES = f"""WITH RECURSIVE t AS (SELECT coalesce(text, '') AS body, min(doc_id) AS rep, count(*) AS n_copies FROM documents GROUP BY 1),
w AS (SELECT rep, {WORDS.replace("coalesce(text, '')", "body")} AS w FROM t),
g AS (SELECT DISTINCT rep, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS gram FROM (SELECT rep, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE 9 * shared >= 4 * (x.n + y.n)),
c AS (SELECT rep AS node, rep AS seen FROM t UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.seen),
k AS (SELECT node, min(seen) AS class_id FROM c GROUP BY node),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT documents.doc_id, k.class_id, coalesce(d.n_links, 0) AS n_links, t.rep AS copy_of, t.n_copies
FROM documents JOIN t ON t.body = coalesce(text, '') JOIN k ON k.node = t.rep LEFT JOIN d ON d.a = t.rep"""



def listed_urls() -> str:
    rules = ", ".join(f"({_quoted(v)}, {_quoted(r)}, {_quoted(r.partition('/')[0])}, {_quoted('/' + r.partition('/')[2])})" for v, r in url_rules.LISTED)
    return f"""WITH rules(verdict, rule, of, start) AS (VALUES {rules}),
after AS (SELECT row_number() OVER () AS uid, page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
parts AS (SELECT uid, page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM after),
fits AS (SELECT uid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY uid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (uid)"""


ORACLES: dict[str, str] = {
    "listed_urls": listed_urls(),
    "op2_chat_trees": chat(),
    "op3_decontaminate": DECONTAMINATION,
    "op5_secrets": secrets(),
    "op6_vantage_trees": nearest(),
    "op9_set_join": NEAR_COPIES,
}
