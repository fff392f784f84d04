"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from splitlens.llm import license_scan

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ORACLES: dict[str, str] = {
    "op2_jaccard_join": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes AS p ON p.doc_id = a.doc_id JOIN sizes AS q ON q.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
        ), reach(x, y) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach AS r JOIN links AS l ON r.y = l.x
        )
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, (SELECT min(r.y) FROM reach AS r WHERE r.x = d.doc_id) AS component_id
        FROM documents AS d LEFT JOIN sizes AS z ON z.doc_id = d.doc_id""",
    "op5_decontamination": rf"""
        WITH items AS (
            SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), grams AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
        ), words AS (
            SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)
        ), hits AS (
            SELECT w.doc_id, w.i, w.n, g.item_id FROM windows AS w JOIN grams AS g ON w.n = g.n AND w.g = g.g
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
               sha256(coalesce(n.ids, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
        FROM words AS w LEFT JOIN covered AS c ON c.doc_id = w.doc_id LEFT JOIN named AS n ON n.doc_id = w.doc_id""",
    "op11_prefix_trie": r"""
        WITH said AS (
            SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS w
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS k, list(w ORDER BY turn NULLS FIRST, k) AS w, CAST(conv_id AS VARCHAR) AS s FROM said GROUP BY conv_id
        ), forks AS (
            SELECT conv_id, k, w, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(s) + 1), lambda i: CAST(ord(s[i]) AS BIGINT))), lambda a, c:
                list_reduce(list_concat([xor(a, c)], range(8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h FROM own
        ), built AS (
            SELECT f.conv_id, list_concat(coalesce(o.k[1:f.h], []), f.k[f.h + 1:]) AS k, list_concat(coalesce(o.w[1:f.h], []), f.w[f.h + 1:]) AS w
            FROM forks AS f LEFT JOIN own AS o ON o.conv_id = f.conv_id - f.conv_id % 20
        ), begins AS (
            SELECT conv_id, d, array_to_string(k[1:d], '') AS p, array_to_string(k[1:d - 1], '') AS up, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, d = len(k) AS ends
            FROM (SELECT *, unnest(range(len(k) + 1)) AS d FROM built)
        ), node AS (
            SELECT p, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(w) AS saved,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends
            FROM begins GROUP BY p, d
        ), child AS (
            SELECT up, count(*) AS n FROM node WHERE d > 0 GROUP BY up
        ), under AS (
            SELECT substr(n.p, 1, 32 * n.a) AS top, count(*) FILTER (c.n IS NULL) AS leaves, sum(n.saved) AS saved
            FROM (SELECT *, unnest(range(d + 1)) AS a FROM node) AS n LEFT JOIN child AS c ON c.up = n.p GROUP BY substr(n.p, 1, 32 * n.a)
        )
        SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN u.conv_id END AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children, x.leaves AS n_leaves,
               CAST(x.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
        FROM node AS n LEFT JOIN node AS u ON n.d > 0 AND u.p = n.up LEFT JOIN child AS c ON c.up = n.p JOIN under AS x ON x.top = n.p""",
    "op10_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
        ), firsts AS (
            SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts ON windows.g = firsts.g AND windows.doc_id > firsts.first
        ), each AS (
            SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM words
        ), kept AS (
            SELECT e.doc_id, count(*) AS n, string_agg(e.x, ' ' ORDER BY e.p) AS t FROM each AS e LEFT JOIN gone AS g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id
        )
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) AS BIGINT) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
        FROM words AS w LEFT JOIN kept AS k ON k.doc_id = w.doc_id""",
    "op4_url_filter": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/'
            END AS rule FROM parts
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN md5(host) < '4' OR (prefix(host, 'ads.') AND substr(host, 5) IN (SELECT host FROM parts)) THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op9_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
        ), lines AS (
            SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM split
        ), sized AS (
            SELECT *, len(w) AS n, doc_id * 1000000 + line_no AS pos, array_to_string(w, ' ') AS s FROM lines
        ), contents AS (
            SELECT s, min(pos) AS pos, any_value(w) AS w, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY s
        ), places AS (
            SELECT pos, w, n, s, unnest(range(0, n + 1)) AS i FROM contents WHERE n >= 8
        ), variants AS (
            SELECT pos, n AS length, i, s AS rest FROM places
            UNION ALL
            SELECT pos, n - 1, i, array_to_string(list_concat(w[1:i], w[i + 2:]), ' ') FROM places WHERE i < n
        ), keys AS (
            SELECT length, i, rest, min(pos) AS first FROM variants GROUP BY ALL HAVING min(pos) < max(pos)
        ), near AS (
            SELECT DISTINCT v.pos FROM variants AS v JOIN keys AS k ON v.length = k.length AND v.i = k.i AND v.rest = k.rest WHERE v.pos > k.first
        ), judged AS (
            SELECT z.doc_id, z.line_no, z.line, z.n > 0 AND (z.pos > c.pos OR z.pos IN (SELECT pos FROM near)) AS gone
            FROM sized AS z LEFT JOIN contents AS c ON z.s = c.s AND z.n > 0
        )
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v AS q, v AS c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}


def _license_sql() -> str:
    listed = ", ".join(f"({t}, '{label}', '{text}')" for t, (label, text) in enumerate(license_scan.TEMPLATES))
    phrases = ", ".join(f"('{label}', string_split('{text}', ' '))" for text, label in license_scan.PHRASES)
    return rf"""
        WITH templates AS (
            SELECT t, label, string_split(text, ' ') AS w FROM (VALUES {listed}) AS x(t, label, text)
        ), grams AS (
            SELECT t, label, place, len(w) - 2 AS total, w[place + 1:place + 3] AS g FROM (SELECT *, unnest(range(len(w) - 2)) AS place FROM templates)
        ), words AS (
            SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), places AS (
            SELECT doc_id, pos, w[pos + 1:pos + 3] AS g, w[pos + 1:pos + 2] AS two FROM (SELECT *, unnest(range(len(w))) AS pos FROM words)
        ), votes AS (
            SELECT DISTINCT p.doc_id, g.t, g.label, g.total, g.place, p.pos - g.place AS d FROM places AS p JOIN grams AS g ON p.g = g.g
        ), spans AS (
            SELECT a.doc_id, a.label, count(DISTINCT b.place) / a.total AS share
            FROM (SELECT DISTINCT doc_id, t, label, total, d FROM votes) AS a JOIN votes AS b ON a.doc_id = b.doc_id AND a.t = b.t AND b.d BETWEEN a.d AND a.d + {license_scan.SLACK}
            GROUP BY a.doc_id, a.t, a.label, a.total, a.d
        ), found AS (
            SELECT p.doc_id, p.pos, x.label FROM places AS p JOIN (VALUES {phrases}) AS x(label, w) ON p.g = x.w OR p.two = x.w
        ), base AS (
            SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY doc_id
        ), every AS (
            SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
            FROM (SELECT doc_id, label FROM found UNION ALL SELECT doc_id, label FROM spans WHERE share >= {license_scan.SHARE}) GROUP BY doc_id
        ), best AS (
            SELECT doc_id, max(share) AS score FROM spans GROUP BY doc_id
        )
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
               coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, coalesce(s.score, 0.0::DOUBLE) AS score
        FROM words AS w LEFT JOIN base AS b ON b.doc_id = w.doc_id LEFT JOIN every AS e ON e.doc_id = w.doc_id LEFT JOIN best AS s ON s.doc_id = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {**_ORACLES, "op7_license_scan": _license_sql()}
