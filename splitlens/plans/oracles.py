"""The same results in DuckDB SQL, written from the definitions: joins and pairs where the engine rewrites them."""

from __future__ import annotations


def _split(key: str, train: int = 8, valid: int = 1) -> str:
    return f"CASE WHEN {key} % 10 < {train} THEN 'train' WHEN {key} % 10 < {train + valid} THEN 'valid' ELSE 'test' END"


_DOCS = f"""docs AS (
    SELECT d.doc_id AS row_id, d.text AS entity, l.quality, l.toxic, {_split('d.doc_id', 7)} AS split
    FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id
)"""
_ORDERS = f"""recs AS (
    SELECT o_orderkey AS row_id, CAST(o_custkey AS VARCHAR) AS entity, o_orderpriority AS label, o_totalprice AS price, {_split('o_orderkey')} AS split FROM orders
)"""
_ITEMS = f"""items AS (
    SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(l_partkey AS VARCHAR) AS entity, CAST(l_suppkey AS VARCHAR) AS target_seq, l_returnflag AS label,
           {_split('l_orderkey')} AS split
    FROM lineitem
)"""
_BITS = f"""vec AS (
    SELECT vec_id AS id, label, {_split('vec_id')} AS split, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings
), dots AS (
    SELECT x.id AS a, y.id AS b, x.split AS sa, y.split AS sb, x.label AS la, y.label AS lb,
           list_sum(list_transform(list_zip(x.b, y.b), lambda p: p[1] * p[2])) AS shared, list_sum(x.b) AS na, list_sum(y.b) AS nb
    FROM vec AS x, vec AS y WHERE x.id <> y.id
), sims AS (SELECT *, shared / (na + nb - shared)::DOUBLE AS similarity FROM dots)"""
_HITS = f"""hits AS (
    SELECT l_suppkey AS q, l_partkey % 50 + 1 AS t, l_quantity AS score, l_discount AS probability, l_tax AS evalue, l_orderkey * 10 + l_linenumber AS line FROM lineitem
), side AS (SELECT s_suppkey AS k, s_name AS name, {_split('s_suppkey', 5, 2)} AS split FROM supplier), comparisons(no, qs, rs, sq, sr) AS (
    VALUES (0, ['valid'], ['train'], 'valid', 'train'), (1, ['test'], ['train'], 'test', 'train'), (2, ['test'], ['train', 'valid'], 'test', 'train_valid')
), ranked AS (
    SELECT c.no, c.sq AS split_query, c.sr AS split_reference, 's' || h.q AS query, 's' || h.t AS target, h.probability, h.score, h.evalue, h.line,
           a.name = b.name AS self, row_number() OVER (PARTITION BY c.no, h.q ORDER BY h.probability DESC, h.score DESC, h.line, 's' || h.t DESC, h.evalue DESC) AS place
    FROM hits AS h JOIN side AS a ON h.q = a.k JOIN side AS b ON h.t = b.k JOIN comparisons AS c ON list_contains(c.qs, a.split) AND list_contains(c.rs, b.split)
), best AS (SELECT * FROM ranked WHERE place = 1)"""

_KINDS = [
    ("intra_train", "'train'", "'train'"),
    ("intra_valid", "'valid'", "'valid'"),
    ("intra_test", "'test'", "'test'"),
    ("cross_train_valid", "'train'", "'valid'"),
    ("cross_train_test", "'train'", "'test'"),
    ("cross_valid_test", "'valid'", "'test'"),
    ("severe_trainvalid_test", "'train', 'valid'", "'test'"),
]


def _found(records: str, differ: str, key: tuple[str, ...] = ("entity",)) -> str:
    """Entities in conflict by kind, by pairs of records."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in key)
    named = ", ".join(f"a.{k}" for k in key)
    one = [f"SELECT DISTINCT '{kind}' AS kind, {named} FROM {records} AS a JOIN {records} AS b ON {same} WHERE a.split IN ({x}) AND b.split IN ({y}) AND {differ}" for kind, x, y in _KINDS]
    return "found AS (" + " UNION ALL ".join(one) + ")"


_COUNTS = "SELECT " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k, _, _ in _KINDS) + " FROM found"
_ROWS = "found AS f JOIN recs AS r ON f.entity = r.entity AND ((f.kind LIKE '%train%' AND r.split = 'train') OR (f.kind LIKE '%valid%' AND r.split = 'valid') OR (f.kind LIKE '%test%' AND r.split = 'test'))"
_SIGMA = "sigma AS (SELECT 3 * stddev_samp(price) AS s FROM recs WHERE split <> 'test')"
_FAR = "abs(a.price - b.price) >= (SELECT s FROM sigma)"
_RULES = [("long number", "[0-9]{9,}", 0), ("mail address", "[a-z0-9.]+@[a-z0-9.]+", 0), ("license", "(?i)licensed under", 0), ("many commas", ",", 40)]
_HITCOLS = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("probability", "score", "evalue"))


def _overlap(records: str, key: str) -> str:
    n = lambda s: f"(SELECT count(DISTINCT {key}) FROM {records} WHERE split = '{s}')"
    both = lambda a, b: f"(SELECT count(*) FROM (SELECT {key} FROM {records} WHERE split IN ({a}) AND {key} IS NOT NULL INTERSECT SELECT {key} FROM {records} WHERE split IN ({b})))"
    dup = lambda s: f"(SELECT count(*) FROM {records} WHERE split = '{s}') - {n(s)}"
    return f"""SELECT {n('train')} AS unique_train, {n('valid')} AS unique_valid, {n('test')} AS unique_test,
        {both("'train'", "'valid'")} AS shared_train_valid, {both("'train'", "'test'")} AS shared_train_test, {both("'valid'", "'test'")} AS shared_valid_test,
        {both("'train', 'valid'", "'test'")} AS shared_tv_test, (SELECT count(*) FROM {records}) AS n_rows, (SELECT count(DISTINCT {key}) FROM {records}) AS n_unique,
        {dup('train')} AS duplicates_train, {dup('valid')} AS duplicates_valid, {dup('test')} AS duplicates_test,
        (SELECT count(*) - count(DISTINCT {key}) FROM {records}) AS n_duplicates"""


def _cliffs(test: str) -> str:
    return f"""WITH {_BITS}, kinds AS (
        SELECT CASE WHEN sa <> 'test' AND sb = 'test' THEN 'cross_tv_test'
                    WHEN sa <> 'test' AND sb <> 'test' AND (CASE sa WHEN 'train' THEN 0 ELSE 1 END, a) < (CASE sb WHEN 'train' THEN 0 ELSE 1 END, b) THEN 'intra_tv'
                    WHEN sa = 'test' AND sb = 'test' AND a < b THEN 'intra_test' END AS kind, *
        FROM sims WHERE similarity >= 0.5
    ) SELECT kind, a AS id_a, b AS id_b, round(similarity, 6) AS tanimoto, CAST(la - lb AS DOUBLE) AS delta FROM kinds WHERE kind IS NOT NULL AND {test}"""


#: Longest common subsequence of columns a and b.
_LCS = """list_last(list_reduce(list_transform(range(1, len(a) + 1), lambda i: [i]), lambda prev, i:
                    list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda acc, j:
                        list_append(acc, CASE WHEN a[i[1]] = b[j[1]] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], list_last(acc)) END), [CAST(0 AS BIGINT)]),
                    list_transform(range(0, len(b) + 1), lambda j: CAST(0 AS BIGINT))))"""
_MULTI = f"""{_ITEMS}, multi AS (
    SELECT target_seq, count(DISTINCT entity) AS n_entities,
           CAST(max(CASE split WHEN 'train' THEN 1 ELSE 0 END) + max(CASE split WHEN 'valid' THEN 2 ELSE 0 END) + max(CASE split WHEN 'test' THEN 4 ELSE 0 END) AS INTEGER) AS mask,
           min((CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 ELSE 4 END, row_id)) AS first
    FROM items GROUP BY target_seq HAVING count(DISTINCT split) > 1 AND count(DISTINCT entity) > 1
)"""


def oracle_sql() -> dict[str, str]:
    spelled = "[' Train', 'VAL', 'valid ', 'TEST', 'train', 'dev', 'Validation']"
    tokens = "[' 1 ', '1.0', 'NA', 'x', '1d', '1_000', 'nan', '', '-2.5e1', 'Null']"
    numbers = "[1.0, 1.0, NULL, NULL, NULL, 1000.0, NULL, NULL, -25.0, NULL]"
    texts = "[NULL, NULL, NULL, 'x', '1d', NULL, NULL, NULL, NULL, NULL]"
    screens = " UNION ALL ".join(f"SELECT '{name}' AS rule, row_id FROM docs WHERE len(regexp_extract_all(entity, '{pattern}')) > {most}" for name, pattern, most in _RULES)
    return {
        "split_counts": f"WITH {_DOCS} SELECT count(*) FILTER (split = 'train') AS train, nullif(count(*) FILTER (split = 'valid'), 0) AS valid, count(*) FILTER (split = 'test') AS test FROM docs",
        "duplicate_summary": f"WITH {_DOCS} SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_unique, count(*) - count(DISTINCT entity) AS n_duplicates FROM docs",
        "contamination_tv_test": f"WITH {_DOCS} SELECT count(*) AS n_contaminated FROM (SELECT entity FROM docs WHERE split <> 'test' INTERSECT SELECT entity FROM docs WHERE split = 'test')",
        "entity_overlap": f"WITH {_ORDERS} {_overlap('recs', 'entity')}",
        "target_overlap": f"WITH {_ITEMS} {_overlap('items', 'target_seq')}",
        "label_stats_scalar": f"WITH {_ORDERS} SELECT 0 AS pos, count(price) AS n, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std FROM recs WHERE split <> 'test'",
        "label_stats_vector": f"""WITH {_DOCS}, each AS (SELECT 0 AS pos, quality AS x, split FROM docs UNION ALL SELECT 1, toxic, split FROM docs)
            SELECT pos, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM each WHERE split <> 'test' GROUP BY pos""",
        "three_sigma": f"WITH {_ORDERS} SELECT 0 AS pos, round(3 * stddev_samp(price), 4) AS sigma3 FROM recs WHERE split <> 'test'",
        "warning_stats": f"""WITH {_DOCS}, hit AS ({screens}), per AS (SELECT d.row_id, count(h.rule) AS n FROM docs AS d LEFT JOIN hit AS h ON d.row_id = h.row_id WHERE d.split <> 'test' GROUP BY d.row_id)
            SELECT round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std FROM per""",
        "conflict_counts_cls": f"WITH {_ORDERS}, {_found('recs', 'a.label <> b.label')} {_COUNTS}",
        "conflict_counts_reg": f"WITH {_ORDERS}, {_SIGMA}, {_found('recs', _FAR)} {_COUNTS}",
        "conflict_counts_multitask": f"WITH {_DOCS}, {_found('docs', '(a.quality IS DISTINCT FROM b.quality OR a.toxic IS DISTINCT FROM b.toxic)')} {_COUNTS}",
        "conflict_rows_cls": f"WITH {_ORDERS}, {_found('recs', 'a.label <> b.label')} SELECT f.kind, r.split, r.row_id, r.entity, r.label FROM {_ROWS}",
        "conflict_rows_reg": f"WITH {_ORDERS}, {_SIGMA}, {_found('recs', _FAR)} SELECT f.kind, r.split, r.row_id, r.entity FROM {_ROWS}",
        "conflict_pair_key": f"WITH {_ITEMS}, {_found('items', 'a.label <> b.label', ('entity', 'target_seq'))} {_COUNTS}",
        "pair_cross_split": f"""WITH {_ITEMS} SELECT entity, target_seq,
            CAST(max(CASE split WHEN 'train' THEN 1 ELSE 0 END) + max(CASE split WHEN 'valid' THEN 2 ELSE 0 END) + max(CASE split WHEN 'test' THEN 4 ELSE 0 END) AS INTEGER) AS mask
            FROM items GROUP BY entity, target_seq HAVING count(DISTINCT split) > 1""",
        "target_multi_entity": f"WITH {_MULTI} SELECT target_seq, n_entities, mask FROM multi",
        "target_multi_entity_top5": f"WITH {_MULTI} SELECT target_seq, n_entities, mask FROM multi ORDER BY n_entities DESC, first, target_seq LIMIT 5",
        "sequence_registry": f"""WITH own AS (
                SELECT p_partkey AS o, p_brand AS dataset, {_split('p_partkey')} AS split, p_type AS file, regexp_replace(upper(p_name), '\\s+', '', 'g') AS sequence FROM part
            ), once AS (SELECT DISTINCT sequence, dataset, split, file FROM own), lists AS (
                SELECT sequence, count(*) AS n_sources, string_agg(dataset || '|' || split || '|' || file, ';' ORDER BY dataset, split, file) AS sources FROM once GROUP BY sequence
            ) SELECT substr(sha1(o.sequence), 1, 12) || '@' || arg_min(o.dataset, o.o) AS sequence_id, o.sequence, any_value(l.n_sources) AS n_sources, any_value(l.sources) AS sources
              FROM own AS o JOIN lists AS l ON o.sequence = l.sequence WHERE o.sequence <> '' GROUP BY o.sequence""",
        "sequence_normalize": "SELECT p_partkey, regexp_replace(upper(' ' || p_name || chr(9) || chr(10) || lower(p_type)), '\\s+', '', 'g') AS seq FROM part",
        "alert_counts": f"WITH {_DOCS}, hit AS ({screens}) SELECT rule, count(*) AS n FROM hit GROUP BY rule",
        "alert_screen": f"""WITH {_DOCS}, n AS (SELECT row_id, len(regexp_extract_all(entity, '[0-9]{{9,}}')) > 0 AS a, len(regexp_extract_all(entity, '[a-z0-9.]+@[a-z0-9.]+')) > 0 AS b FROM docs)
            SELECT row_id, CAST(a AS BIGINT) + CAST(b AS BIGINT) AS n_warnings, CASE WHEN a THEN 'long number' WHEN b THEN 'mail address' END AS first_warning FROM n""",
        "duplicate_flags": f"""WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY split, entity ORDER BY row_id) > 1 AS again FROM docs)
            SELECT row_id, split, NOT again AS valid, CASE WHEN again THEN 'Duplicate' END AS comment FROM r""",
        "split_normalize": f"SELECT c_custkey, CASE lower(trim({spelled}[c_custkey % 7 + 1])) WHEN 'train' THEN 'train' WHEN 'val' THEN 'valid' WHEN 'valid' THEN 'valid' WHEN 'test' THEN 'test' END AS split FROM customer",
        "label_coercion": f"SELECT c_custkey, CAST({numbers}[c_custkey % 10 + 1] AS DOUBLE) AS number, {texts}[c_custkey % 10 + 1] AS text FROM customer WHERE {tokens}[1] IS NOT NULL",
        "slug": "SELECT p_partkey, trim(regexp_replace(regexp_replace(trim(' *' || p_type || ' / ' || p_brand || '?!'), '[^A-Za-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '-._') AS slug FROM part",
        "group_sizes": "SELECT p_brand AS group_key, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_brand",
        "tanimoto_pairs": f"WITH {_BITS} SELECT a, b, round(similarity, 6) AS similarity FROM sims WHERE a < b AND similarity >= 0.5",
        "nn_tanimoto": f"""WITH {_BITS}, near AS (SELECT a AS id, max(similarity) AS s FROM sims WHERE sa = 'test' AND sb <> 'test' GROUP BY a) SELECT id, round(s, 6) AS similarity FROM near""",
        "nn_tanimoto_summary": f"""WITH {_BITS}, near AS (SELECT a AS id, max(similarity) AS s FROM sims WHERE sa = 'test' AND sb = 'train' GROUP BY a)
            SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, count(*) AS n FROM near""",
        "cliff_pairs_cls": _cliffs("la <> lb"),
        "cliff_pairs_reg": _cliffs("abs(la - lb) >= 3"),
        "best_hit": f"WITH {_HITS} SELECT CAST(no AS INTEGER) AS no, split_query, split_reference, query, target, probability, score, line FROM best",
        "structure_summary": f"WITH {_HITS} SELECT CAST(no AS INTEGER) AS no, split_query, split_reference, count(*) AS n, {_HITCOLS} FROM best GROUP BY no, split_query, split_reference",
        "structure_top50": f"WITH {_HITS} SELECT CAST(no AS INTEGER) AS no, query, target, probability, score FROM best WHERE NOT self ORDER BY probability DESC, score DESC, no, query, target LIMIT 50",
        "structure_coverage": f"""WITH {_HITS} SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test,
            count(*) FILTER (split <> 'test') AS train_valid FROM side""",
        "best_alignment_rule": """WITH a AS (SELECT l_suppkey AS query, l_orderkey || '-' || l_linenumber AS reference, 99.91 + l_discount AS identity_pct, l_quantity AS score FROM lineitem), r AS (
                SELECT *, row_number() OVER (PARTITION BY query ORDER BY identity_pct >= 99.99 DESC, CASE WHEN identity_pct < 99.99 THEN identity_pct END DESC,
                    CASE WHEN identity_pct < 99.99 THEN score END DESC, reference, identity_pct, score) AS place FROM a)
            SELECT query, reference, round(identity_pct, 6) AS identity_pct, score FROM r WHERE place = 1""",
        "consensus_cliffs": f"""WITH names AS (SELECT DISTINCT p_name AS s FROM part), pairs AS (SELECT x.s AS a, y.s AS b FROM names AS x, names AS y), sets AS (
                SELECT *, list_distinct(string_split(a, '')) AS u, list_distinct(string_split(b, '')) AS v FROM pairs), similar_ AS (
                SELECT a, b FROM sets WHERE len(list_intersect(u, v)) >= 0.8 * (len(u) + len(v) - len(list_intersect(u, v))) OR 2 * {_LCS} >= 0.8 * (len(a) + len(b))
            ), recs AS (SELECT p_partkey AS k, p_name AS name, p_brand AS label, {_split('p_partkey')} AS split FROM part), kinds AS (
                SELECT CASE WHEN x.split <> 'test' AND y.split = 'test' THEN 'cross_tv_test'
                            WHEN (x.split = 'test') = (y.split = 'test') AND x.name <> y.name AND (CASE x.split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, x.k) < (CASE y.split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, y.k)
                            THEN CASE WHEN x.split = 'test' THEN 'intra_test' ELSE 'intra_tv' END END AS kind
                FROM recs AS x JOIN similar_ AS s ON x.name = s.a JOIN recs AS y ON y.name = s.b WHERE x.label <> y.label
            ) SELECT kind, count(*) AS n FROM kinds WHERE kind IS NOT NULL GROUP BY kind""",
        "alert_counts_many": f"""WITH {_DOCS}, rules AS (SELECT CAST(item_id AS VARCHAR) AS rule, array_to_string(string_split(coalesce(text, ''), ' ')[1:2], ' ') AS words FROM benchmark)
            SELECT rule, count(*) AS n FROM docs JOIN rules ON words <> '' AND contains(entity, words) GROUP BY rule""",
        "contamination_stream": f"""WITH {_DOCS} SELECT sha256(entity) AS key, CAST(max(CASE split WHEN 'train' THEN 1 ELSE 0 END) + max(CASE split WHEN 'valid' THEN 2 ELSE 0 END) + 4 AS INTEGER) AS mask
            FROM (SELECT DISTINCT entity, split FROM docs WHERE entity IS NOT NULL) GROUP BY entity HAVING bool_or(split = 'test') AND bool_or(split <> 'test')""",
        "label_strings": """SELECT o_orderkey, 'price' AS kind, CAST(o_totalprice AS DOUBLE) AS number, NULL AS text FROM orders UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS DOUBLE), NULL FROM orders
            UNION ALL SELECT o_orderkey, 'priority', NULL, o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'status', NULL, o_orderstatus FROM orders""",
        "label_flatten": "SELECT l_orderkey * 10 + l_linenumber AS row_id, 3 AS n, CAST(l_quantity AS DOUBLE) AS label0, CAST(l_discount AS DOUBLE) AS label1, CAST(l_tax AS DOUBLE) AS label2 FROM lineitem",
        "default_ids": f"""WITH r AS (SELECT o_orderkey, {_split('o_orderkey')} AS split, row_number() OVER () AS place FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY place) - 1 AS row_id FROM r)
            SELECT o_orderkey, split, row_id, CAST(row_id AS VARCHAR) AS id FROM n""",
        "weight_stats": "SELECT round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS std, count(p_retailprice) AS n FROM part",
        "task_inference": """WITH v AS (SELECT 'quality' AS label, CAST(quality AS DOUBLE) AS x FROM labels UNION ALL SELECT 'toxic', toxic FROM labels UNION ALL SELECT 'label', label FROM embeddings UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders)
            SELECT label, CASE WHEN bool_and(x IN (0, 1)) AND count(DISTINCT x) <= 10 THEN 'classification' ELSE 'regression' END AS task FROM v GROUP BY label""",
        "exact_split": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('123:' || o_orderkey)) - 1 AS place, count(*) OVER () AS n FROM orders)
            SELECT CASE WHEN place < CAST(floor(CAST(0.8 AS DOUBLE) * n) AS BIGINT) THEN 'train' WHEN place < CAST(floor(CAST(0.9 AS DOUBLE) * n) AS BIGINT) THEN 'valid' ELSE 'test' END AS split,
                   count(*) AS n, sum(o_orderkey) AS keys FROM r GROUP BY split""",
        "hashed_group_split": """WITH RECURSIVE g AS (
                SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5('123:' || o_custkey)) AS i FROM orders GROUP BY o_custkey
            ), whole AS (SELECT CAST(0.8 AS DOUBLE) * count(*) AS train, CAST(0.9 AS DOUBLE) * count(*) AS both_ FROM orders
            ), walk(i, side, t, b) AS (
                SELECT CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT)
                UNION ALL
                SELECT g.i, CASE WHEN w.t + g.n <= s.train THEN 'train' WHEN w.b + g.n <= s.both_ THEN 'valid' ELSE 'test' END, CASE WHEN w.t + g.n <= s.train THEN w.t + g.n ELSE w.t END,
                       CASE WHEN w.t + g.n <= s.train OR w.b + g.n <= s.both_ THEN w.b + g.n ELSE w.b END
                FROM walk AS w JOIN g ON g.i = w.i + 1, whole AS s
            ) SELECT g.o_custkey, w.side AS split, g.n FROM g JOIN walk AS w ON w.i = g.i""",
        "string_ratio_pairs": f"""WITH names AS (SELECT DISTINCT p_name AS s FROM part), pairs AS (SELECT x.s AS a, y.s AS b FROM names AS x JOIN names AS y ON x.s < y.s), scored AS (
                SELECT a, b, 2 * {_LCS} / CAST(len(a) + len(b) AS DOUBLE) AS similarity FROM pairs)
            SELECT a, b, similarity FROM scored WHERE similarity >= 0.7""",
        "alignment_top50": """WITH a AS (SELECT l_suppkey AS query, l_orderkey || '-' || l_linenumber AS reference, 90 + 100 * l_discount AS identity_pct, l_quantity AS score, l_returnflag AS comparison FROM lineitem), r AS (
                SELECT *, row_number() OVER (PARTITION BY comparison, query ORDER BY identity_pct >= 99.99 DESC, CASE WHEN identity_pct < 99.99 THEN identity_pct END DESC,
                    CASE WHEN identity_pct < 99.99 THEN score END DESC, reference, identity_pct, score) AS place FROM a)
            SELECT comparison, query, reference, round(identity_pct, 6) AS identity_pct, score FROM r WHERE place = 1 ORDER BY r.identity_pct DESC, score DESC, comparison, query, reference LIMIT 50""",
        "metric_auc": """WITH p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * l_quantity AS score FROM lineitem), r AS (
                SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM p)
            SELECT round((sum(mid) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS roc_auc FROM r""",
        "metric_ap": """WITH p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * l_quantity AS score FROM lineitem), s AS (
                SELECT y, sum(y) OVER (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                    count(*) OVER (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM p)
            SELECT round(CAST(sum(y * tp / n::DOUBLE) / sum(y) AS DOUBLE), 6) AS average_precision FROM s""",
        "metric_mse_pearson": "SELECT round(avg(power(l_quantity - l_extendedprice / 1000, 2)), 6) AS mse, round(corr(l_quantity, l_extendedprice / 1000), 6) AS pearson FROM lineitem",
        "noise_fraction_summary": """SELECT l_discount AS fraction, round(avg(l_quantity), 6) AS r_mean, round(stddev_samp(l_quantity), 6) AS r_std, round(avg(l_tax), 6) AS rmse_mean,
            round(stddev_samp(l_tax), 6) AS rmse_std, count(*) AS n_points FROM lineitem GROUP BY l_discount""",
    }

