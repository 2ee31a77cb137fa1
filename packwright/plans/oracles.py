"""DuckDB SQL for the catalog's queries, written from their meaning, not from their plans."""

from __future__ import annotations

from packwright.plans.catalog import BUDGET, DRAW, SQL_EDGES, SQL_LEDGER
from packwright.plans.cell import SYSTEM_PROMPT

# White space as RE2 sees it, and the word count of a text.
_WORDS = "len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))"
_TOKENS = "CAST(floor(" + _WORDS + " * 1.3) AS INT)"
_CODE = "list_filter(regexp_split_to_array(lower(regexp_replace({t}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


def _tokens(t: str) -> str:
    return _TOKENS.replace("{t}", t)


def _code(t: str) -> str:
    return _CODE.replace("{t}", t)


_POOL = f"pool AS (SELECT 'd' || doc_id AS name, source AS file, doc_id AS line, text, {_tokens('text')} AS tokens, doc_id AS ord FROM documents)"
_TARGETS = "targets AS (SELECT 'b' || item_id AS sample_id, text AS query, 'src' || (item_id % 20) AS file_name, item_id * 25 AS target_line FROM benchmark)"
_NEAR = """near AS (
    SELECT sample_id, name, file, line, text, tokens,
           row_number() OVER (PARTITION BY sample_id ORDER BY abs(line - target_line), CASE WHEN line < target_line THEN 0 ELSE 1 END, ord) AS rank
    FROM pool JOIN targets ON file = file_name)"""


def _fill(ranked: str, group: str = "sample_id") -> str:
    """The kept items of each group: a fold over its items in rank order."""
    return f"""
    lists AS (SELECT {group} AS g, list({{'rank': rank, 'tokens': tokens, 'name': name}} ORDER BY rank) AS items FROM {ranked} WHERE tokens <= {BUDGET} GROUP BY {group}),
    walk AS (
        WITH RECURSIVE step(g, i, used, kept) AS (
            SELECT g, 0, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM lists
            UNION ALL
            SELECT s.g, s.i + 1, CASE WHEN s.used + l.items[s.i + 1].tokens <= {BUDGET} THEN s.used + l.items[s.i + 1].tokens ELSE s.used END,
                   CASE WHEN s.used + l.items[s.i + 1].tokens <= {BUDGET} THEN list_append(s.kept, CAST(s.i + 1 AS BIGINT)) ELSE s.kept END
            FROM step s JOIN lists l ON s.g = l.g WHERE s.i < len(l.items))
        SELECT s.g, s.used, s.kept, l.items FROM step s JOIN lists l ON s.g = l.g WHERE s.i = len(l.items)),
    fill AS (
        SELECT g AS sample_id, CAST(k AS INT) AS pos, items[kept[k]].name AS name, CAST(items[kept[k]].tokens AS BIGINT) AS tokens, used
        FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS k FROM walk))"""


_BM25 = f"""
    toks AS (SELECT 'd' || doc_id AS name, {_code('text')} AS t, doc_id AS ord FROM documents),
    docs AS (SELECT name, len(t) AS dl, ord FROM toks),
    post AS (SELECT name, term, count(*) AS tf FROM (SELECT name, unnest(t) AS term FROM toks) GROUP BY ALL),
    corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
    raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, corpus GROUP BY term),
    floor_idf AS (SELECT 0.25 * avg(idf) AS f FROM raw),
    idf AS (SELECT term, CASE WHEN idf < 0 THEN f ELSE idf END AS idf FROM raw, floor_idf),
    q AS (SELECT sample_id, term, count(*) AS qf FROM (SELECT 'b' || item_id AS sample_id, unnest({_code('text')}) AS term FROM benchmark) GROUP BY ALL),
    scores AS (
        SELECT sample_id, p.name, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM q JOIN idf USING (term) JOIN post p USING (term) JOIN docs d ON p.name = d.name, corpus GROUP BY ALL)"""
_BM25_RANKED = f"""{_BM25}, {_POOL},
    ranked AS (
        SELECT b.sample_id, p.name, p.tokens,
               row_number() OVER (PARTITION BY b.sample_id ORDER BY round(coalesce(score, 0), 9) DESC, p.name) AS rank
        FROM (SELECT 'b' || item_id AS sample_id FROM benchmark) b CROSS JOIN pool p LEFT JOIN scores s ON s.sample_id = b.sample_id AND s.name = p.name)"""

_PAIR_ROWS = "SELECT doc_id, text, source, lang, unnest([0, 1]) AS half FROM documents"
_SAMPLE = "CAST(doc_id AS VARCHAR) || CASE half WHEN 0 THEN '-vuln' ELSE '-benign' END"
_STRIP = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"

_C_CALLS = """
    SELECT 'fn_' || p_partkey AS name, 'f' || p_partkey || '.c' AS file, CAST(2 AS INT) AS line, p_partkey, p_size FROM part"""

_OUTCOMES = f"""
    ledger AS ({SQL_LEDGER}),
    halves AS (
        SELECT cell, pair_id, count(*) FILTER (WHERE label = 1) AS v, count(*) FILTER (WHERE label = 0) AS b,
               max(prediction) FILTER (WHERE label = 1) AS pv, max(prediction) FILTER (WHERE label = 0) AS pb
        FROM ledger WHERE n_backend_failures = 0 GROUP BY GROUPING SETS ((pair_id), (cell, pair_id))),
    outcomes AS (
        SELECT cell, pair_id, CASE WHEN pv = 1 AND pb = 0 THEN 'P-C' WHEN pv = 1 AND pb = 1 THEN 'P-V' WHEN pv = 0 AND pb = 0 THEN 'P-B'
                                   WHEN pv = 0 AND pb = 1 THEN 'P-R' ELSE 'dropped' END AS outcome
        FROM halves WHERE v = 1 AND b = 1)"""

SQL: dict[str, str] = {
    "clean_body": r"""
        SELECT doc_id, md5(regexp_replace(regexp_replace(
            CASE doc_id % 3 WHEN 0 THEN 'cpp' || chr(10) WHEN 1 THEN ' c' || chr(10) ELSE '' END || text || ' ' || chr(10), '^(?i:c|cpp|cxx|h)\n', ''),
            '^\s+|\s+$', '', 'g')) AS body_md5 FROM documents""",
    "guess_name": r"""
        SELECT p_partkey, nullif(regexp_extract(split_part(
            'static ' || p_name || ' f_' || p_partkey || CASE WHEN p_size % 4 = 0 THEN ' {' ELSE ' (int a) {' END || 'bar(); }', '{', 1),
            '([A-Za-z_]\w*)\s*\(', 1), '') AS name FROM part""",
    "count_tokens": f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents",
    "verdict_parse": r"""
        WITH r AS (SELECT doc_id, upper(left(regexp_replace(CASE doc_id % 4 WHEN 0 THEN '  vulnerable ' || text WHEN 1 THEN 'SAFE.' ELSE text END, '^\s+', ''), 1)) AS c FROM documents),
        v AS (SELECT doc_id, CASE c WHEN 'V' THEN 1 WHEN 'S' THEN 0 ELSE -1 END AS prediction FROM r)
        SELECT doc_id, prediction, CASE prediction WHEN 1 THEN 'VULN' WHEN 0 THEN 'SAFE' ELSE '??' END AS label,
               CASE WHEN prediction = -1 THEN '??' WHEN prediction = doc_id % 2 THEN 'OK' ELSE 'FAIL' END AS mark FROM v""",
    "cell_ids": "SELECT p_partkey, 'S1_R0_b' || (p_size * 100) || '_ts' AS cell, 'src/' || p_name AS path FROM part",
    "dedup_first": "SELECT idx, ord, body_md5 FROM (SELECT doc_id % 500 AS idx, doc_id AS ord, md5(text) AS body_md5, row_number() OVER (PARTITION BY doc_id % 500 ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "pair_explode": f"""
        SELECT {_SAMPLE} AS sample_id, doc_id AS pair_id, half, 1 - half AS label, CASE half WHEN 0 THEN 'v' ELSE 'x' END || doc_id AS commit,
               source || '-' || left(CASE half WHEN 0 THEN 'v' ELSE 'x' END || doc_id, 12) AS worktree, md5({_STRIP.replace('{t}', 'text')}) AS body_md5
        FROM ({_PAIR_ROWS})""",
    "pair_explode_introducing": f"SELECT {_SAMPLE} AS sample_id, CASE half WHEN 0 THEN 'i' ELSE 'x' END || doc_id AS commit, 1 - half AS label FROM ({_PAIR_ROWS})",
    "pair_scan": """
        SELECT doc_id AS idx, 'CVE-' || doc_id AS cve, lang AS cwe, source AS project, 'i' || doc_id AS vulnerability_introducing_commit_id,
               CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS place, md5('c' || chr(10) || text) AS vulnerable_md5, md5(text) AS fixed_md5 FROM documents""",
    "sample_set_id": "SELECT item_id % 4 AS bucket, left(sha256(string_agg(item_id || '-vuln', chr(10) ORDER BY item_id || '-vuln')), 12) AS set_id FROM benchmark GROUP BY 1",
    "strat_draw_md5": f"""
        WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('0-' || doc_id), doc_id) AS round FROM documents)
        SELECT doc_id, source, lang, CAST(round AS INT) AS round FROM r ORDER BY round, md5('0-' || source || '-' || lang), doc_id LIMIT {DRAW}""",
    "frozen_apply": f"""
        WITH ids AS (SELECT unnest(['7-benign', '7-vuln', '3-benign', '3-vuln', '7-benign', '7-vuln', '150-benign', '150-vuln', '42-benign', '42-vuln']) AS sample_id, unnest(range(10)) AS pos),
        s AS (SELECT {_SAMPLE} AS sample_id, 1 - half AS label, CASE half WHEN 0 THEN 'v' ELSE 'x' END || doc_id AS commit FROM ({_PAIR_ROWS}))
        SELECT CAST(pos AS INT) AS pos, sample_id, label, commit FROM ids JOIN s USING (sample_id)""",
    "limit_samples": f"SELECT {_SAMPLE} AS sample_id, 1 - half AS label FROM ({_PAIR_ROWS}) ORDER BY doc_id, half LIMIT 25",
    "dataset_hash": "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents",
    "pool_exclude_target": f"""
        WITH {_POOL}
        SELECT t.name AS sample_id, count(*) AS n, CAST(sum(p.tokens) AS BIGINT) AS tokens, min(p.ord) AS first FROM pool t JOIN pool p ON p.file = t.file AND p.name <> t.name GROUP BY t.name""",
    "symbol_index": """
        WITH f AS (SELECT 's' || (doc_id % 300) AS name, source AS file, CAST(doc_id AS INT) AS line, doc_id FROM documents),
        one AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, doc_id) AS n FROM f)
        SELECT name, file, line, row_number() OVER (ORDER BY file, doc_id) AS ord FROM one WHERE n = 1""",
    "same_file_rank": f"WITH {_POOL}, {_TARGETS}, {_NEAR} SELECT sample_id, name, CAST(rank AS INT) AS rank FROM near",
    "same_file_fill": f"WITH {_POOL}, {_TARGETS}, {_NEAR}, {_fill('near')} SELECT sample_id, pos, name, tokens, used FROM fill",
    "code_tokens": f"SELECT doc_id, md5(array_to_string({_code('text')}, ' ')) AS tokens_md5, len({_code('text')}) AS n FROM documents",
    "bm25_stats": f"WITH {_BM25} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM post GROUP BY term",
    "bm25_scores": f"WITH {_BM25} SELECT sample_id, name, round(score, 4) AS score FROM scores",
    "bm25_topk": f"WITH {_BM25_RANKED} SELECT sample_id, name, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 20",
    "bm25_fill": f"WITH {_BM25_RANKED}, {_fill('ranked')} SELECT sample_id, pos, name, tokens, used FROM fill",
    "greedy_fill": f"WITH {_POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS rank FROM pool), {_fill('r', 'file')} SELECT sample_id, pos, name, tokens, used FROM fill",
    "callees": f"WITH {SQL_EDGES} SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, callee FROM orders JOIN edges ON caller = 'o' || o_orderkey",
    "callers": f"WITH {SQL_EDGES} SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, caller FROM orders JOIN edges ON callee = 'o' || o_orderkey",
    "callgraph_2hop": f"""
        WITH {SQL_EDGES},
        t AS (SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, 'o' || o_orderkey AS target FROM orders),
        steps AS (SELECT caller AS a, callee AS b, 0 AS dir FROM edges UNION ALL SELECT callee, caller, 1 FROM edges),
        one AS (SELECT sample_id, target, b AS name, min(dir) AS direction FROM t JOIN steps ON a = target WHERE b <> target GROUP BY ALL),
        front AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY direction, name) AS place FROM one),
        two AS (
            SELECT f.sample_id, s.b AS name, arg_min(s.dir, f.place * 2 + s.dir) AS direction
            FROM front f JOIN steps s ON s.a = f.name LEFT JOIN one o ON o.sample_id = f.sample_id AND o.name = s.b
            WHERE s.b <> f.target AND o.name IS NULL GROUP BY ALL)
        SELECT sample_id, name, 1 AS distance, direction FROM one UNION ALL SELECT sample_id, name, 2, direction FROM two""",
    "pack_r0": f"""
        WITH {_POOL}, {_TARGETS}, {_NEAR}, {_fill('near')},
        blocks AS (
            SELECT f.sample_id, string_agg('[EVIDENCE E' || pos || ']' || chr(10) || 'file: ' || file || chr(10) || 'function: ' || f.name || chr(10) || 'line: ' || line
                   || chr(10) || chr(10) || {_STRIP.replace('{t}', 'text')} || chr(10) || '[/EVIDENCE]', chr(10) ORDER BY pos) AS evidence
            FROM fill f JOIN pool p ON f.name = p.name GROUP BY f.sample_id),
        packs AS (
            SELECT t.sample_id, '=== TARGET FUNCTION ===' || chr(10) || {_STRIP.replace('{t}', 'query')}
                   || coalesce(chr(10) || chr(10) || '=== CONTEXT (selected functions, raw source) ===' || chr(10) || evidence, '') AS pack
            FROM targets t LEFT JOIN blocks b ON t.sample_id = b.sample_id)
        SELECT sample_id, md5(pack) AS pack_md5, length(pack) AS n_chars FROM packs""",
    "pack_r1_lines": r"""
        WITH l AS (
            SELECT doc_id, text, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line, unnest(range(len(string_split(rtrim(text, chr(10)), chr(10))))) AS r FROM documents WHERE text <> ''),
        n AS (SELECT doc_id, max(r) AS last, bool_or(line LIKE '%the %') AS has FROM l GROUP BY doc_id),
        k AS (SELECT l.*, lag(r) OVER (PARTITION BY l.doc_id ORDER BY r) AS before FROM l JOIN n USING (doc_id) WHERE has AND (r = 0 OR r = last OR line LIKE '%the %')),
        s AS (
            SELECT doc_id, string_agg(CASE WHEN r > before + 1 THEN '      ...' || chr(10) ELSE '' END || lpad(CAST(doc_id % 1000 + 1 + r AS VARCHAR), 6, ' ') || '| '
                   || regexp_replace(line, '\s+$', ''), chr(10) ORDER BY r) AS snippet FROM k GROUP BY doc_id)
        SELECT d.doc_id, md5(coalesce(snippet, regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS snippet_md5 FROM documents d LEFT JOIN s USING (doc_id) WHERE text <> ''""",
    "ledger_fields": f"""
        WITH {_POOL}, {_TARGETS}, {_NEAR}, {_fill('near')}
        SELECT sample_id, CAST({_tokens('query')} AS BIGINT) AS target_tokens, (SELECT count(*) FROM near n WHERE n.sample_id = t.sample_id) AS n_candidates_pool,
               (SELECT count(*) FROM fill f WHERE f.sample_id = t.sample_id) AS n_candidates_selected,
               CAST(coalesce((SELECT sum(tokens) FROM fill f WHERE f.sample_id = t.sample_id), 0) AS BIGINT) AS n_evidence_tokens FROM targets t""",
    "ledger_rows": f"""
        WITH pool AS (
            SELECT 'd' || doc_id AS name, source AS file, doc_id AS line, text, {_tokens('text')} AS tokens, row_number() OVER (ORDER BY source, doc_id) AS ord
            FROM documents WHERE text <> ''),
        targets AS (
            SELECT 'b' || item_id AS sample_id, item_id, 'd' || (item_id * 25) AS own, 'src' || (item_id % 20) AS file_name,
                   'int d' || (item_id * 25) || '(int a) {{ ' || text || ' }}' || chr(10) AS body FROM benchmark),
        aimed AS (SELECT t.*, nullif(p.line, 0) AS target_line FROM targets t LEFT JOIN pool p ON p.name = t.own),
        near AS (
            SELECT sample_id, name, file, line, text, tokens,
                   row_number() OVER (PARTITION BY sample_id ORDER BY abs(line - target_line), CASE WHEN line < target_line THEN 0 ELSE 1 END, ord) AS rank
            FROM pool JOIN aimed ON file = file_name AND name <> own),
        {_fill('near')},
        blocks AS (
            SELECT f.sample_id, count(*) AS n, sum(f.tokens) AS tokens,
                   string_agg('[EVIDENCE E' || pos || ']' || chr(10) || 'file: ' || file || chr(10) || 'function: ' || f.name || chr(10) || 'line: ' || line
                   || chr(10) || chr(10) || {_STRIP.replace('{t}', 'text')} || chr(10) || '[/EVIDENCE]', chr(10) ORDER BY pos) AS evidence
            FROM fill f JOIN pool p ON f.name = p.name GROUP BY f.sample_id),
        packs AS (
            SELECT a.*, coalesce(n, 0) AS n, coalesce(tokens, 0) AS evidence_tokens,
                   '=== TARGET FUNCTION ===' || chr(10) || {_STRIP.replace('{t}', 'body')}
                   || coalesce(chr(10) || chr(10) || '=== CONTEXT (selected functions, raw source) ===' || chr(10) || evidence, '') AS pack
            FROM aimed a LEFT JOIN blocks b ON a.sample_id = b.sample_id)
        SELECT sample_id, item_id AS pair_id, CAST(item_id % 2 AS INT) AS label, 'C1' AS selector, 'R0' AS representation, 'text' AS encoding, CAST({BUDGET} AS INT) AS budget, 'ts' AS backend,
               CAST(-1 AS INT) AS prediction, CAST({_tokens('body')} AS BIGINT) AS target_tokens, CAST({_tokens('pack')} + {int(len(SYSTEM_PROMPT.split()) * 1.3)} AS BIGINT) AS prompt_tokens_total,
               CAST({_tokens('pack')} AS BIGINT) AS pack_tokens, CAST(evidence_tokens AS BIGINT) AS n_evidence_tokens,
               (SELECT count(*) FROM pool) - (SELECT count(*) FROM pool p WHERE p.name = own) AS n_candidates_pool, n AS n_candidates_selected, CAST(0 AS INT) AS n_backend_failures FROM packs""",
    "target_line": """
        WITH one AS (SELECT 's' || (doc_id % 300) AS name, arg_min(CAST(doc_id % 50 AS INT), (source, doc_id)) AS line FROM documents GROUP BY 1)
        SELECT CAST(doc_id AS VARCHAR) AS sample_id, CAST(nullif(line, 0) AS VARCHAR) AS target_line FROM documents LEFT JOIN one ON name = 's' || (doc_id % 400)""",
    "function_facts": """
        SELECT CAST(p_partkey AS VARCHAR) AS sample_id, CASE WHEN p_partkey % 5 > 0 THEN 'fn_' || p_partkey END AS name,
               CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'init_' || p_size || ',hit_' || p_partkey || ',miss,step,done' ELSE 'own_' || p_partkey || ',next' END AS calls,
               CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN '3,4,5,7,10,11,12' ELSE '3' END AS rows, p_partkey % 5 = 0 AS missed FROM part""",
    "calls_extract": f"""
        WITH f AS ({_C_CALLS}), c AS (SELECT name, file, line, unnest(range(5)) AS place, unnest(['init_' || p_size, 'hit_' || p_partkey, 'miss', 'step', 'done']) AS callee FROM f)
        SELECT name, file, line, CAST(place AS INT) AS place, callee FROM c""",
    "enclosing_conditions": f"""
        WITH f AS ({_C_CALLS})
        SELECT name, unnest(['init_' || p_size, 'hit_' || p_partkey, 'miss', 'step', 'done']) AS callee, unnest(['', 'a > ' || p_size, '!(a > ' || p_size || ')', 'a--', '']) AS conditions FROM f""",
    "keep_lines": f"""
        WITH f AS ({_C_CALLS})
        SELECT name, '3,4,5,7,10,11,12' AS rows,
               array_to_string(list_sort(['a', 'r', 'miss', 'step', 'done', name, 'init_' || p_size, 'hit_' || p_partkey]), ',') AS identifiers FROM f""",
    "pairwise_outcomes": f"WITH {_OUTCOMES} SELECT pair_id, outcome FROM outcomes WHERE cell IS NULL",
    "cell_metrics": f"""
        WITH {_OUTCOMES},
        p AS (
            SELECT cell, count(*) FILTER (WHERE outcome = 'P-C') AS P_C, count(*) FILTER (WHERE outcome = 'P-V') AS P_V, count(*) FILTER (WHERE outcome = 'P-B') AS P_B,
                   count(*) FILTER (WHERE outcome = 'P-R') AS P_R, count(*) FILTER (WHERE outcome = 'dropped') AS dropped FROM outcomes WHERE cell IS NOT NULL GROUP BY cell),
        m AS (
            SELECT cell, count(*) AS n_samples, count(*) FILTER (WHERE n_backend_failures = 0) AS clean,
                   CAST(count(*) FILTER (WHERE n_backend_failures = 0 AND prediction <> -1) AS DOUBLE) AS n,
                   CAST(count(*) FILTER (WHERE n_backend_failures = 0 AND label = 1 AND prediction = 1) AS DOUBLE) AS tp,
                   CAST(count(*) FILTER (WHERE n_backend_failures = 0 AND label = 0 AND prediction = 1) AS DOUBLE) AS fp,
                   CAST(count(*) FILTER (WHERE n_backend_failures = 0 AND label = 1 AND prediction = 0) AS DOUBLE) AS fn,
                   CAST(count(*) FILTER (WHERE n_backend_failures = 0 AND label = 0 AND prediction = 0) AS DOUBLE) AS tn FROM ledger GROUP BY cell)
        SELECT cell, n_samples, clean AS n_samples_excluding_backend_failures, P_C + P_V + P_B + P_R AS n_pairs, dropped AS n_pairs_dropped_unparsable, P_C, P_V, P_B, P_R,
               round(P_C / (P_C + P_V + P_B + P_R), 9) AS "pAcc", round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS "MCC",
               round(2 * tp / (2 * tp + fp + fn), 9) AS "F1", round(2 * (tp + fn) / (2 * (tp + fn) + fp + tn), 9) AS "F1_trivial", round(tp / (tp + fp), 9) AS precision,
               round(tp / (tp + fn), 9) AS recall, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round((tp + tn) / n, 9) AS accuracy,
               round((clean - n) / clean, 9) AS unparsable_rate FROM m JOIN p USING (cell)""",
    "f1_trivial": """
        WITH c AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
                          count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) AS pos FROM labels)
        SELECT n AS n_samples, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(2 * pos / (n + pos), 9) AS f1_trivial FROM c""",
    "cost_medians": f"""
        WITH ledger AS ({SQL_LEDGER})
        SELECT cell, round(avg(pack_tokens), 6) AS mean_pack_tokens, round(avg(n_evidence_tokens), 6) AS mean_evidence_tokens, round(avg(n_candidates_pool), 6) AS mean_candidates_pool,
               round(avg(n_candidates_selected), 6) AS mean_candidates_selected, round(avg(CASE WHEN n_backend_failures > 0 THEN 1.0 ELSE 0.0 END), 6) AS n_backend_failures_rate,
               median(index_time_s) AS median_index_time_s, median(build_time_cold_ms) AS median_build_cold_ms, median(build_time_warm_ms) AS median_build_warm_ms
        FROM ledger GROUP BY cell""",
    "latest_cell": "SELECT o_custkey || '_R0_b0_ts' AS cell, o_orderkey AS path, o_orderstatus FROM orders QUALIFY o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey)",
    "miss_counts": "SELECT coalesce(CASE WHEN l_partkey % 7 > 0 THEN 'p' || (l_partkey % 100) END, '<unnamed>') AS name, count(*) AS misses FROM lineitem WHERE l_linenumber > 2 GROUP BY 1",
    "cell_grid": f"""
        WITH {_BM25_RANKED}, {_TARGETS}, {_NEAR}, a AS (WITH {_fill('near')} SELECT *, 'C1' AS selector FROM fill), b AS (WITH {_fill('ranked')} SELECT *, 'S1' AS selector FROM fill)
        SELECT selector, count(DISTINCT sample_id) AS n_samples, count(*) AS n_selected, CAST(sum(tokens) AS BIGINT) AS n_tokens, max(used) AS most_used
        FROM (FROM a UNION ALL FROM b) GROUP BY selector""",
}
