"""DuckDB SQL that yields the rows of the queries that SQL can express."""

from __future__ import annotations

from graphloom.llm import line_dedup, mixing, quality_rules

# the characters that part words, as a SQL expression
WS = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _shingled(relation: str, key: str) -> str:
    """(key, shingle), distinct; a shorter sequence is its own only shingle."""
    return f"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
    FROM (SELECT {key}, {LOWERED} AS w FROM {relation})"""


def op1() -> str:
    lacks = lambda x, chars: f"(length({x}) - length(translate({x}, {chars}, '')))"
    marks, sentence, end, stock = (_quoted(x) for x in (quality_rules.MARKS, quality_rules.SENTENCE_MARKS, quality_rules.END_MARK, quality_rules.BOILERPLATE))
    upper, lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
    return f"""
    WITH base AS (SELECT doc_id, text IS NULL AS missing, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    lines AS (SELECT doc_id, missing, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM base),
    trimmed AS (SELECT doc_id, place, line, trim(line, {WS}) AS t FROM lines WHERE length(trim(line, {WS})) > 0),
    counted AS (SELECT *, {lacks("t", WS)} + 1 AS n FROM trimmed),
    judged AS (
        SELECT doc_id, place, line, length(line) AS chars,
            (n >= 4 AND NOT regexp_matches(right(t, 4), {end}) AND {lacks("t", sentence)} * 40 < n)
            OR {lacks("t", marks)} >= n * 0.25
            OR (contains(t, '!!') AND {lacks("t", upper)} > {lacks("t", lower)} * 0.5)
            OR (n <= 12 AND regexp_matches(t, {stock})) AS failed
        FROM counted),
    by_doc AS (
        SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup, count(*) FILTER (failed) AS n_failed,
            sum(chars) AS chars, coalesce(sum(chars) FILTER (failed), 0) AS lost
        FROM judged GROUP BY doc_id),
    clean AS (
        SELECT l.doc_id, CASE WHEN l.missing THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (NOT coalesce(j.failed, false)), '') END AS clean
        FROM lines l LEFT JOIN judged j USING (doc_id, place) GROUP BY l.doc_id, l.missing),
    windows AS (SELECT doc_id, i, w[i:i + 4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
    numbers AS (
        SELECT b.doc_id, len(w)::BIGINT AS n_words, length(translate(text, {WS}, ''))::BIGINT AS word_chars,
            {lacks("text", _quoted(quality_rules.SYMBOLS))}::BIGINT AS n_symbols, coalesce(d.n_dup, 0)::BIGINT AS n_dup_lines,
            coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(d.n_lines, 0) AS n_lines, coalesce(d.n_failed, 0) AS n_failed_lines,
            coalesce(d.chars, 0) AS chars, coalesce(d.lost, 0) AS lost
        FROM base b LEFT JOIN by_doc d USING (doc_id) LEFT JOIN covered c USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.3 * chars AS kept, n_lines::INT AS n_lines, n_failed_lines::INT AS n_failed_lines,
        length(clean)::BIGINT AS clean_chars, md5(clean) AS clean_md5
    FROM numbers JOIN clean USING (doc_id)"""


def op4() -> str:
    return f"""
    -- rows of equal text are one page, and a page that would lose all its words stays whole
    WITH page AS (SELECT DISTINCT source, coalesce(text, '') AS text FROM documents),
    lines AS (
        SELECT source, unnest(list_distinct(list_transform(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, {WS})) > 0), lambda x: trim(x, {WS})))) AS line
        FROM page),
    totals AS (SELECT source, count(*) AS pages FROM page GROUP BY source),
    found AS (
        SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
        GROUP BY l.source, l.line, t.pages HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > t.pages * {line_dedup.MAX_RATIO}),
    keyed AS (SELECT source, list(line) AS found FROM found GROUP BY source),
    done AS (
        SELECT doc_id, d.source, text, string_split(text, chr(10)) AS old,
            list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(k.found, []), trim(x, {WS}))) AS new
        FROM documents d LEFT JOIN keyed k ON d.source IS NOT DISTINCT FROM k.source)
    SELECT doc_id, source, CASE WHEN has THEN array_to_string(new, chr(10)) ELSE text END AS text, CASE WHEN has THEN len(old) - len(new) ELSE 0 END::BIGINT AS n_dropped
    FROM (SELECT *, coalesce(len(list_filter(new, lambda x: length(trim(x, {WS})) > 0)) > 0, false) AS has FROM done)"""


def op5() -> str:
    return f"""
    WITH RECURSIVE s AS ({_shingled("documents", "doc_id")}),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)"""


def op10() -> str:
    return f"""
    WITH d AS ({_shingled("documents", "doc_id")}), i AS ({_shingled("benchmark", "item_id")}),
    n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
    SELECT doc_id, item_id, count(*) AS n_shared, n_item FROM d JOIN i USING (shingle) JOIN n USING (item_id)
    GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item"""


def op9() -> str:
    block, shard, passes, seed = mixing.BLOCK_TOKENS, mixing.SHARD_TOKENS, mixing.MAX_PASSES, 7
    return f"""
    WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('{seed}:' || doc_id) AS o FROM documents),
    sources AS (
        SELECT source, sum(size)::BIGINT AS s, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w FROM sized GROUP BY source),
    whole AS (SELECT sum(s)::DOUBLE AS t FROM sources),
    -- the level at which capped and shared targets make up the total: the highest of those that each prefix of capped sources leaves
    levels AS (
        SELECT max(((SELECT t FROM whole) - coalesce((SELECT sum({passes} * b.s) FROM sources b WHERE b.s / b.w < a.s / a.w), 0))
                 / ((SELECT sum(w) FROM sources) - coalesce((SELECT sum(b.w) FROM sources b WHERE b.s / b.w < a.s / a.w), 0))) AS level
        FROM sources a),
    targets AS (SELECT source, s, least({passes}.0 * s, level * w) AS target FROM sources, levels),
    -- the least positive target has 16 blocks, unless a block would be less than a word
    blocks AS (SELECT greatest(1, least({block}, coalesce(floor(min(target) FILTER (target > 0) / {mixing.LEAST_BLOCKS}), {block})))::BIGINT AS block FROM targets),
    seats AS (
        SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source, k) AS r
        FROM (SELECT source, target, unnest(range(0, ceil({passes} * s / block::DOUBLE)::BIGINT)) AS k FROM targets, blocks)),
    quotas AS (SELECT source, count(*) AS quota FROM seats WHERE r <= (SELECT round(t / block) FROM whole, blocks) GROUP BY source),
    placed AS (
        SELECT d.*, t.s, t.target, coalesce(q.quota, 0) AS quota,
            ('0x' || substr(o, 1, 8))::BIGINT % ceil(greatest(t.s, 1) / {shard}.0)::BIGINT AS shard
        FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
    shards AS (SELECT source, shard, quota, sum(size)::BIGINT AS held FROM placed GROUP BY source, shard, quota),
    parts AS (
        SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY held / (2 * k + 1) DESC, shard, k) AS r
        FROM (SELECT *, unnest(range(0, ceil({passes} * held / block::DOUBLE)::BIGINT)) AS k FROM shards, blocks)),
    dealt AS (SELECT source, shard, count(*) FILTER (r <= quota) AS n FROM parts GROUP BY source, shard),
    ready AS (
        SELECT p.*, h.held, least(coalesce(e.n, 0) * (SELECT block FROM blocks), {passes} * h.held) AS take,
            sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS until
        FROM placed p JOIN shards h ON p.source IS NOT DISTINCT FROM h.source AND p.shard = h.shard
        LEFT JOIN dealt e ON p.source IS NOT DISTINCT FROM e.source AND p.shard = e.shard)
    SELECT doc_id, size, s AS source_size, target, (take // greatest(held, 1) * size + greatest(0, least(size, take % greatest(held, 1) - (until - size))))::BIGINT AS taken FROM ready"""


def op7() -> str:
    escaped = r"replace(text, '\', '\\')"
    for c in ("<|turn|>", "<|text|>", "</|turn|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"):
        escaped = f"replace({escaped}, '{c}', '{c[:-1]}\\{c[-1]}')"
    return f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(25 + length(role) + length({escaped}))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id"""


def oracles() -> dict[str, str]:
    return {"op1_quality_rules": op1(), "op4_line_dedup": op4(), "op5_minhash_near_dedup": op5(), "op7_chat_format": op7(), "op9_source_mixing": op9(), "op10_decontamination": op10()}
