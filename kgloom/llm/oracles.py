"""DuckDB SQL of passage removal, fill-in-the-middle and conversation repair, written from their rules."""

from __future__ import annotations

from . import conversation, fill_middle, passages
from .common import WORD

EMPTY = "sha256('')"

PASSAGES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
phrases AS (SELECT doc_id, s, array_to_string(ws[s:s + {passages.PHRASE - 1}], ' ') AS phrase
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {passages.PHRASE - 2})) AS s FROM d WHERE len(ws) >= {passages.PHRASE})),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, s) AS n FROM phrases) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM later, range(0, {passages.PHRASE}) AS r(k)),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(w.w, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS text
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _fill_middle() -> str:
    blank = r"[\x20\x09-\x0D]"
    word = blank.replace("[", "[^", 1)
    pattern = f"{blank}*{word}+|{blank}+"
    prefix, suffix, middle = fill_middle.MARKS
    draw = lambda k: f"('0x' || substr(sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::BIGINT"
    marked = " OR ".join(f"contains(t, '{m}')" for m in fill_middle.MARKS)
    length = lambda n: f"coalesce(list_sum(list_transform(tokens[1:{n}], lambda x: length(x))), 0)::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{pattern}') AS tokens, {", ".join(f"{draw(k)} AS h{k + 1}" for k in range(4))} FROM documents),
ranks AS (SELECT *, len(tokens) AS n, h1 % (len(tokens) + 1) AS x, h2 % (len(tokens) + 1) AS y,
  CASE WHEN t = '' OR {marked} OR h3 % 100 >= {fill_middle.CUT} THEN 'plain' WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
cut AS (SELECT *, {length("least(x, y)")} AS a, {length("greatest(x, y)")} AS b FROM ranks),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{prefix}' || p || '{suffix}' || s || '{middle}' || m ELSE '{suffix}' || s || '{prefix}' || p || '{middle}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def _repair() -> str:
    c = conversation
    # CRC-32, bit by bit
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    # a path: its cost, its letters and the rows it writes; the least path is the first by cost, then by letters
    add = lambda s, cost, letter, wrote: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': {wrote}}} END"
    put = lambda s, role: f"list_append({s}.o, {role} || ':')"
    insert = lambda s, role: add(s, c.INSERT, "I", put(s, f"'{role}'"))
    delete = lambda s: add(s, c.DELETE, "D", f"{s}.o")
    more = f"(CASE WHEN fault = {c.TRUNCATED} THEN {c.UNFINISHED} ELSE 0 END)"
    stays = f"fault IN ({c.NONE}, {c.TRUNCATED})"
    row = lambda s, role: f"list_append({s}.o, {role} || ':' || text)"
    keep = lambda s, x: f"CASE WHEN {stays} AND x = '{x}' THEN {add(s, more, 'K', row(s, 'role'))} END"
    change = lambda s, role: "CASE WHEN " + stays + " THEN " + add(s, f"({c.REROLE} + {more})", "R", row(s, f"'{role}'")) + " END"
    least = lambda *paths: f"list_min([{', '.join(paths)}])"
    closed = lambda columns, table: f"(SELECT *, {least('s3', insert('t2', 'assistant'))} AS t3 FROM (SELECT {columns}, {least('s2', insert('s0', 'user'), insert('s1', 'user'), insert('s3', 'user'))} AS t2 FROM {table}))"
    none = "CASE WHEN false THEN {'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]} END"
    return f"""
WITH RECURSIVE drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM drawn),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
l AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS x, substr(role, 1, 1) || lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair,
  CASE WHEN NOT regexp_matches(text, '{WORD}') THEN {c.BLANK} WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN {c.DUPLICATE}
       WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN {c.TRUNCATED} ELSE {c.NONE} END AS fault FROM numbered),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {c.BLANK}) AS blank, count(*) FILTER (fault = {c.DUPLICATE}) AS duplicate,
  count(*) FILTER (fault = {c.TRUNCATED}) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM l GROUP BY conv_id),
paths AS (
  SELECT conv_id, 1::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM told
  UNION ALL
  SELECT conv_id, i + 1, {delete('s0')}, {least(delete('s1'), keep('s0', 's'))},
    {least(delete('t2'), keep('s0', 'u'), keep('s1', 'u'), keep('t3', 'u'), change('s0', 'user'), change('s1', 'user'), change('t3', 'user'))},
    {least(delete('t3'), keep('t2', 'a'), change('t2', 'assistant'))}
  FROM {closed('*', '(SELECT p.*, l.role, l.text, l.x, l.fault FROM paths p JOIN l ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.i = l.i)')}),
ended AS (SELECT conv_id, {least('s0', 't3')} AS best FROM {closed('p.*', 'paths p JOIN told t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.i = t.n + 1')})
SELECT q.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal,
  coalesce(e.best.c, 0) AS cost, coalesce(e.best.a, '') AS audit, sha256(coalesce(array_to_string(e.best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN told t ON q.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN ended e ON q.conv_id IS NOT DISTINCT FROM e.conv_id
"""


FILL_MIDDLE, REPAIR = _fill_middle(), _repair()
