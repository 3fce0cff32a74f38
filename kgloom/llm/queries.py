"""The queries of the training-data operators, each over a whole table, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation, fill_middle, fingerprint, language, line_dedup, media, mixing, oracles, packing, passages, pii, secret_scan, simhash, toxicity
from .common import read_table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_fingerprints(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_languages(read_table(spark, sf_dir, "documents"))
    held_out = F.pmod(language.crc_of_id(), F.lit(language.FOLDS)) == language.HELD_OUT_FOLD
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_edit(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.passage_report(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_report(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media, op2_toxicity, op3_secrets, op4_mixing, op5_line_dedup, op6_pii, op7_language, op8_simhash, op9_fingerprint, op10_packing, op11_passages, op12_fill_middle, op13_conversations)}

def _secrets_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    found = lambda name, pattern, keep: f"""
{name}_m AS (SELECT doc_id, regexp_extract_all(text, '{quoted(pattern)}') AS ms, regexp_split_to_array(text, '{quoted(pattern)}') AS ps FROM d WHERE regexp_matches(text, '{quoted(pattern)}')),
{name}_u AS (SELECT doc_id, unnest(range(len(ms))) AS k, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p FROM {name}_m),
{name} AS (SELECT doc_id, s, s + length(m) AS e, m FROM (SELECT doc_id, m, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT - length(m) AS s FROM {name}_u) WHERE {keep})"""  # noqa: E731
    same = "|".join(f"{c if c.isalnum() else chr(92) + c}{{8}}" for c in "0123456789abcdefghijklmnopqrstuvwxyz+/_-")
    part = quoted(secret_scan.PART.replace("(.)" + chr(92) + "1{7}", same))
    size = secret_scan.WINDOW
    runs, highs = [], []
    for name, (chars, threshold) in secret_scan.CLASSES.items():
        runs.append(found(name, f"{chars}{{{size},}}", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"))
        most = size * (math.log2(size) - threshold) + 1e-9
        c = f"({size} - length(replace(w, x, '')))"
        highs.append(f"SELECT doc_id, s + i AS s, s + i + {size} AS e FROM (SELECT doc_id, s, i, substr(m, i + 1, {size}) AS w FROM (SELECT doc_id, s, m, unnest(range(length(m) - {size - 1})) AS i FROM {name})) WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda x: {c} * log2({c}))) <= {most!r} AND NOT regexp_matches(w, '{part}')")
    uuid = quoted(secret_scan.WHOLE[2])
    suspicious = lambda x: f"regexp_matches({x}, '[0-9]') AND regexp_matches({x}, '[A-Za-z]') AND NOT regexp_matches({x}, '{uuid}')"
    kinds = ", ".join(f"'{k}'" for k in secret_scan.KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),{found("assign", secret_scan.ASSIGN, f"length(regexp_extract(m, '{quoted(secret_scan.ASSIGN)}', 2)) >= {secret_scan.LEAST_VALUE}")},
{found("access", secret_scan.ACCESS, "true")},{found("hexes", secret_scan.HEX, "true")},{",".join(runs)},
base AS (SELECT doc_id, s, 0 AS kind, e FROM assign UNION ALL SELECT doc_id, s, 1, e FROM access UNION ALL SELECT doc_id, s, 2, e FROM hexes),
high AS ({" UNION ALL ".join(highs)}),
edge AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < s, true) AS new FROM high),
island AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s, e) AS n FROM edge),
merged AS (SELECT * FROM (SELECT i.doc_id, i.s, i.e, d.text, substr(d.text, i.s + 1, i.e - i.s) AS x FROM (SELECT doc_id, min(s) AS s, max(e) AS e FROM island GROUP BY doc_id, n) i JOIN d ON i.doc_id = d.doc_id) WHERE {suspicious("x")}),
around AS (SELECT m.doc_id, m.s, m.e, greatest(m.s - {size}, b.s) AS first, substr(m.text, greatest(m.s - {size}, b.s) + 1, least(m.e + {size}, b.e) - greatest(m.s - {size}, b.s)) AS w FROM merged m JOIN base64 b ON m.doc_id = b.doc_id AND b.s <= m.s AND m.e <= b.e),
part_m AS (SELECT doc_id, s, e, first, regexp_extract_all(w, '{part}') AS ms, regexp_split_to_array(w, '{part}') AS ps FROM around WHERE regexp_matches(w, '{part}')),
part_u AS (SELECT doc_id, s, e, first, unnest(range(len(ms))) AS k, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p FROM part_m),
parts AS (SELECT doc_id, s, e, stop - length(m) AS ps, stop AS pe FROM (SELECT *, first + sum(length(p) + length(m)) OVER (PARTITION BY doc_id, s ORDER BY k)::BIGINT AS stop FROM part_u)),
cuts AS (SELECT doc_id, s, e, ps AS cs, pe AS ce, false AS taken FROM parts WHERE ps < e AND s < pe
  UNION ALL SELECT m.doc_id, m.s, m.e, b.s, b.e, true FROM merged m JOIN base b ON m.doc_id = b.doc_id AND b.s < m.e AND m.s < b.e),
gaps AS (SELECT doc_id, s, e, greatest(s, coalesce(max(ce) OVER (PARTITION BY doc_id, s ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS f, cs AS t FROM cuts
  UNION ALL SELECT m.doc_id, m.s, m.e, greatest(m.s, coalesce(max(c.ce), m.s)), m.e FROM merged m LEFT JOIN cuts c ON m.doc_id = c.doc_id AND m.s = c.s GROUP BY m.doc_id, m.s, m.e),
more AS (SELECT doc_id, f AS s, CASE WHEN taken THEN 4 ELSE 3 END AS kind, t AS e FROM
  (SELECT g.doc_id, g.f, g.t, substr(d.text, g.f + 1, g.t - g.f) AS x, EXISTS (SELECT 1 FROM cuts c WHERE c.doc_id = g.doc_id AND c.s = g.s AND c.taken) AS taken FROM gaps g JOIN d ON g.doc_id = d.doc_id WHERE g.f < g.t) WHERE {suspicious("x")}),
named AS (SELECT doc_id, s, kind, e, [{kinds}][kind + 1] || ':' || s || ':' || e AS t FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
told AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, count(*) FILTER (kind = 3) AS n,
  string_agg(t, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind, e) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_entropy
FROM d LEFT JOIN told ON d.doc_id = told.doc_id
"""


ORACLE: dict[str, str] = {
    "op3_secrets": _secrets_sql(),
    "op11_passages": oracles.PASSAGES,
    "op12_fill_middle": oracles.FILL_MIDDLE,
    "op13_conversations": oracles.REPAIR,
    "op5_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
filled AS (
  SELECT doc_id, i, trim(translate(line, chr(9) || chr(13), '  ')) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
  FROM lines WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> ''),
three AS (
  SELECT doc_id, pos, t AS x, lead(t, 1) OVER w AS y, lead(t, 2) OVER w AS z FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS n FROM three WHERE z IS NOT NULL) WHERE n > 1),
gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM filled f JOIN (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM later) c ON f.doc_id = c.doc_id AND f.pos = c.pos),
marked AS (SELECT l.doc_id, l.i, l.line, g.i AS gone FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(gone) AS n_removed, coalesce(string_agg(gone::VARCHAR, ',' ORDER BY i), '') AS removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.removed, '') AS removed, k.text AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
}
