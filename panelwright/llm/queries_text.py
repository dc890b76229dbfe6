"""Registered queries over documents: near duplicates, contamination, mixing."""

from __future__ import annotations

from panelwright.llm import contamination as contaminated
from panelwright.llm import line_dedup, mixing, near_duplicates, personal_data, secrets
from panelwright.llm.registry import query, table

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query()
def op10_near_duplicates(spark, sf_dir):
    """Every document with its class of near duplicates (weighted Jaccard of 5-word runs >= 0.8)."""
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


OP6_SQL = rf"""
WITH items AS MATERIALIZED (
    SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark),
item_windows AS MATERIALIZED (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
doc_windows AS (
    SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS MATERIALIZED (
    SELECT d.r, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.win = b.win),
counts AS (
    SELECT r, count(DISTINCT p) AS n_hit
    FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
names AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN counts USING (r) LEFT JOIN names USING (r)
"""


@query(OP6_SQL)
def op6_benchmark_contamination(spark, sf_dir):
    """Every document with its words inside 13-word windows of benchmark items."""
    found = contaminated.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP9_SQL = r"""
WITH RECURSIVE sized AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
    FROM documents),
sources AS MATERIALIZED (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM sized GROUP BY source),
levels(step, level) AS (
    SELECT 0, CAST(0 AS DOUBLE)
    UNION ALL
    SELECT step + 1, (SELECT (1.5::DOUBLE * sum(source_size)
            - coalesce(sum(2 * source_size) FILTER (2 * source_size < weight * l.level), 0))
            / nullif(sum(weight) FILTER (NOT 2 * source_size < weight * l.level), 0) FROM sources)
    FROM levels l WHERE step <= (SELECT count(*) FROM sources) AND l.level IS NOT NULL),
found AS (SELECT level FROM levels ORDER BY step DESC LIMIT 1),
goals AS MATERIALIZED (
    SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE),
        coalesce(weight * (SELECT level FROM found), CAST(2 * source_size AS DOUBLE))) AS target
    FROM sources),
queued AS (
    SELECT s.*, g.source_size, g.target,
        coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source WHERE size > 0 AND target > 0),
copies AS (
    SELECT r, source, key, copy, size, CAST(copy * source_size + before + size AS DOUBLE) / target AS finish
    FROM queued, (VALUES (0), (1)) c(copy)),
served AS (
    SELECT r, size, coalesce(sum(size) OVER (ORDER BY finish, source IS NULL, source, key, copy, r
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM copies),
taken AS (
    SELECT r, sum(least(size, greatest(CAST(floor((SELECT sum(target) FROM goals)) AS BIGINT) - spent, 0))) AS taken
    FROM served GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN taken t ON s.r = t.r
"""


@query(OP9_SQL)
def op9_mixed_sources(spark, sf_dir):
    """Every document with the words that the mix takes of it, by weighted fair queueing."""
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


@query()
def op2_line_dedup(spark, sf_dir):
    """Every document without the fuzzy copies of lines that come earlier."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query()
def op7_personal_data(spark, sf_dir):
    """Every document with its personal data, base spans and those found by their contexts."""
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


@query()
def op8_secrets(spark, sf_dir):
    """Every document with its secrets, base spans and linked weak parts."""
    return secrets.secrets(table(spark, sf_dir, "documents"))
