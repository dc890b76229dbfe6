"""Registered queries of spelling variants, conversation repair and language-model scores."""

from __future__ import annotations

from panelwright.llm import conversations, language_model, spelling
from panelwright.llm.registry import query, table


@query()
def op12_conversation_repair(spark, sf_dir):
    """Every damaged conversation with its faults, its cheapest edits and the digest of the repaired text."""
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


#: crc32 of a text by its table, one byte after the other.
CRC_TABLE = """
crc(i, k, c) AS (
    SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS crc_list FROM crc WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of a SQL text, beside ``crc_table``."""
    byte = f"CAST(CAST('0x' || substr(hex(encode({text})), CAST(2 * x - 1 AS INT), 2) AS INT) AS BIGINT)"
    return (
        f"xor(list_reduce(list_transform(range(1, octet_length(encode({text})) + 1), lambda x: {byte}), "
        "lambda a, b: xor(a >> 8, crc_list[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
    )


OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
    SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, n, {crc_sql("id || ':' || run")} AS h FROM runs, crc_table),
words AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
shorter AS MATERIALIZED (
    SELECT word, n, i, left(word, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.i = b.i AND a.key = b.key AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.key = b.word
    UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.key = b.word),
best AS (
    SELECT word, count(*) AS n_near, min(struct_pack(neg := -n, near := near)) AS least FROM pairs GROUP BY word),
formed AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -least.neg >= 10 * w.n THEN least.near END AS form,
        CASE WHEN -least.neg >= 10 * w.n THEN -least.neg END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word),
followed(word, root, step) AS (
    SELECT word, word, 0 FROM formed
    UNION ALL SELECT f.word, g.form, step + 1 FROM followed f JOIN formed g ON f.root = g.word WHERE g.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM followed GROUP BY word)
SELECT f.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM formed f JOIN roots r ON f.word = r.word
"""


@query(OP11_SQL)
def op11_spelling_variants(spark, sf_dir):
    """Every word with its near words, its form and the root of its forms."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query()
def op13_language_scores(spark, sf_dir):
    """Every document with its log10 probability by word counts and by the context-mixing model."""
    found = language_model.held_out_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
