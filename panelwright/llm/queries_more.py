"""Registered queries over pages and vectors, of token files and of the quality classifier."""

from __future__ import annotations

from panelwright.llm import html_text, neighbours, quality, token_files
from panelwright.llm.registry import query, table


@query()
def op3_main_text(spark, sf_dir):
    """Every page with its main text, by the container path its host agrees on."""
    return html_text.main_texts(table(spark, sf_dir, "pages"))


@query()
def op1_quality(spark, sf_dir):
    """Every document with the scores of both co-trained views and of both together."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = quality.scored(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    return found.select("doc_id", "text_score", "meta_score", "score", "accepted")


@query()
def op4_token_counts(spark, sf_dir):
    """Every document's tokens, counted in flat token files of the whole table."""
    found = token_files.token_counts(table(spark, sf_dir, "documents"))
    return found.select("path", "doc_no", "start", "n_tokens", "ended")


@query()
def op5_nearest_neighbours(spark, sf_dir):
    """The 20 nearest found for every twentieth vector, by greedy search in an NN-descent graph."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), 20, 20)
