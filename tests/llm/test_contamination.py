import hashlib
import re

import pytest
from pyspark.sql import functions as F

from panelwright.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"Wort{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "short item"), (3, None), (4, "..."), (None, "nameless passage here"), (2, "other words"), (10, "short item")]
ITEMS += [(100 + i, " ".join(f"Wort{j}" for j in range(i, i + 13))) for i in range(0, 20, 3)]
DOCS = [
    (1, "x " * 30 + LONG + " y"), (2, "Short, ITEM! and more"), (2, "Short, ITEM! and more"), (3, None), (4, ""), (5, "!?"),
    (6, "filler " * 500 + "short item"), (7, "a nameless passage here"), (None, "other  words"), (8, "clean text"),
    (9, " ".join(LONG.split()[5:19]) + " \u00e9t\u00e9 " + " ".join(LONG.split()[:12])), (10, "short short item item"), (11, "z" * 300_000 + " short item"),
]


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text):
    own, hit, items = words(text), set(), set()
    for item, passage in ITEMS:
        w = words(passage)
        size = min(13, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else ()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                items.update([] if item is None else [str(item)])
    ids = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(own), len(hit), len(items), ids, bool(hit) and 20 * len(hit) >= len(own)


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "window": F.lit(1), "item": F.lit(2)})
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_rows", [200_000, 20, 7])
def test_against_plain_loops(spark, block_rows):
    docs, items = tables(spark)
    got = contamination.contamination(docs, items, block_rows=block_rows).collect()
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = sorted((str(r["doc_id"]), *[r[c] for c in names]) for r in got)
    assert found == sorted((str(i), *brute(text)) for i, text in DOCS)
    assert all(r["n_hit"] == sum(r["runs"][1::2]) - sum(r["runs"][::2]) for r in got)


@pytest.mark.parametrize("block_rows", [200_000, 7])
def test_removal(spark, block_rows):
    docs, items = tables(spark)
    kept = contamination.decontaminate(docs, items, block_rows=block_rows)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in DOCS if not brute(t)[4])
    cut = {r["doc_id"]: r["text"] for r in contamination.decontaminate(docs, items, remove="span", block_rows=block_rows).collect()}
    assert cut[1] == "x " * 30 + " y" and cut[2] == "! and more" and cut[None] == "" and cut[3] is None and cut[8] == "clean text"
    assert cut[9] == " \u00e9t\u00e9 " + " ".join(LONG.split()[:12]) and cut[6] == "filler " * 500 + "short item"


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert contamination.contamination(docs.limit(0), items).collect() == []
    assert contamination.decontaminate(docs, items.limit(0)).count() == len(DOCS)
    assert contamination.decontaminate(docs.limit(0), items, block_rows=7).collect() == []
    with pytest.raises(ValueError):
        contamination.decontaminate(docs, items, remove="nothing")
