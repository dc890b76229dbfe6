import base64
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from panelwright.llm import registry, token_files


def plain(tokens, separator):
    """(start, n_tokens, ended) of each document."""
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == separator:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(tokens) - start, False)] if start < len(tokens) else [])


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_scan_against_a_plain_loop(spark, tmp_path, monkeypatch, block_bytes):
    monkeypatch.setattr(token_files, "GROUP", 3)
    rng = np.random.default_rng(0)
    cases = [rng.integers(0, n, size=k) for n, k in ((3, 200), (40, 300), (2, 50), (9, 0), (1, 7), (500, 90))]
    rows = []
    for i, tokens in enumerate(cases):
        path = tmp_path / f"{block_bytes}-{i}.bin"
        path.write_bytes(tokens.astype("<u2").tobytes())
        rows.append((f"file://{path}", len(tokens), 2))
    files = spark.createDataFrame(rows, "path string, size long, width int")
    got = token_files.count_tokens(spark, files, 0, block_bytes).collect()
    for (path, _, _), tokens in zip(rows, cases, strict=True):
        mine = sorted((r for r in got if r["path"] == path), key=lambda r: r["doc_no"])
        assert [r["doc_no"] for r in mine] == list(range(len(mine)))
        assert [(r["start"], r["n_tokens"], r["ended"]) for r in mine] == plain(tokens.tolist(), 0)


def test_query_against_the_tokenizer(spark):
    sf = "/root/testdata/sf0.01"
    with open(token_files.TOKENIZER, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=token_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r[0] for r in registry.table(spark, sf, "documents").select("text").collect()]
    got = registry.QUERIES["op4_token_counts"](spark, sf).collect()
    assert Counter(r["n_tokens"] for r in got) == Counter(len(coder.encode_ordinary(t or "")) for t in texts)
    assert all(r["ended"] for r in got)


def test_awkward_tables(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",), ("a b",)], "text string").withColumn("path", F.lit("x"))
    got = token_files.token_counts(df).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 2, 2]
    assert token_files.token_counts(df.limit(0)).collect() == []
