import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import linking, near_duplicates, registry
from panelwright.llm.words import mixed


def run(df):
    return {r["doc_id"]: r for r in near_duplicates.near_duplicates(df).collect()}


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r[0]: r[1] for r in registry.table(spark, sf, "documents").select("doc_id", "text").collect()}
    want = brute.near_duplicate_classes(docs)
    got = registry.QUERIES["op10_near_duplicates"](spark, sf).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert {r["doc_id"] for r in got if r["kept"]} == set(want.values())


@pytest.mark.parametrize("m", [128])
def test_signatures_are_unbiased(m):
    a = np.array([1, 1, 1, 1, 1, 2, 2, 3, 4, 4, 4], dtype=np.uint64)
    b = np.array([1, 1, 1, 2, 2, 2, 2, 3, 5], dtype=np.uint64)
    # minima 3 + 2 + 1 = 6, maxima 5 + 4 + 1 + 3 + 1 = 14
    equal = []
    for trial in range(60):
        salt = mixed(np.arange(1, 2, dtype=np.uint64) * np.uint64(trial + 1))
        hashes = mixed(np.concatenate([a, b]) + salt)
        bags = np.array([0] * len(a) + [1] * len(b))
        one, two = near_duplicates.signatures(bags, hashes, 2, m)
        equal.append((one == two).mean())
    assert abs(np.mean(equal) - 6 / 14) < 0.02


def test_awkward_rows(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, body), (1, body), (2, body.upper()), (3, body.replace("w30 ", "x ")), (4, None), (5, ""), (6, "--- !!"),
        (7, "one"), (8, "One."), (9, "two"), (None, body), (10, "a " * 40), (11, "a " * 41), (12, "a " * 4),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Extra columns with the names of results do no harm.
    df = df.withColumns({"class_id": F.lit("x"), "id": F.lit(0), "h1": F.lit(0), "label": F.lit("l")})
    got = near_duplicates.near_duplicates(df).collect()
    classes = {(r["doc_id"]): r["class_id"] for r in got}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, None: 1, 10: 10, 11: 10, 12: 12}
    assert {r["class_size"] for r in got if r["class_id"] == 1} == {5}
    kept = near_duplicates.drop_near_duplicates(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 4, 5, 6, 7, 9, 10, 12]
    assert kept.columns == df.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates.near_duplicates(df).collect() == []
    assert near_duplicates.drop_near_duplicates(df).collect() == []


def test_buckets_keep_all_links(spark):
    """Links that no pivot sees are found: neighbours on a line are linked, all share one bucket."""
    n = 40
    members = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id"))

    def verify(pairs):
        return pairs.filter("b - a = 1 and a <> 19")

    def rest(still_open):
        return linking.across_labels(still_open, "key")

    labels = {r["id"]: r["label"] for r in linking.group_buckets(spark.createDataFrame([], "a long, b long"), members, verify, rest).collect()}
    assert labels == {i: 0 if i < 20 else 20 for i in range(n)}


def test_group_of_near_copies(spark):
    """Copies with more and more edits: chains of links, and texts that share bands without a link."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for i in range(120):
        words = list(base)
        for at in rng.choice(150, size=rng.integers(0, 9), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {i: r["class_id"] for i, r in run(df).items()}
    assert got == brute.near_duplicate_classes(docs)
    assert len(set(got.values())) > 5
