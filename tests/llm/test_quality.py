import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import quality, registry

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Train without a fifth of the labels; judge on that fifth."""
    docs, labels = registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = quality.train(docs, labels.filter(~held))
    assert [r["round"] for r in model.rounds] == [0, 1, 2] 
    # Both views teach, in each round, at least the shares they are most confident of.
    unlabelled = docs.count() - quality.truths(labels.filter(~held)).count()
    for r in model.rounds[1:]:
        assert r["pseudo_meta"] >= 0.09 * unlabelled and r["pseudo_words"] >= 0.09 * unlabelled
    truth = quality.truths(labels.filter(held))
    got = quality.scored(docs, model).join(truth, F.col("doc_id") == F.col("label_id"))
    rows = got.select("good", "accepted").collect()
    kept = [r["accepted"] for r in rows if r["good"]]
    gone = [not r["accepted"] for r in rows if not r["good"]]
    assert sum(kept) / len(kept) > 0.9 and sum(gone) / len(gone) > 0.8


def test_pseudo_labels_against_one_fit(spark):
    """The loss that Spark adds up over partitions is the plain sum, and a fit with it moves towards what is taught."""
    rng = np.random.default_rng(3)
    lists = [sorted(rng.choice(50, 6, replace=False).tolist()) for _ in range(400)]
    target = np.array([0.9 if 7 in x else 0.2 for x in lists])
    df = spark.createDataFrame(list(zip(lists, target.tolist())), "meta array<int>, said double").repartition(7)
    w = rng.normal(size=51)
    value, slope = quality.pseudo_loss(df, "meta")(w)
    margins = np.array([w[x].sum() + w[-1] for x in lists])
    error = 1 / (1 + np.exp(-margins)) - target
    want = np.array([sum(e for e, x in zip(error, lists) if i in x) for i in range(50)] + [error.sum()])
    assert np.isclose(value, (np.log1p(np.exp(margins)) - target * margins).sum()) and np.allclose(slope, want)
    features, first = np.arange(40) % 6, np.arange(0, 41, 2)
    plain = quality.fit(features, first, np.tile([0.0, 1.0], 10), 50)
    taught = quality.fit(features, first, np.tile([0.0, 1.0], 10), 50, more=(400, quality.pseudo_loss(df, "meta"), 0.5))
    assert abs(plain[7]) < 1e-6 and taught[7] > 0.05


def test_awkward_rows(spark):
    rows = [(i, "nice calm words here " * 5 if i % 2 else "bad ugly stuff !!", "en", None, i) for i in range(60)]
    rows += [(None, None, None, None, None), (61, "", "en", "s", None), (62, "x" * 200_000, "en", "s", -5)] + [(1, "nice", "en", "s", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({"score": F.lit("x"), "good": F.lit(1), "words": F.lit(2), "place": F.lit(3)})
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(50)] + [(None, 1, 0), (1, None, None), (200, 0, 0), (3, 1, None)],
        "doc_id long, quality int, toxic int",
    )
    model = quality.train(df, labels)
    got = quality.scored(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["accepted"] == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and 1 < r["doc_id"] < 60)
    # No labels, or an empty table: everything is accepted.
    assert quality.train(df, labels.limit(0)) is None and quality.train(df.limit(0), labels) is None
    assert quality.scored(df, None).filter("accepted").count() == len(rows)
