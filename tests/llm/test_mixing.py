import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from panelwright.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def rows_of_all_kinds():
    rng = random.Random(5)
    rows = [(i, rng.choice(["web", "web", "web", "books", "code", "Zine"]), " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(500, None, "null source is a source"), (501, "", "empty name"), (502, "none", None), (503, "none", " \t\n "), (None, "web", "no id here")]
    rows += [(504, "über", "tab\tand\x0bline\nends stay one"), (505, "books", "long " * 30_000)]
    return rows + [(7, "web", "same row twice")] * 2 + [(8, "web", "x y"), (9, "web", "x y")]


def brute(rows, weights=(5, 2, 1), budget=1.5, repeats=2):
    """The queue served copy by copy."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for _, _, text in rows]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows) if r[1] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    capped = set()
    while True:
        left = sum(sizes) * budget - sum(repeats * total[s] for s in capped)
        open_weight = sum(weight[s] for s in sources if s not in capped)
        level = left / open_weight if open_weight else 0
        more = {s for s in sources if s not in capped and repeats * total[s] < weight[s] * level}
        if not more:
            break
        capped |= more
    target = {s: float(repeats * total[s]) if s in capped else weight[s] * level for s in sources}
    copies = []
    for s in sources:
        own = [i for i, r in enumerate(rows) if r[1] == s and sizes[i]]
        key = {i: hashlib.md5("|".join(["0", "" if rows[i][0] is None else str(rows[i][0]), rows[i][2]]).encode()).hexdigest() for i in own}
        before = 0
        for i in sorted(own, key=lambda i: (key[i], i)):
            before += sizes[i]
            copies += [((c * total[s] + before) / target[s], s is None, s or "", key[i], c, i) for c in range(repeats) if target[s]]
    room, taken = int(sum(target.values())), [0] * len(rows)
    for *_, i in sorted(copies):
        served = min(sizes[i], room)
        taken[i] += served
        room -= served
    return sizes, total, target, taken


@pytest.mark.parametrize("options", [{}, {"weights": (1, 3), "budget": 0.4}, {"budget": 5.0}, {"repeats": 3, "budget": 2.5}])
def test_against_a_plain_queue(spark, options):
    rows = rows_of_all_kinds()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("clash"), "row": F.lit(1), "key": F.lit(2), "taken": F.lit(3)})
    sizes, total, target, taken = brute(rows, **options)
    got = mixing.mixed_sizes(docs.repartition(5), **options).collect()
    want = sorted((str(r[0]), n, total[r[1]], round(target[r[1]], 6), t) for r, n, t in zip(rows, sizes, taken))
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == want
    # Each source comes within one document of its target, none is taken more often than allowed.
    for s in {r[1] for r in rows}:
        own = [(n, t) for r, n, t in zip(rows, sizes, taken) if r[1] == s]
        assert abs(sum(t for _, t in own) - target[s]) <= max(n for n, _ in own) + 1
        assert all(t <= options.get("repeats", 2) * n for n, t in own)


def test_reruns_agree_and_other_columns_stay(spark):
    rows = rows_of_all_kinds()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("mine"), "taken": F.lit("old")})
    once = sorted(map(tuple, mixing.mixed_sizes(docs.repartition(3)).collect()), key=repr)
    assert once == sorted(map(tuple, mixing.mixed_sizes(docs.repartition(11)).collect()), key=repr)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == ["doc_id", "source", "text", "row", "size", "source_size", "target", "taken"]
    got = mixed.collect()
    assert all(r["taken"] > 0 and r["row"] == "mine" for r in got)
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r[0]), r[4]) for r in once if r[4])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed_sizes(empty).collect() == [] and mixing.mix_sources(empty).collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mixed_sizes(blank).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix_sources(blank).collect() == []
