import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwright.llm import registry, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string"


def vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    found = {}
    for w, n in words.items():
        close = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        found[w] = (best if best and words[best] >= 10 * n else None, n, len(close))
    out = {}
    for w, (form, n, n_near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out[w] = (form, root, n, n_near, words[form] if form else None)
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("x"), "n": F.lit(1), "run": F.lit(2), "id": F.lit(3)})
    got = spelling.spelling_variants(df, **options).collect()
    found = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in got}
    assert len(found) == len(got) and found == variants(vocabulary(rows))
    return found


def corpus(seed, letters="abé", n=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(n)]
    words = [w for w in base for _ in range(2 + (rng.random() < 0.1) * rng.randint(20, 400))]
    rng.shuffle(words)
    return [(i, " ".join(words[i::40])) for i in range(40)]


@pytest.mark.parametrize("state_words", [20_000, 60, 3])
def test_against_all_pairs(spark, state_words):
    """One acceptor for all words, edits made by joins at some initial states, and at nearly all."""
    found = check(spark, corpus(1), state_words=state_words)
    assert sum(x[0] is not None for x in found.values()) > 20 and max(x[3] for x in found.values()) >= 3


def test_awkward_rows(spark):
    long = "ab" * 3000
    rows = [(1, None), (2, ""), (None, "Letters letters LETTERS"), (3, "lettters aaaaaaa aaaaaaaa aaaaaaaaa"), (3, "lettters aaaaaaa aaaaaaaa aaaaaaaaa"),
            (4, f"{long} {long} {long}a {long}a x{long} x{long}"), (5, "Ünïcödé Ünïcödé ünïcödé ünïcödé naïveté×a"), (6, "1234567 12345678 abc-def")]
    rows += [(i, "letters " * 30) for i in range(10, 14)]
    check(spark, rows)
    check(spark, rows, state_words=2)
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_forms_lead_to_a_root(spark):
    """A chain of forms, each ten times as frequent, ends at the last; ties go to the least word."""
    rows = [(i, " ".join(["abcdefg"] * 2 + ["abcdefgh"] * 25 + ["abcdefghi"] * 300 + ["mnopqrst"] * 2 + ["mnopqrs"] * 40 + ["mnopqrt"] * 40)) for i in range(3)]
    found = check(spark, rows)
    assert found["abcdefg"][1] == "abcdefghi" and found["mnopqrst"][0] == "mnopqrs"


def test_minimal_acceptor():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops"})
    acceptor = spelling.Acceptor(words)
    assert len(acceptor.arcs) == 7 and acceptor.size[acceptor.root] == 6
    pairs = {(words[i], words[j]) for i, j in acceptor.near()}
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in [(a, b) for a in words for b in words if near(a, b)]}
    assert len(pairs) == len(acceptor.near())


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = registry.QUERIES["op11_spelling_variants"](spark, sf_dir).collect()
    want = variants(vocabulary(rows))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
