import hashlib
import re

import pytest
from pyspark.sql import functions as F

from panelwright.llm import personal_data, registry, secrets
from panelwright.llm.spans import find_spans


def luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(odd)) % 10 == 0


def n_digits(s):
    return len(re.sub("[^0-9]", "", s))


def private(text):
    """Base spans by kind, by the plain patterns."""
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= n_digits(m[0]) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= n_digits(m[0]) <= 15),
    }
    return {k: [(k, *m.span()) for m in re.finditer(p, text or "") if ok(m)] for k, (p, ok) in rules.items()}


def secret(text):
    rules = {
        "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    return {k: [(k, *m.span()) for m in re.finditer(p, text or "") if ok(m)] for k, (p, ok) in rules.items()}


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


TEXTS = [
    None, "", "x" * 3000, "a@b.c_d@e.f", "x@a.b_c@d.e.f @ a@b a.@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "9" * 5000,
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+1 (549) 555-8300 +1 2 +12345678.+1 22 33 44 55 )", "+1((((( +1234567890123456",
    "é😀 me@x.org 😀 10.0.0.1", "password=abc token: secret:token:abcdefgh", "API_KEY = 'abcdef' apikey:abcde", "Token=\"" + "a1" * 15 + "\" AKIA" + "Z" * 16,
    "AKIAAKIA" + "B" * 12 + " AKIA" + "B" * 15, "deadbeef" * 3 + "g" + "0" * 23, "PassWord  :  qwerty.+/=", " ".join(f"a{i}@b.c 1.2.3.{i % 300}" for i in range(600)),
    "a\rb\n\u0085 u1@h.io x", "secret=" * 5,
]


def test_spans_are_those_of_a_plain_search(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for pattern in (r"[0-9]+", r"a", r"(?<!\S)\S+"):
        got = df.select("i", find_spans(F.col("t"), pattern).alias("s")).collect()
        for r in got:
            text = TEXTS[r["i"]] or ""
            found = [text[s["start"] : s["stop"]] for s in r["s"]]
            assert found == [s["hit"] for s in r["s"]]
            if pattern != r"(?<!\S)\S+":
                assert [(s["start"], s["stop"]) for s in r["s"]] == [m.span() for m in re.finditer(pattern, text)]


@pytest.mark.parametrize("name,op,rule", [("p", personal_data.personal_data, private), ("s", secrets.secrets, secret)])
def test_base_spans(spark, name, op, rule):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "a@b.cd password=abcdefg", 1, "x"), (3, TEXTS[3], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, print int, kind string")
    got = op(df).collect()
    assert len(got) == len(rows)
    for r in got:
        kinds = rule("a@b.cd password=abcdefg" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        assert {k: r[f"n_{k}"] for k in kinds} == {k: len(v) for k, v in kinds.items()}, r
        if name == "p":
            base = [s for k in kinds for s in kinds[k]]
        else:
            order = list(kinds)
            base = sorted((s for k in kinds for s in kinds[k]), key=lambda s: (s[1], order.index(s[0])))
        assert r["base_sha256"] == sha(joined(base)), (r["doc_id"], base)
        assert set(joined(base).split(",")) - {""} <= set(r["spans"].split(","))
    assert op(df.limit(0)).collect() == []


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Some text. Write to person{i}@mail.org today. Room {i} here.") for i in range(30)]
    rows += [(100, "Please write to bob(at)mail4you today"), (101, "the room 12 and write it 7")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal_data.personal_data(df).collect()}
    assert got[100]["spans"] == "email:16:31" and got[100]["n_email"] == 0 and got[100]["n_found"] == 1
    assert got[101]["spans"] == "" and got[5]["n_found"] == 0


def test_weak_parts_need_complements(spark):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    rows = [
        (1, f"AKIA{'Q' * 16} {key} https://host.example/x"),
        (2, f"some {key} alone https://host.example/x"),
        (3, f"AKIA{'Q' * 16}" + " " * 400 + key),
        (4, f"login: admin password: hunter22"),
        (5, "login: admin"),
        (6, f"AKIA{'Q' * 16}" + " " * 250 + key),
    ]
    got = {r["doc_id"]: r for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_linked"] for i in range(1, 7)] == [2, 0, 0, 1, 0, 1]
    assert got[1]["spans"].split(",")[1] == f"value:21:{21 + len(key)}"
    assert got[4]["spans"] == "user:0:12,assign:13:31"


def test_values_after_an_equals_sign_and_long_values(spark):
    key, access = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "AKIA" + "Q" * 16
    storage = "a1B2" * 21 + "ab=="
    token = "x9Y" * 3000
    rows = [
        (1, f"AWS_ACCESS_KEY_ID={access}\nAWS_SECRET_ACCESS_KEY={key}"),
        (2, f"{access} {storage}"),
        (3, f"{access} AccountKey={storage};x"),
        (4, f"{access} {token}"),
        (5, f"key={key}"),
        (6, f"{access} {'x' * 200} {'7' * 200}"),
    ]
    got = {r["doc_id"]: r for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, text), value in zip(rows, [key, storage, storage, token], strict=False):
        start = text.index(value)
        assert got[i]["spans"].endswith(f",value:{start}:{start + len(value)}") and got[i]["n_linked"] == 1, i
    assert got[5]["n_linked"] == got[6]["n_linked"] == 0


@pytest.mark.parametrize("name,rule", [("op7_personal_data", private), ("op8_secrets", secret)])
def test_queries_against_plain_search(spark, name, rule):
    sf = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in registry.table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = registry.QUERIES[name](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        kinds = rule(texts[r["doc_id"]])
        assert {k: r[f"n_{k}"] for k in kinds} == {k: len(v) for k, v in kinds.items()}
