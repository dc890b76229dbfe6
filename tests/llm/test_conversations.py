import hashlib
import random
import zlib

from pyspark.sql import functions as F

from panelwright.llm import conversations, registry

SPACE = " \t\n\x0b\x0c\r"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """Rows (conv, turn, role, text) by conversation after the planned damage, in order of turns."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        mine = found.setdefault(conv, [])
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        if kind:
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(x, key=order) for c, x in found.items()}


def cheapest(rows):
    """(cost, audit) from the last row to the first, every edit tried; rows are (initial, must go, truncated)."""

    def with_inserts(plain):
        """Best ways from each state if up to four rows may be inserted first."""
        best = dict(plain)
        for _ in range(4):
            best = {
                state: min([plain[state], *[(best[STEP[state, x]][0] + 3, "I" + best[STEP[state, x]][1]) for x in "ua" if (state, x) in STEP]])
                for state in range(4)
            }
        return best

    never = (float("inf"), "")
    after = with_inserts({0: (0, ""), 1: never, 2: never, 3: (0, "")})
    for initial, must, truncated in reversed(rows):
        plain = {}
        for state in range(4):
            ways = [(after[state][0] + 4, "D" + after[state][1])]
            for letter, x, cost in [("K", initial, 0), ("R", "u", 3), ("R", "a", 3)]:
                if not must and (state, x) in STEP:
                    rest = after[STEP[state, x]]
                    ways.append((rest[0] + cost + 3 * truncated, letter + rest[1]))
            plain[state] = min(ways)
        after = with_inserts(plain)
    return after[0]


def report(rows):
    """{conv_id: result} for a table of conversations."""
    found = {}
    for conv, mine in damage(rows).items():
        seen, faults, string = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in mine:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            string.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(string, string[1:], strict=False))
        cost, audit = cheapest(tuple(string))
        out, state, at = [], 0, 0
        for letter in audit:
            role = None
            if letter in "RI":
                role = "user" if (state, "u") in STEP else "assistant"
            elif letter == "K":
                role = mine[at][1]
            if role:
                out.append(f"{role}:{'' if letter == 'I' else mine[at][2]}")
                state = STEP[state, role[0]]
            at += letter != "I"
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        found[conv] = (gaps, *faults.values(), illegal, cost, audit, digest)
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def collected(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit(1), "key": F.lit("x"), "copies": F.lit(3), "cost": F.lit(0)})
    got = collected(conversations.repair_report(df))
    assert got == report(rows)
    return got


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in registry.table(spark, sf_dir, "conversations").collect()]
    got = collected(registry.QUERIES["op12_conversation_repair"](spark, sf_dir))
    assert got == report(rows) and any("I" in x[6] for x in got.values())


def test_parser_against_all_edits():
    rng = random.Random(3)
    repair = conversations.Repair(conversations.Stacks())
    for _ in range(3000):
        rows = [(rng.choice("suaaux"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        assert repair.end(repair.run(0, [(x, 1) for x in rows])) == cheapest(tuple(rows))


def test_parts_join_to_the_whole():
    """A string cut into parts, each parsed from every stack, costs the same as in one go."""
    import pyarrow as pa

    rng = random.Random(4)
    repair = conversations.Repair(conversations.Stacks())
    starts = repair.stacks.reachable
    for _ in range(100):
        rows = [(rng.choice("suaau"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(30)]
        parts = []
        for n, cut in enumerate((rows[:7], rows[7:8], rows[8:])):
            shared = {"conv": 1, "part": n, "n_rows": len(cut), "blank": 1, "duplicate": 0, "truncated": 0, "illegal": 0, "first": "u", "last": "u"}
            for start in starts:
                parts += [{"start": start, "node": node, "cost": cost, "audit": audit, **shared} for node, cost, audit in repair.run(start, [(x, 1) for x in cut])]
        got = conversations._joined(pa.Table.from_pylist(parts)).to_pylist()[0]
        assert (got["cost"], got["audit"]) == repair.end(repair.run(0, [(x, 1) for x in rows]))
        assert (got["n_rows"], got["blank"], got["illegal"]) == (30, 3, 2)


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "A question."), (None, 1, "assistant", "An answer."), (None, None, None, None),
        (1, None, "user", "Hi."), (1, None, "assistant", "Ho."), (1, 5, "", "x."), (1, 6, "sponsor", "y."),
        (2, 1, "user", None), (2, 2, "assistant", "\t\n"), (3, 1, "user", "same."), (3, 1, "user", "same."), (3, 2, "user", "same."),
        (4, 0, "User", "Capital."), (5, -3, "system", "S."), (5, 4, "user", "é "), (6, 7, "assistant", "long. " * 50_000),
        (7, 3, "user", "a"), (7, 3, "user", "b"), (7, 3, "assistant", "c!"),
    ]
    check(spark, rows)
    assert conversations.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conversations.repaired(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversation_over_several_ranges(spark):
    rng = random.Random(5)
    rows = [(9, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "c?", "", f"text {t}."])) for t in range(6000)]
    rows += [(c, t, rng.choice(["user", "assistant"]), f"{t}.") for c in range(20, 300) for t in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(conversations.repair_report(df)) == report(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hm?"), (2, 0, "user", "Q."), (2, 1, "assistant", "A."), (2, 1, "assistant", "A.")]
    got = conversations.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in got if r["conv_id"] == 2] == [(2, 0, "K", "user", "Q."), (2, 1, "K", "assistant", "A."), (2, 2, "D", "assistant", "A.")]
    one = [r for r in got if r["conv_id"] == 1]
    assert "".join(r["action"] for r in one) == "IKKI" and [r["role"] for r in one] == ["user", "assistant", "user", "assistant"]
