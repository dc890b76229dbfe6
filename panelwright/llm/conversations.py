"""Conversation structure repair: generalised LR parsing over the role grammar with weighted edits.

Rows of a conversation are read as a string of role initials. The parser keeps a graph of
stacks (each node is an LR state on top of a parent node); a row may be kept, rerolled or
deleted, and rows may be inserted. Equal stacks are merged by the least (cost, audit), where the
audit spells the edits. A parse needs the past only through the set of stacks with their relative
costs and the order of their audits, and there are few such sets, so steps are looked up after
their first use and memory grows by one small entry a row.

Spark sorts the rows by conversation and turn over ranges, so that a long conversation may lie
in several tasks; each task parses its part from every stack it could begin with, and the parts
are joined by the least (cost, audit). Texts do not travel there, only faults of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import materialise

#: Productions of the grammar ``(s?(ua)+)?``; capital letters are not roles. Recursion is on the
#: left, so that stacks stay short.
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "TP"), ("T", "P"), ("P", "ua"))
#: Roles that edits may give or insert, by their initial.
ROLES = {"u": "user", "a": "assistant"}
#: Pairs of initials that may follow each other.
FOLLOWS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A stack this much dearer than the cheapest one cannot win or tie: the cheapest can be led to
#: the same needs by two inserted rows (6) and the deletion of a kept first row (4).
SLACK = 12
SPACE = " \t\n\x0b\x0c\r"


class Stacks:
    """The LR(0) automaton of a grammar and the stacks it can build, as nodes (state, parent)."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = (("^", grammar[0][0]), *grammar)
        self.terminals = sorted({x for _, body in grammar for x in body if not x.isupper()})
        self.states, self.goto = [self._closed({(0, 0)})], {}
        for i, items in enumerate(self.states):  # grows while it is read
            for symbol in sorted({self.grammar[p][1][at] for p, at in items if at < len(self.grammar[p][1])}):
                moved = self._closed({(p, at + 1) for p, at in items if self.grammar[p][1][at : at + 1] == symbol})
                if moved not in self.states:
                    self.states.append(moved)
                self.goto[i, symbol] = self.states.index(moved)
        self.done = [[p for p, at in sorted(items) if at == len(self.grammar[p][1])] for items in self.states]
        self.nodes, self.index, self.shifts = [(0, -1)], {(0, -1): 0}, {}
        #: All stacks that roles can build, met in a fixed order, so that every task numbers them alike.
        self.reachable = [0]
        for one in self.reachable:  # grows while it is read
            for symbol in self.terminals:
                self.reachable += [x for x in self.shift(one, symbol) if x not in self.reachable]

    def _closed(self, items):
        items = set(items)
        while True:
            wanted = {self.grammar[p][1][at] for p, at in items if at < len(self.grammar[p][1])}
            more = {(p, 0) for p, (head, _) in enumerate(self.grammar) if head in wanted} - items
            if not more:
                return frozenset(items)
            items |= more

    def _node(self, state, parent):
        if (state, parent) not in self.index:
            self.index[state, parent] = len(self.nodes)
            self.nodes.append((state, parent))
        return self.index[state, parent]

    def _reduced(self, node, production):
        head, body = self.grammar[production]
        for _ in body:
            node = self.nodes[node][1]
        return self._node(self.goto[self.nodes[node][0], head], node)

    def tops(self, node):
        """The node and all that reductions make of it."""
        found = [node]
        for one in found:  # grows while it is read
            for p in self.done[self.nodes[one][0]]:
                if p and (other := self._reduced(one, p)) not in found:
                    found.append(other)
        return found

    def shift(self, node, symbol):
        """Nodes after a role; reductions without a choice are made at once, so that equal stacks meet."""
        if (node, symbol) not in self.shifts:
            found = []
            for top in self.tops(node):
                state = self.nodes[top][0]
                if (state, symbol) in self.goto:
                    to = self._node(self.goto[state, symbol], top)
                    while len(p := self.done[self.nodes[to][0]]) == 1 and len(self.states[self.nodes[to][0]]) == 1:
                        to = self._reduced(to, p[0])
                    found.append(to)
            self.shifts[node, symbol] = found
        return self.shifts[node, symbol]

    def accepts(self, node):
        return any(0 in self.done[self.nodes[top][0]] for top in self.tops(node))


class Repair:
    """Cheapest edits of strings of rows. A configuration is a tuple of (node, cost above the least,
    rank of the audit); rows are (initial, must be deleted, truncated)."""

    def __init__(self, stacks: Stacks):
        self.stacks, self.steps, self.ends = stacks, {}, {}

    def _inserted(self, config):
        """(cost, rank, inserted, index) of the best way to each node by inserting rows only."""
        best = {node: (cost, rank, "", i) for i, (node, cost, rank) in enumerate(config)}
        todo = list(best)
        for node in todo:  # grows while it is read
            cost, rank, added, i = best[node]
            for symbol in ROLES:
                for to in self.stacks.shift(node, symbol):
                    new = (cost + INSERT, rank, added + "I", i)
                    if to not in best or new < best[to]:
                        best[to] = new
                        todo.append(to)
        return best

    def step(self, config, row):
        """(next configuration, least cost added, for each of its nodes (index before, letters))."""
        if (config, row) in self.steps:
            return self.steps[config, row]
        initial, must_delete, truncated = row
        found = {}

        def offer(node, cost, rank, letters, i):
            if node not in found or (cost, rank, letters) < found[node][:3]:
                found[node] = (cost, rank, letters, i)

        extra = TRUNCATED if truncated else 0
        for node, (cost, rank, added, i) in self._inserted(config).items():
            offer(node, cost + DELETE, rank, added + "D", i)
            if not must_delete:
                for to in self.stacks.shift(node, initial) if initial in self.stacks.terminals else ():
                    offer(to, cost + extra, rank, added + "K", i)
                for symbol in ROLES:
                    for to in self.stacks.shift(node, symbol):
                        offer(to, cost + extra + REROLE, rank, added + "R", i)
        least = min(x[0] for x in found.values())
        kept = {node: x for node, x in found.items() if x[0] <= least + SLACK}
        order = {x: n for n, x in enumerate(sorted({x[1:3] for x in kept.values()}))}
        nodes = sorted(kept)
        config2 = tuple((node, kept[node][0] - least, order[kept[node][1:3]]) for node in nodes)
        made = config2, least, tuple((kept[node][3], kept[node][2]) for node in nodes)
        self.steps[config, row] = made
        return made

    def run(self, start, rows):
        """[(end node, cost, audit)] for rows given as (row, repeats) from the start node."""
        config, total, trace = ((start, 0, 0),), 0, []
        for row, repeats in rows:
            while repeats:
                after, least, back = self.step(config, row)
                # A step that changes nothing is the same for all further copies.
                times = repeats if after == config and all(i == n for n, (i, _) in enumerate(back)) else 1
                trace.append((back, times))
                config, total, repeats = after, total + least * times, repeats - times
        found = []
        for n, (node, cost, _) in enumerate(config):
            audit = []
            for back, times in reversed(trace):
                n, letters = back[n]
                audit.append(letters * times)
            found.append((node, total + cost, "".join(reversed(audit))))
        return found

    def end(self, ends):
        """(cost, audit) of the best accepted end among (node, cost, audit)."""
        found = []
        for node, cost, audit in ends:
            if node not in self.ends:
                ways = [x for to, x in self._inserted(((node, 0, 0),)).items() if self.stacks.accepts(to)]
                self.ends[node] = [(x[0], x[2]) for x in ways]
            found += [(cost + more, audit + letters) for more, letters in self.ends[node]]
        return min(found)


def faults(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv, turn, role, key) with copies, blank, truncated and whether the
    role and text are seen here first; all without the texts. ``key`` is a digest of the text."""
    keys = ["conv", "role", "key"]
    one = rows.groupBy("conv", "turn", "role", "key").agg(
        F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")
    )
    one = materialise(one)
    # The first turn of a role and text, null before all numbers, comes back as a row of its own.
    first = one.groupBy(*keys).agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("least"))
    first = first.select("conv", F.col("least.turn").alias("turn"), "role", "key", F.lit(0).cast("long").alias("copies"),
                         F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(True).alias("first"))
    both = one.withColumn("first", F.lit(False)).select(*first.columns).union(first)
    return both.groupBy("conv", "turn", "role", "key").agg(
        F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"), F.max("first").alias("first")
    )


def _sequence(initial, blank, truncated, first, copies):
    """Rows for the parser, with repeats."""
    drop = ("", True, False)
    if blank or not first:
        return [(drop, copies)]
    return [((initial, False, truncated), 1), *([(drop, copies - 1)] if copies > 1 else [])]


_PARTS = ("conv {0}, part INT, start INT, node INT, cost BIGINT, audit STRING, n_rows BIGINT, blank BIGINT, duplicate BIGINT, "
          "truncated BIGINT, illegal BIGINT, first STRING, last STRING")


def _parse(batches: Iterator[pa.RecordBatch], names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range to finished conversations (start null) and open parts of the first and last."""
    repair = Repair(Stacks())
    everywhere = repair.stacks.reachable
    part = TaskContext.get().partitionId()
    out = []

    def close(conv, rows, counts, ends, is_first, is_last):
        shared = [counts["n"], counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], *ends]
        if not is_first and not is_last:
            cost, audit = repair.end(repair.run(0, rows))
            out.append([conv, part, None, None, cost, audit, *shared])
        else:
            for start in everywhere if is_first else [0]:
                out.extend([conv, part, start, node, cost, audit, *shared] for node, cost, audit in repair.run(start, rows))

    def flushed():
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        types = [kind, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)
        out.clear()
        return batch

    nothing = object()
    current, rows, counts, ends, seen = nothing, [], None, [None, None], 0
    for batch in batches:
        for conv, role, copies, blank, truncated, first in zip(*[
            batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "role", "copies", "blank", "truncated", "first")
        ], strict=True):
            if current is nothing or conv != current:
                if current is not nothing:
                    close(current, rows, counts, ends, seen == 1, False)
                current, rows, ends, seen = conv, [], [None, None], seen + 1
                counts = dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal"), 0)
            initial = role[:1]
            counts["n"] += copies
            if blank:
                counts["blank"] += copies
            elif first:
                counts["duplicate"] += copies - 1
                counts["truncated"] += truncated
            else:
                counts["duplicate"] += copies
            if ends[1] is not None:
                counts["illegal"] += ends[1] + initial not in FOLLOWS
            if initial + initial not in FOLLOWS:
                counts["illegal"] += copies - 1
            ends = [initial if ends[0] is None else ends[0], initial]
            rows += _sequence(initial, blank, truncated, first, copies)
        if out:
            yield flushed()
    if current is not nothing:
        close(current, rows, counts, ends, seen == 1, True)
        yield flushed()


def _joined(table: pa.Table) -> pa.Table:
    """Parts of one conversation, in their order, to its (cost, audit) and counts."""
    repair = Repair(Stacks())
    rows = table.to_pylist()
    ways = {0: (0, "")}
    counts, last = [0, 0, 0, 0, 0], None
    for part in sorted({r["part"] for r in rows}):
        mine = [r for r in rows if r["part"] == part]
        found = {}
        for r in mine:
            if r["start"] in ways:
                cost, audit = ways[r["start"]]
                new = (cost + r["cost"], audit + r["audit"])
                if r["node"] not in found or new < found[r["node"]]:
                    found[r["node"]] = new
        ways, one = found, mine[0]
        for i, c in enumerate(("n_rows", "blank", "duplicate", "truncated", "illegal")):
            counts[i] += one[c]
        counts[4] += last is not None and last + one["first"] not in FOLLOWS
        last = one["last"]
    cost, audit = repair.end([(node, *x) for node, x in ways.items()])
    return pa.table({"conv": table.column("conv")[:1], "cost": pa.array([cost], pa.int64()), "audit": [audit],
                     **{c: pa.array([n], pa.int64()) for c, n in zip(("n_rows", "blank", "duplicate", "truncated", "illegal"), counts, strict=True)}})


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, copies) with the digest of the text and its own faults."""
    bare = F.btrim("text", F.lit(SPACE))
    return rows.select(
        "conv", "turn", "role", "text", F.col("copies").cast("long").alias("copies"), F.md5("text").alias("key"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )


def cheapest(rows: DataFrame) -> DataFrame:
    """Per conversation of marked rows: cost, audit and the counts of faults, written."""
    kind = rows.schema["conv"].dataType
    meta = materialise(faults(rows.drop("text")))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "key"]
    parts = _range_count(meta)
    ranged = meta.repartitionByRange(parts, *order) if parts > 1 else meta.coalesce(1)
    schema = _PARTS.format(kind.simpleString())
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    arrow = pa.int64() if kind.simpleString() in ("bigint", "int") else pa.string()
    if kind.simpleString() == "int":
        arrow = pa.int32()
    found = ranged.sortWithinPartitions(*order).mapInArrow(lambda b: _parse(b, names, arrow), schema)
    found = materialise(found)
    columns = ["conv", "cost", "audit", "n_rows", "blank", "duplicate", "truncated", "illegal"]
    closed = found.filter("start is null").select(*columns)
    fields = f"conv {kind.simpleString()}, cost BIGINT, audit STRING, n_rows BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT"
    split = found.filter("start is not null").groupBy("conv").applyInArrow(_joined, fields)
    return materialise(closed.union(split.select(*columns)))


def _range_count(meta: DataFrame) -> int:
    """Ranges for a written table of rows: one for each 200,000, at least as many as the session's tasks if there is enough."""
    n = meta.count()
    return max(1, min(-(-n // 2_000), max(-(-n // 200_000), meta.sparkSession.sparkContext.defaultParallelism)))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, None) before and (conv, (action, role, text)) for each edit, from a stream sorted by
    conversation with its audit first."""
    stacks = Stacks()
    audit, at, node = "", 0, 0

    def inserted():
        nonlocal at, node
        while at < len(audit) and audit[at] == "I":
            symbol = next(s for s in ROLES if stacks.shift(node, s))
            node, at = stacks.shift(node, symbol)[0], at + 1
            yield "I", ROLES[symbol], ""

    for batch in batches:
        for conv, is_audit, spelled, role, text, copies in zip(*[
            batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "is_audit", "audit", "role", "text", "copies")
        ], strict=True):
            if is_audit:
                audit, at, node = spelled, 0, 0
                yield conv, None
                for edit in inserted():
                    yield conv, edit
                continue
            for _ in range(copies):
                letter, at = audit[at], at + 1
                if letter == "K":
                    node = stacks.shift(node, role[:1])[0]
                    yield conv, ("K", role, text)
                elif letter == "R":
                    symbol = next(s for s in ROLES if stacks.shift(node, s))
                    node = stacks.shift(node, symbol)[0]
                    yield conv, ("R", ROLES[symbol], text)
                else:
                    yield conv, ("D", role, text)
                for edit in inserted():
                    yield conv, edit


def _ordered(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of each conversation in one sorted stream, its audit first."""
    text = rows.select("conv", F.lit(False).alias("is_audit"), F.lit("").alias("audit"), "turn", "role", "text", "key", "copies")
    first = audits.select("conv", F.lit(True).alias("is_audit"), "audit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                          F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("key"), F.lit(0).cast("long").alias("copies"))
    both = first.union(text).repartition("conv")
    return both.sortWithinPartitions("conv", F.col("is_audit").desc(), F.col("turn").asc_nulls_first(), "role", "key")


def _hashes(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    digest, current, convs, found, some = None, None, [], [], False
    for conv, edit in _applied(batches):
        if edit is None:
            if digest is not None:
                convs.append(current)
                found.append(digest.hexdigest())
            digest, current, some = hashlib.sha256(), conv, False
            if len(convs) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(found)], ["conv", "repaired_sha256"])
                convs, found = [], []
        elif edit[0] != "D":
            digest.update(f"{chr(10) if some else ''}{edit[1]}:{edit[2]}".encode())
            some = True
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*convs, current], kind), pa.array([*found, digest.hexdigest()])], ["conv", "repaired_sha256"])


def _edits(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows, position = [], 0

    def made():
        columns = zip(*rows, strict=True)
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["conv", "position", "action", "role", "text"])

    for conv, edit in _applied(batches):
        if edit is None:
            position = 0
            continue
        rows.append((conv, position, *edit))
        position += 1
        if len(rows) >= 1000:
            yield made()
            rows.clear()
    if rows:
        yield made()


def _arrow(df: DataFrame) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(df.schema["conv"].dataType.simpleString(), pa.string())


def _sources(convs: DataFrame) -> DataFrame:
    """conv, turn, role, text with nulls of role and text as one space."""
    return convs.select(F.col("conv_id").alias("conv"), F.col("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(convs: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, copies) after the planned damage, chosen by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 sets its role to user.
    """
    name = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = _sources(convs).withColumn("damage", F.crc32(name.cast("binary")) % 20).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("damage") == 3, 2).otherwise(1).alias("copies"),
    )


def repaired(convs: DataFrame) -> DataFrame:
    """The cheapest edits that give every conversation roles ``(s?(ua)+)?``, one row an edit.

    ``convs``: conv_id, turn, role, text. Returns conv_id, position (from 0), action (K keep, R
    rerole, D delete, I insert), role and text after the edit. Rows are read by turn, null first;
    equal turns by role and digest of the text. Null roles and texts count as one space, a null
    conv_id is a conversation of its own; an empty role has no initial and cannot be kept.
    Repeated rows are duplicates and are deleted. Of equally cheap audits the least is taken.
    Other columns are not looked at; an empty table gives an empty table.
    """
    rows = marked(_sources(convs).withColumn("copies", F.lit(1)))
    kind = _arrow(rows)
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, position BIGINT, action STRING, role STRING, text STRING"
    found = _ordered(rows, cheapest(rows)).mapInArrow(lambda b: _edits(b, kind), schema)
    return found.withColumnRenamed("conv", "conv_id")


def repair_report(convs: DataFrame, damage: Column | bool = True) -> DataFrame:
    """Every conv_id with its faults and its cheapest repair, after the planned damage (if ``damage``).

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; rules
    as for ``repaired``. A conversation that loses all rows has zeros, an empty audit and the
    hash of the empty text. Repeated rows of the input count as such; extra columns are not read.
    The hash of a conversation is one sequential computation; its rows stream through one task.
    """
    rows = marked(damaged(convs) if damage else _sources(convs).withColumn("copies", F.lit(1)))
    kind = _arrow(rows)
    found = cheapest(rows)
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, repaired_sha256 STRING"
    hashes = _ordered(rows, found).mapInArrow(lambda b: _hashes(b, kind), schema)
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")
    )
    all_convs = convs.select(F.col("conv_id").alias("conv")).distinct()
    out = all_convs
    for i, other in enumerate((found, hashes, turns)):
        other = other.withColumnRenamed("conv", f"conv{i}")
        out = out.join(other, F.col("conv").eqNullSafe(F.col(f"conv{i}")), "left").drop(f"conv{i}")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
