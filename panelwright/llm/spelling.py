"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and itself.

Words that begin alike share an initial state of the acceptor. While more words than a task should
hold share it, the transducer's edit is taken there by a join (the words of such a state without
their next letter must be equal), and its other arc leads on to the next states. Each state that
few words share is one task's acceptor: it is minimised, composed with the transducer and itself,
and its accepted pairs are enumerated. Every pair has one path, on which the edit is made at
the first place where the two words differ, so that no pair is met twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import lowered, small_side
from panelwright.session import materialise

#: Maximal runs of these are words; letters A-Z are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
#: Least letters of a word and least occurrences.
LETTERS, OCCURRENCES = 7, 2
#: A form occurs at least so many times as often as the word.
TIMES = 10
#: A run whose crc32 this divides loses a letter.
DAMAGED = 31
#: Words that share an initial state and are composed in one task.
STATE_WORDS = 20_000
_LONG = 62

_SCHEMA = "word STRING, n_near BIGINT, neg BIGINT, near STRING"


def vocabulary(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(word, n): damaged runs of at least 7 letters that occur at least twice, written."""
    runs = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= LETTERS).select("id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    words = runs.select("run", h.alias("h"), at.alias("at")).select(
        F.when(F.col("h") % DAMAGED == 0, F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run"))))
        .otherwise(F.col("run")).alias("word")
    )
    words = words.filter(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return materialise(words.filter(F.col("n") >= OCCURRENCES))


class Acceptor:
    """The minimal acyclic acceptor of sorted words. State 0.. have their arcs before their parents;
    ``arcs[q]``: {letter: (state, rank of its first word in q)}."""

    def __init__(self, words: list[str]):
        self.arcs, self.final, self.size, self.lengths = [], [], [], []
        register = {}

        def closed(final, children):
            key = (final, tuple(children))
            if key not in register:
                register[key] = len(self.arcs)
                rank, arcs, mask = int(final), {}, int(final)
                for letter, state in children:
                    arcs[letter] = (state, rank)
                    rank += self.size[state]
                    grown = self.lengths[state] << 1
                    mask |= grown if grown < 1 << _LONG else (grown & ((1 << _LONG) - 1)) | 1 << (_LONG - 1)
                self.arcs.append(arcs)
                self.final.append(final)
                self.size.append(rank)
                self.lengths.append(mask)
            return register[key]

        path, last = [[False, []]], ""  # open states from the root: final, children

        def fold(depth):
            while len(path) - 1 > depth:
                final, children = path.pop()
                path[-1][1].append((last[len(path) - 1], closed(final, children)))

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            fold(same)
            path += [[False, []] for _ in word[same:]]
            path[-1][0], last = True, word
        fold(0)
        self.root = closed(*path[0])
        self.met = {}

    def meet(self, a: int, b: int, but: str = "") -> np.ndarray:
        """Ranks (in a, in b) of the words that both states accept, but for those that begin with ``but``."""
        if a == b and not but:
            every = np.arange(self.size[a])
            return np.stack([every, every], axis=1)
        todo = [(a, b, but)]
        while todo:
            key = x, y, skip = todo[-1]
            if key in self.met:
                todo.pop()
                continue
            shared = [c for c in self.arcs[x] if c in self.arcs[y] and c != skip] if self.lengths[x] & self.lengths[y] else []
            below = [(self.arcs[x][c], self.arcs[y][c]) for c in shared]
            open_ = [(p, q, "") for (p, _), (q, _) in below if p != q and (p, q, "") not in self.met]
            if open_:
                todo += open_
                continue
            found = [np.zeros((1, 2), np.int64)] if self.final[x] and self.final[y] else []
            for (p, i), (q, j) in below:
                one = self.meet(p, p) if p == q else self.met[p, q, ""]
                if len(one):
                    found.append(one + (i, j))
            self.met[key] = np.concatenate(found) if found else _NONE
            todo.pop()
        return self.met[a, b, but]

    def near(self) -> np.ndarray:
        """Ranks of all pairs of words one edit apart, each once."""
        near = []
        for q, arcs in enumerate(self.arcs):
            found, letters = [], list(arcs)
            for n, c in enumerate(letters):
                a, i = arcs[c]
                if len(near[a]):
                    found.append(near[a] + i)
                # The edit is made here: one word has c more, or c where the other has d.
                longer = self.meet(a, q, c)
                if len(longer):
                    found.append(longer + (i, 0))
                for d in letters[n + 1 :]:
                    b, j = arcs[d]
                    if self.lengths[a] & self.lengths[b] and len(other := self.meet(a, b)):
                        found.append(other + (i, j))
            near.append(np.concatenate(found) if found else _NONE)
        return near[self.root]


_NONE = np.zeros((0, 2), np.int64)


def _composed(table: pa.Table) -> pa.Table:
    """Near words (word, n_near, neg, near) within each initial state of one bin of states."""
    out = []
    table = table.sort_by([("depth", "ascending"), ("state", "ascending"), ("word", "ascending")])
    depths, states = table.column("depth").to_pylist(), table.column("state").to_pylist()
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    start = 0
    while start < len(words):
        stop = start + 1
        while stop < len(words) and depths[stop] == depths[start] and states[stop] == states[start]:
            stop += 1
        if stop - start > 1:
            mine, n = words[start:stop], counts[start:stop]
            pairs = Acceptor([w[depths[start] :] for w in mine]).near()
            if len(pairs):
                both = np.concatenate([pairs, pairs[:, ::-1]])
                # Of each word's near words the most frequent first, then the least.
                both = both[np.lexsort((both[:, 1], -n[both[:, 1]], both[:, 0]))]
                at, first, n_near = np.unique(both[:, 0], return_index=True, return_counts=True)
                best = both[first, 1]
                out.append(pa.table({"word": pa.array([mine[i] for i in at], pa.string()), "n_near": pa.array(n_near, pa.int64()),
                                     "neg": pa.array(-n[best], pa.int64()), "near": pa.array([mine[i] for i in best], pa.string())}))
        start = stop
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "neg": pa.array([], pa.int64()), "near": pa.array([], pa.string())})
    return pa.concat_tables([empty, *out])


def _edited_here(words: DataFrame, at: int) -> DataFrame:
    """Near words whose edit is at place ``at``, of words that share their first ``at`` letters.

    Words without their letter there that are equal differ in that letter only, so that a key has
    no more words than there are letters, and one more: the key itself.
    """
    here = F.substring("word", at + 1, 1)
    shorter = words.filter(F.length("word") > at).select(
        F.concat(F.substring("word", 1, at), F.substring("word", F.lit(at + 2), F.length("word"))).alias("key"),
        (-F.col("n")).alias("neg"), "word", F.lit(False).alias("whole"), (here != F.substring("word", at + 2, 1)).alias("differs"),
    )
    whole = words.select(F.col("word").alias("key"), (-F.col("n")).alias("neg"), "word", F.lit(True).alias("whole"), F.lit(False).alias("differs"))
    met = shorter.union(whole).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("neg", "word", "whole", "differs"))).alias("met"))
    each = met.filter("size(met) > 1").select("met", F.explode("met").alias("one"))
    others = F.filter("met", lambda x: (x["word"] != F.col("one.word")) & F.when(F.col("one.whole"), x["differs"]).otherwise(~x["whole"] | F.col("one.differs")))
    each = each.select(F.col("one.word").alias("word"), others.alias("others")).filter("size(others) > 0")
    return each.select("word", F.size("others").cast("long").alias("n_near"), F.get("others", F.lit(0))["neg"].alias("neg"), F.get("others", F.lit(0))["word"].alias("near"))


def near_words(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """(word, n_near, neg, near): words of (word, n) with near words, their number, and the most
    frequent one with minus its n; written."""
    total = words.count()
    parts, alone, active, at = [], [], words, 0
    while True:
        state = F.substring("word", 1, at)
        if at == 0:
            crowded, rest = (active, None) if total > state_words else (None, active)
        else:
            hot = materialise(active.groupBy(state.alias("state")).count().filter(F.col("count") > state_words).select("state"))
            keyed = active.withColumn("state", state)
            crowded = None if hot.isEmpty() else materialise(keyed.join(small_side(hot), "state", "left_semi").drop("state"))
            rest = active if crowded is None else keyed.join(small_side(hot), "state", "left_anti").drop("state")
        if rest is not None:
            alone.append(rest.select("word", "n", F.lit(at).alias("depth"), state.alias("state")))
        if crowded is None:
            break
        parts.append(_edited_here(crowded, at))
        active, at = crowded, at + 1
    states = alone[0]
    for one in alone[1:]:
        states = states.union(one)
    bins = max(1, -(-total // state_words))
    by_bin = states.withColumn("bin", F.pmod(F.xxhash64("depth", "state"), F.lit(bins)))
    found = by_bin.groupBy("bin").applyInArrow(_composed_bin, _SCHEMA)
    for one in parts:
        found = found.union(one)
    least = F.min(F.struct("neg", "near"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("least"))
    return materialise(found.select("word", "n_near", "least.neg", "least.near"))


def _composed_bin(table: pa.Table) -> pa.Table:
    return _composed(table.drop_columns(["bin"]))


def spelling_variants(docs: DataFrame, text: str = "text", id: str = "doc_id", state_words: int = STATE_WORDS) -> DataFrame:
    """Every word of the vocabulary with its form: (word, form, root, n, n_near, form_n).

    Words are the damaged runs of letters of whole texts (see ``vocabulary``); null texts have none,
    a null id spells as nothing, repeated rows count each. Two words are near if one inserted,
    deleted or replaced letter makes one of the other. The form is the near word that occurs most
    often, ties to the least, if it occurs at least ten times as often; the root is the last form
    of forms. An empty table gives none. Other columns are not read.
    """
    words = vocabulary(docs, text, id)
    near = near_words(words, state_words)
    joined = words.join(near, "word", "left")
    has_form = -F.col("neg") >= F.col("n") * TIMES
    joined = materialise(joined.select(
        "word", F.when(has_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, -F.col("neg")).alias("form_n"),
    ))
    # Each round doubles the forms that are followed; a form occurs ten times as often, so that few are.
    roots = joined.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = materialise(roots)
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        followed = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        followed = materialise(followed)
        roots = followed.select("word", "root")
        if followed.filter("moved").isEmpty():
            break
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
