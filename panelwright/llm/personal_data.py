"""Personal data: base patterns, and further identifiers found by bootstrapped contexts.

All of it is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import text_print
from panelwright.llm.spans import find_spans, listed, named
from panelwright.session import materialise

KINDS = ("email", "ip", "card", "phone")

# Possessive, and tried only at the start of a run or after a match, so that long runs of one kind
# of character take linear time; the matches are the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words that hold a digit or an at sign.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

#: Least confidence and least different seeds of a pattern that may find new identifiers.
CONFIDENCE = 0.8
SUPPORT = 5
ROUNDS = 3


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether at most 19 digits pass the Luhn test."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind; matches that fail their test are dropped without another try."""

    def small(hit: Column) -> Column:
        # Leading zeros do not count; a part of more digits than three is above 255.
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))

    def card(hit: Column) -> Column:
        n = F.length(_digits(hit))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(hit))).otherwise(False)

    return {
        "email": find_spans(text, EMAIL),
        "ip": F.filter(find_spans(text, IP), lambda s: small(s["hit"])),
        "card": F.filter(find_spans(text, CARD), lambda s: card(s["hit"])),
        "phone": F.filter(find_spans(text, PHONE), lambda s: F.length(_digits(s["hit"])).between(8, 15)),
    }


def _occurrences(found: DataFrame) -> DataFrame:
    """One row per candidate word outside base spans (kind null) or starting one (its kind):
    doc, print, start, stop, value (a hash), and the pattern (the last two words before it)."""
    word = F.explode("words").alias("w")
    rows = found.filter(F.size("words") > 0).select("doc", "print", "all_spans", word)
    rows = rows.select(
        "doc", "print", "w.start", "w.stop", F.lower(F.col("w.hit")).alias("value"),
        F.lower(F.col("w.before")).alias("pattern"),
        F.filter("all_spans", lambda s: (s["start"] < F.col("w.stop")) & (s["stop"] > F.col("w.start"))).alias("over"),
    )
    kind = F.get(F.transform(F.filter("over", lambda s: s["start"] >= F.col("start")), lambda s: s["kind"]), F.lit(0))
    rows = rows.withColumn("kind", kind).filter((F.size("over") == 0) | F.col("kind").isNotNull())
    rows = rows.withColumn("value", F.sha2("value", 256))
    return rows.select("doc", "print", "start", "stop", "value", "pattern", "kind").distinct()


def _bootstrapped(occurrences: DataFrame, confidence: float, support: int, rounds: int) -> DataFrame:
    """(doc, print, kind, start, stop) of unseen identifiers behind confident patterns.

    A value's score for a kind is 1 if it is a seed, else the chance that not all its patterns
    are wrong. A pattern's confidence is the mean score of its different values. Each round is
    two aggregates over the pattern-value graph, pre-aggregated on distinct edges.
    """
    places = occurrences.filter("pattern <> ''")
    edges = materialise(places.select("pattern", "value").distinct())
    seeds = materialise(places.filter("kind is not null").select("value", "kind").distinct())
    degrees = edges.groupBy("pattern").agg(F.count("*").alias("values"))
    scores = seeds.withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        held = edges.join(scores, "value").groupBy("pattern", "kind").agg(
            F.sum("score").alias("total"), F.sum((F.col("score") == 1.0).cast("int")).alias("seeds")
        )
        patterns = held.join(degrees, "pattern").withColumn("confidence", F.col("total") / F.col("values"))
        patterns = materialise(patterns.filter((F.col("seeds") >= support) & (F.col("confidence") >= confidence)))
        if patterns.isEmpty():
            return places.limit(0).select("doc", "print", "kind", "start", "stop")
        learnt = edges.join(patterns.select("pattern", "kind", "confidence"), "pattern")
        learnt = learnt.join(seeds.select("value"), "value", "left_anti")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        learnt = learnt.groupBy("value", "kind").agg((1 - doubt).alias("score"))
        scores = materialise(seeds.withColumn("score", F.lit(1.0)).unionByName(learnt))
    best = patterns.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("found"))
    unseen = places.filter("kind is null").join(best, "pattern")
    return unseen.select("doc", "print", F.col("found").alias("kind"), "start", "stop")


def personal_data(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    confidence: float = CONFIDENCE,
    support: int = SUPPORT,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: ``id``, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    The base patterns seed the search: the two words before a seed are a lexical pattern.
    Patterns with at least ``support`` different seed values and the ``confidence`` mark
    further words with a digit or an at sign behind them as identifiers of the seed's kind; these
    are added to ``spans``, never over a base span. n_found counts them. Null and empty texts
    have no spans. Repeated rows are each reported, alike. Other columns are not read.
    """
    body = F.col("body")
    found = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("body"))
    kinds = base_spans(body)
    found = found.select(
        "doc", text_print(body).alias("print"),
        *[named(spans, kind).alias(kind) for kind, spans in kinds.items()],
        find_spans(body, CANDIDATE).alias("words"),
    )
    # Of the text between two words only its last two words matter.
    tail = lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["hit"].alias("hit"),
        F.substring_index(F.rtrim(F.translate(s["before"], "\n\t\r", "   ")), " ", -2).alias("before"),
    )
    found = materialise(found.withColumn("words", F.transform("words", tail)).withColumn("all_spans", F.concat(*KINDS)))
    occurrences = materialise(_occurrences(found))
    new = _bootstrapped(occurrences, confidence, support, rounds)
    new = new.groupBy("doc", "print").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("new"))
    new = new.select(F.col("doc").alias("of_doc"), F.col("print").alias("of_print"), "new")
    match = (F.col("print") == F.col("of_print")) & F.col("doc").eqNullSafe(F.col("of_doc"))
    both = found.drop("words").join(new, match, "left")
    added = F.coalesce("new", F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>"))

    def of_kind(kind: str) -> Column:
        return F.array_sort(F.concat(F.col(kind), F.filter(added, lambda s: s["kind"] == kind)))

    every = F.concat(*[of_kind(kind) for kind in KINDS])
    return both.select(
        F.col("doc").alias(id),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(F.col("all_spans")), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.size(added).cast("long").alias("n_found"),
    )
