"""Secrets: base patterns, and weak parts of credentials that are linked by what stands near them.

All of it is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import text_print
from panelwright.llm.spans import find_spans, listed, named
from panelwright.session import materialise

KINDS = ("assign", "access", "hex")
WEAK = ("user", "value", "endpoint")

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"

#: Weak parts: an account name, a long random-looking word, and where to use them.
USER = r"(?<![A-Za-z0-9_])(?i:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9@._-]{3,}+"
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?i:https?|ftps?|ssh|jdbc:[a-z0-9]{2,20}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]++"

#: Parts belong together if they start within so many code points of each other.
REACH = 300


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind. An assignment is the whole match; its value has six characters or more."""
    assign = F.filter(find_spans(text, ASSIGN), lambda s: F.length(F.regexp_replace(s["hit"], VALUE, "")) >= 6)
    return {"assign": assign, "access": find_spans(text, ACCESS), "hex": find_spans(text, HEX)}


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """Weak parts (doc, print, kind, start, stop) that complementary parts stand near.

    An interval join in scopes of ``reach`` code points of one document: per scope and role only
    the first and last start are kept, as those of the scopes before, at and after a part
    decide whether one is in reach. The join is by scope, so its size follows the parts.
    """
    role = F.when(F.col("kind").isin("access", "user"), "id").when(F.col("kind") == "endpoint", "place").otherwise("secret")
    parts = parts.withColumns({"role": role, "scope": F.floor(F.col("start") / reach)})
    ends = parts.filter("role <> 'place'").groupBy("doc", "print", "scope").agg(*[
        f(F.when(F.col("role") == r, F.col("start"))).alias(f"{n}_{r}")
        for r in ("id", "secret") for n, f in (("first", F.min), ("last", F.max))
    ])
    ends = ends.select(
        F.col("doc").alias("of_doc"), F.col("print").alias("of_print"), F.explode(F.array(*[F.col("scope") + d for d in (-1, 0, 1)])).alias("at"),
        "first_id", "last_id", "first_secret", "last_secret",
    )
    weak = parts.filter(F.col("kind").isin(*WEAK))
    match = (F.col("print") == F.col("of_print")) & F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("scope") == F.col("at"))

    def near(role: str) -> Column:
        hit = [F.abs(F.col(f"{n}_{role}") - F.col("start")) <= reach for n in ("first", "last")]
        return F.max(F.coalesce(hit[0], F.lit(False)) | F.coalesce(hit[1], F.lit(False)))

    seen = weak.join(ends, match).groupBy("doc", "print", "kind", "role", "start", "stop").agg(
        near("id").alias("by_id"), near("secret").alias("by_secret")
    )
    return seen.filter(
        "(role = 'id' and by_secret) or (role = 'secret' and by_id) or (role = 'place' and by_id and by_secret)"
    ).select("doc", "print", "kind", "start", "stop")


def secrets(docs: DataFrame, text: str = "text", id: str = "doc_id", reach: int = REACH) -> DataFrame:
    """One row per document: ``id``, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Base spans always stay. Weak parts (an account name, a random-looking word that is no base
    span, an endpoint) are added only if a complementary part starts within ``reach`` code
    points: a secret for a name, a name or access identifier for a word, and both for an
    endpoint. n_linked counts them. Null and empty texts have no spans. Repeated rows are each
    reported, alike. Other columns are not read.
    """
    body = F.col("body")
    found = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("body"))
    weak = {"user": USER, "value": RANDOM, "endpoint": ENDPOINT}
    found = found.select(
        "doc", text_print(body).alias("print"),
        *[named(spans, kind).alias(kind) for kind, spans in base_spans(body).items()],
        *[named(find_spans(body, pattern), kind).alias(kind) for kind, pattern in weak.items()],
    )
    by_start = lambda x, y: F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).when(
        x["kind"] == y["kind"], F.signum(x["stop"] - y["stop"])
    ).otherwise(F.signum(_rank(x["kind"]) - _rank(y["kind"]))).cast("int")
    found = found.withColumn("base", F.array_sort(F.concat(*KINDS), by_start))
    found = materialise(found.withColumn("weak", F.concat(*WEAK)).select("doc", "print", "base", "weak"))

    # A weak part over a base span is that part already.
    fresh = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["stop"]) & (b["stop"] > w["start"])))
    parts = found.filter(F.size("weak") > 0).select("doc", "print", F.explode(F.concat("base", fresh)).alias("p"))
    parts = materialise(parts.select("doc", "print", "p.kind", "p.start", "p.stop").distinct())
    new = _linked(parts, reach).groupBy("doc", "print").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("new"))
    new = new.select(F.col("doc").alias("of_doc"), F.col("print").alias("of_print"), "new")
    match = (F.col("print") == F.col("of_print")) & F.col("doc").eqNullSafe(F.col("of_doc"))
    both = found.select("doc", "print", "base").join(new, match, "left")
    added = F.coalesce("new", F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return both.select(
        F.col("doc").alias(id),
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", added), by_start)).alias("spans"),
        F.size(added).cast("long").alias("n_linked"),
    )


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS + WEAK]), kind)
