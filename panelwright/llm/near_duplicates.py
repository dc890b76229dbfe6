"""Near duplicates by weighted Jaccard similarity: BagMinHash signatures, bands, verification.

A text is the multiset of its runs of five words (all its words, if fewer). Two texts are linked
if the summed minima of their counts are at least 0.8 of the summed maxima.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import small_side, two_hashes
from panelwright.llm.linking import across_labels, group_buckets, shared_buckets
from panelwright.llm.words import _STEP, _U, mixed, slices
from panelwright.session import materialise

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Elements that one pass over the Poisson processes holds at most.
ELEMENTS = 1 << 20


def _processes(hashes: np.ndarray, weights: np.ndarray):
    """Poisson processes of the elements: one for the levels [0, 1) and each [2^(k-1), 2^k) below
    the weight. Returns element index, seed, rate (levels in the block), lowest level, weight."""
    blocks = np.where(weights > 1, np.ceil(np.log2(weights)).astype(np.int64), 0) + 1
    element = np.repeat(np.arange(len(hashes)), blocks)
    block = np.arange(len(element)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    seed = mixed(hashes[element] + block.astype(_U) * _STEP)
    return element, seed, np.maximum(low, 1), low, weights[element]


def _insert(minima: np.ndarray, bag: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> None:
    """Lower the bags' signature minima by the points of these weighted elements.

    Every process yields its points in ascending order. Each point has a component of the
    signature and a level; it counts if the level is below the weight. A process ends when its
    next point exceeds all of its bag's minima.
    """
    m = minima.shape[1]
    flat = minima.reshape(-1)
    element, seed, rate, low, weight = _processes(hashes, weights)
    owner = bag[element]
    at = np.zeros(len(owner))
    worst = minima.max(axis=1)
    step = 0
    while len(owner):
        step += 1
        draw = mixed(seed + np.array(step, dtype=_U) * _STEP)
        at = at - np.log(((draw >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
        alive = at < worst[owner]
        if not alive.all():
            owner, seed, rate, low, weight, at, draw = (x[alive] for x in (owner, seed, rate, low, weight, at, draw))
        other = mixed(draw ^ _U(0x5851F42D4C957F2D))
        component = ((other >> _U(32)) % _U(m)).astype(np.int64)
        level = low + ((other & _U(0xFFFFFFFF)) % rate.astype(_U)).astype(np.int64)
        counted = level < weight
        np.minimum.at(flat, (owner * m + component)[counted], at[counted])
        worst = minima.max(axis=1)


def signatures(bags: np.ndarray, hashes: np.ndarray, n_bags: int, m: int) -> np.ndarray:
    """BagMinHash signatures (n_bags x m, float64; inf for an empty bag) of element occurrences.

    Occurrences are counted first; elements are then taken in passes of bounded size, which
    changes nothing in the minima.
    """
    minima = np.full((n_bags, m), np.inf)
    order = np.lexsort((hashes, bags))
    bags, hashes = bags[order], hashes[order]
    new = np.ones(len(bags), dtype=bool)
    new[1:] = (bags[1:] != bags[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    weights = np.diff(np.append(starts, len(bags)))
    for i in range(0, len(starts), ELEMENTS):
        part = starts[i : i + ELEMENTS]
        _insert(minima, bags[part], hashes[part], weights[i : i + ELEMENTS])
    return minima


def _band_keys(minima: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    bits = minima.view(_U).reshape(len(minima), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _STEP, bits.shape[:2]).copy()
    for r in range(bits.shape[2]):
        keys = mixed(keys * _STEP + bits[:, :, r])
    return keys.view(np.int64)


def band_keys(bands: int = BANDS, rows: int = ROWS, width: int = WIDTH):
    """Arrow function: texts to their band keys; null for a text without words."""

    @F.arrow_udf("array<bigint>")
    def keys(texts: pa.Array) -> pa.Array:
        parts = []
        for start, stop, words in slices(texts):
            hashes, first = words.shingles(width)
            n = stop - start
            bags = np.repeat(np.arange(n), np.diff(first))
            found = _band_keys(signatures(bags, hashes, n, bands * rows), bands)
            empty = np.diff(first) == 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1) * bands, type=pa.int32()), pa.array(found.reshape(-1))
            )
            parts.append(lists.take(pa.array(np.arange(n), mask=empty)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return keys


def bags(width: int = WIDTH):
    """Arrow function: texts to their runs of words as sets; the n-th occurrence of a run is an
    element of its own, so that sizes of set intersections are the summed minima of counts."""

    @F.arrow_udf("array<bigint>")
    def elements(texts: pa.Array) -> pa.Array:
        parts = []
        for start, stop, words in slices(texts):
            hashes, first = words.shingles(width)
            rows = np.repeat(np.arange(stop - start), np.diff(first))
            order = np.lexsort((hashes, rows))
            rows, hashes = rows[order], hashes[order]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            begins = np.flatnonzero(new)
            nth = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
            found = mixed(hashes + nth.astype(_U) * _STEP).view(np.int64)
            parts.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return elements


def _candidates(open_ids: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """All pairs across labels that can reach the similarity, by an exact prefix filter.

    The elements of a bag are ordered by the number of bags that hold them. Two bags of the asked
    similarity share one of their first elements, and the number of elements from there on
    bounds their overlap. Near copies that differ by too much meet in no such element.
    """
    held = open_ids.join(bags, "id").select("id", "label", F.size("bag").alias("n"), F.explode("bag").alias("element"))
    held = materialise(held)
    spread = held.groupBy("element").agg(F.count("*").alias("holders"))
    order = Window.partitionBy("id").orderBy("holders", "element")
    first = held.join(spread, "element").withColumn("place", F.row_number().over(order))
    first = first.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    first = materialise(first.filter("holders > 1").select("element", "id", "label", "n", "place"))
    asked = similarity / (1 + similarity) * (F.col("n") + F.col("n2")) - 1e-9
    reachable = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    return across_labels(first, "element", reachable >= asked, ("n", "place"))


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    width: int = WIDTH,
) -> DataFrame:
    """One row per document: ``id``, class_id, class_size, kept.

    A class is a connected component of links between texts; class_id is its smallest id. The
    document with that id is kept, all others are copies. A text without words (null, empty,
    punctuation only) is in no class: class_id is its own id, class_size 1, and it is kept. Among
    rows that agree in id and text, which cannot be told apart, each is reported alike, and a
    class counts them all. A null id sorts after all others. Other columns of ``docs`` are not read.
    """
    source = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("body"))
    body = F.coalesce("body", F.lit(""))
    signed = materialise(
        source.select(
            "doc",
            two_hashes(body)[0].alias("h1"),
            two_hashes(body)[1].alias("h2"),
            band_keys(bands, rows, width)("body").alias("bands"),
        )
    )
    with_words = signed.filter("bands is not null")
    texts = with_words.groupBy("h1", "h2").agg(F.first("bands").alias("bands"))
    texts = materialise(texts.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "bands"))
    two, members = shared_buckets(texts.select(F.explode("bands").alias("key"), "id"))

    wanted = texts.select("id", "h1", "h2").join(
        two.select(F.col("a").alias("id")).union(two.select("b")).union(members.select("id")).distinct(), "id", "left_semi"
    )
    wanted = materialise(wanted)
    bodies = source.withColumns(dict(zip(("h1", "h2"), two_hashes(body), strict=True)))
    bodies = bodies.join(small_side(wanted), ["h1", "h2"]).dropDuplicates(["id"])
    bodies = materialise(bodies.select("id", bags(width)("body").alias("bag")))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(bodies.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a")
        both = both.join(bodies.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b")
        both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
        least = similarity * (F.size("x") + F.size("y") - F.col("common"))
        return both.filter(F.col("common") >= least - 1e-9).select("a", "b")

    def rest(still_open: DataFrame) -> DataFrame:
        return _candidates(still_open.select("id", "label").distinct(), bodies, similarity)

    labels = group_buckets(two, members, verify, rest)
    label = F.coalesce("label", "id")
    named = texts.select("id", "h1", "h2").join(labels, "id", "left").select("h1", "h2", label.alias("label"))
    counts = with_words.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    named = named.join(counts, ["h1", "h2"])
    classes = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    # The smallest id may be shared by different texts (all null, say): then one text keeps it.
    keeper = named.groupBy("label").agg(
        F.min_by(F.struct("h1", "h2"), F.struct(F.col("least").isNull(), "least", "h1", "h2")).alias("k")
    )
    classes = classes.join(keeper, "label").select("label", "class_id", "class_size", F.col("k.h1").alias("k1"), F.col("k.h2").alias("k2"))
    named = named.join(classes, "label").select("h1", "h2", "class_id", "class_size", "k1", "k2")
    out = signed.select("doc", "h1", "h2").join(named, ["h1", "h2"], "left")
    is_first = F.col("doc").eqNullSafe(F.col("class_id")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    wordless = F.col("class_size").isNull()
    return out.select(
        F.col("doc").alias(id),
        F.when(wordless, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (wordless | is_first).alias("kept"),
        "h1",
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are the kept one of their class (see above)."""
    found = near_duplicates(docs, text, id, **options).filter("not kept")
    gone = materialise(found.select(F.col(id).alias("_pw_id"), F.col("h1").alias("_pw_print")).distinct())
    match = F.col(id).cast("long").eqNullSafe(F.col("_pw_id")) & (
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_pw_print")
    )
    return docs.join(small_side(gone), match, "left_anti")
