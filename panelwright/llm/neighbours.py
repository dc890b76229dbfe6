"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import two_hashes
from panelwright.session import materialise

#: Neighbours kept for a node, and candidates that one local join offers each of its nodes.
DEGREE = 32
OFFERS = 12
#: Random trees that start the graph, and the rows of a leaf, which are compared with each other.
TREES = 10
LEAF = 2048
#: Rounds of neighbours of neighbours at most; they end early when few neighbours change.
ROUNDS = 3
STILL = 0.02
#: Best candidates that a search keeps and expands, and its rounds at most.
WIDTH = 160
SEARCH_ROUNDS = 8

_GRAPH = "id long, ids array<long>, sims array<float>"


def by_key(df: DataFrame, key: str, fold, schema: str) -> DataFrame:
    """Apply ``fold(table) -> record batch`` to runs of whole groups, in bounded pieces.

    Rows are hashed and sorted by the key; a piece ends where the key changes.
    """
    names = df.columns

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (kept and kept[-1].column(key)[-1].as_py() != keys[0]):
                if cut:
                    kept.append(batch.slice(0, cut))
                if kept:
                    yield fold(pa.Table.from_batches(kept).combine_chunks())
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield fold(pa.Table.from_batches(kept).combine_chunks())

    return df.repartition(key).sortWithinPartitions(key).select(*names).mapInArrow(run, schema)


def _matrix(column) -> np.ndarray:
    """Rows of equal length as a float32 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1)


def _packed(values: np.ndarray, top: float) -> list[bytes]:
    """Per vector its largest component, as a share of ``top``, and its components rounded to 8 bits of that."""
    own = np.abs(values).max(axis=1, keepdims=True).astype(np.float64)
    rounded = np.rint(values / own * 127).astype(np.int8)
    return [a.tobytes() + b.tobytes() for a, b in zip((own / top).astype(np.float32), rounded, strict=True)]


def _unpacked(codes: bytes, n: int) -> np.ndarray:
    """The rounded vectors of n codes, one after the other."""
    raw = np.frombuffer(codes, np.uint8).reshape(n, -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def _codes(column) -> np.ndarray:
    """Codes of equal length as a float32 matrix of the rounded vectors."""
    values = column.to_pylist()
    return _unpacked(b"".join(values), len(values))


def _lists(first: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> list[pa.Array]:
    first = pa.array(first, pa.int32())
    return [pa.ListArray.from_arrays(first, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(first, pa.array(sims, pa.float32()))]


def _flat(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, similarity) of all entries of list columns."""
    ids, sims = table.column("ids").combine_chunks(), table.column("sims").combine_chunks()
    rows = np.repeat(np.arange(table.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False))
    return rows, ids.flatten().to_numpy(zero_copy_only=False), sims.flatten().to_numpy(zero_copy_only=False)


def _top(keys: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int):
    """The best distinct ids of each key: (key, id, similarity), by key, best first."""
    order = np.lexsort((-sims, ids, keys))
    keys, ids, sims = keys[order], ids[order], sims[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids, sims = keys[new], ids[new], sims[new]
    order = np.lexsort((ids, -sims, keys))
    keys, ids, sims = keys[order], ids[order], sims[order]
    place = np.arange(len(keys)) - np.searchsorted(keys, keys)
    kept = place < most
    return keys[kept], ids[kept], sims[kept]


def _grouped(keys: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    nodes, first = np.unique(keys, return_index=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), *_lists(np.append(first, len(keys)), ids, sims)], ["id", "ids", "sims"]
    )


def _merge(degree: int):
    def fold(table: pa.Table) -> pa.RecordBatch:
        rows, ids, sims = _flat(table)
        return _grouped(*_top(table.column("id").to_numpy()[rows], ids, sims, degree))

    return fold


def _leaf_neighbours(nodes: np.ndarray, codes: np.ndarray, most: int):
    sims = codes @ codes.T
    np.fill_diagonal(sims, -np.inf)
    k = min(most, len(nodes) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(nodes, k), nodes[best].reshape(-1), np.take_along_axis(sims, best, 1).reshape(-1)


def _trees(nodes: DataFrame, n: int, dims: int, seed: int) -> DataFrame:
    """A first graph: random hyperplanes deal the nodes into leaves, within which all are compared."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    trees = TREES if bits else 1
    planes = np.random.default_rng(seed).standard_normal((trees, dims, bits + 1)).astype(np.float32)

    def place(batches):
        for batch in batches:
            codes = _codes(batch.column("code"))
            for tree in range(trees):
                along = codes @ planes[tree]
                cell = (along[:, :bits] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(along))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("code"), pa.array(np.full(len(along), tree)),
                        pa.array(cell.astype(np.int64)), pa.array(along[:, bits].astype(np.float64)),
                    ],
                    ["id", "code", "tree", "cell", "along"],
                )

    def leaves(batches):
        def found(ids, codes):
            if len(ids) > 1:
                yield _grouped(*_top(*_leaf_neighbours(np.array(ids), _codes(pa.array(codes)), DEGREE // 2), DEGREE))

        def rest(ids, codes):
            half = len(ids) if len(ids) <= LEAF else (len(ids) + 1) // 2
            yield from found(ids[:half], codes[:half])
            yield from found(ids[half:], codes[half:])

        ids, codes, current = [], [], None
        for batch in batches:
            tree = batch.column("tree").to_numpy()
            for t in np.unique(tree):
                if t != current:
                    yield from rest(ids, codes)
                    ids, codes, current = [], [], t
                part = batch.filter(pa.array(tree == t))
                ids += part.column("id").to_pylist()
                codes += part.column("code").to_pylist()
                while len(ids) >= 2 * LEAF:
                    yield from found(ids[:LEAF], codes[:LEAF])
                    ids, codes = ids[LEAF:], codes[LEAF:]
        yield from rest(ids, codes)

    rows = nodes.select("id", "code").mapInArrow(place, "id long, code binary, tree long, cell long, along double")
    rows = rows.repartitionByRange(max(1, trees * n // (4 * LEAF)), "tree", "cell", "along")
    graph = rows.sortWithinPartitions("tree", "cell", "along").mapInArrow(leaves, _GRAPH)
    return materialise(by_key(graph, "id", _merge(DEGREE), _GRAPH))


def _around(graph: DataFrame) -> DataFrame:
    """(node, other): the neighbours of each node, and the best of those that have it as theirs.

    Reverse neighbours are first cut to the best DEGREE within each task, so that a node that is
    everybody's neighbour gathers few rows.
    """

    def reverse(batches):
        for batch in batches:
            rows, ids, sims = _flat(pa.Table.from_batches([batch]))
            own = batch.column("id").to_numpy()
            yield _grouped(*_top(ids, own[rows], sims, DEGREE))

    other = by_key(graph.mapInArrow(reverse, _GRAPH), "id", _merge(DEGREE), _GRAPH)
    both = graph.select("id", "ids").union(other.select("id", "ids"))
    return both.select(F.col("id").alias("node"), F.explode("ids").alias("other")).distinct()


def _descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round: the nodes around each node are compared, and each is offered its best others."""
    worst = graph.select(F.col("id").alias("other"), F.when(F.size("sims") >= DEGREE, F.array_min("sims")).alias("worst"))
    others = nodes.select(F.col("id").alias("other"), "code").join(worst, "other", "left")
    rows = _around(graph).join(others, "other").select("node", "other", "code", "worst")

    def fold(table: pa.Table) -> pa.RecordBatch:
        node, other = table.column("node").to_numpy(), table.column("other").to_numpy()
        worst = table.column("worst").to_numpy(zero_copy_only=False)
        worst = np.where(np.isnan(worst.astype(np.float64)), -np.inf, worst.astype(np.float64))
        codes = _codes(table.column("code"))
        cuts = np.flatnonzero(np.diff(node)) + 1
        found = [[], [], []]
        for i, j in zip([0, *cuts], [*cuts, len(node)], strict=True):
            if j - i < 2:
                continue
            keys, ids, sims = _leaf_neighbours(np.arange(i, j), codes[i:j], OFFERS)
            better = sims > worst[keys]
            found[0].append(other[keys[better]])
            found[1].append(other[ids[better]])
            found[2].append(sims[better])
        if not found[0]:
            return _grouped(*(np.zeros(0, t) for t in (np.int64, np.int64, np.float32)))
        return _grouped(*_top(*(np.concatenate(x) for x in found), DEGREE))

    offers = by_key(rows, "node", fold, _GRAPH)
    return materialise(by_key(graph.union(offers), "id", _merge(DEGREE), _GRAPH))


def build_graph(nodes: DataFrame, dims: int, seed: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """(id, ids, sims) of nodes (id, code): DEGREE near neighbours of each, best first."""
    n = nodes.count()
    graph = _trees(nodes, n, dims, seed)
    for _ in range(rounds):
        before, graph = graph, _descend(graph, nodes)
        new = graph.join(before.select("id", F.col("ids").alias("old")), "id", "left")
        changed = new.agg(F.sum(F.size(F.array_except("ids", F.coalesce("old", F.array().cast("array<bigint>")))))).first()[0] or 0
        if changed <= STILL * n * DEGREE:
            break
    return graph


def greedy_search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, width: int = WIDTH, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """(id, ids): for each query node (id, code) the ``width`` best nodes that the search met.

    A search starts at the query's own neighbours. In each round it expands all of its best
    ``width`` nodes that are not expanded yet. It ends when hardly any of all are (STILL), or
    after ``rounds``.
    """
    around = _around(graph).join(nodes.select(F.col("id").alias("other"), "code"), "other").select("node", "other", "code")

    def gather(table: pa.Table) -> pa.RecordBatch:
        node = table.column("node").to_numpy()
        first = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
        codes = table.column("code").to_pylist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(node[first[:-1]]),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), table.column("other").combine_chunks()),
                pa.array([b"".join(codes[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()),
            ],
            ["node", "others", "codes"],
        )

    around = materialise(by_key(around, "node", gather, "node long, others array<long>, codes binary"))
    state_schema = "id long, code binary, ids array<long>, sims array<float>, done array<long>"
    state = queries.select("id", "code", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("sims"), F.array().cast("array<long>").alias("done"))

    def score(batches):
        for batch in batches:
            out = [[], [], []]
            columns = [batch.column(c).to_pylist() for c in ("id", "bar", "code", "others", "codes")]
            for query, bar, code, others, codes in zip(*columns, strict=True):
                sims = _unpacked(codes, len(others)) @ _unpacked(code, 1)[0]
                good = np.array(others)
                better = (sims > bar) & (good != query)
                out[0].append(np.full(better.sum(), query))
                out[1].append(good[better])
                out[2].append(sims[better])
            if out[0]:
                yield _grouped(*_top(*(np.concatenate(x) for x in out), width))

    def join_state(table: pa.Table) -> pa.RecordBatch:
        key = table.column("id").to_numpy()
        rows, ids, sims = _flat(table)
        keys, ids, sims = _top(key[rows], ids, sims, width)
        own = np.flatnonzero(np.array([c is not None for c in table.column("code").to_pylist()]))
        nodes_, starts = key[own], np.searchsorted(keys, key[own])
        stops = np.searchsorted(keys, key[own], side="right")
        first = np.concatenate([[0], np.cumsum(stops - starts)])
        at = np.concatenate([np.arange(i, j) for i, j in zip(starts, stops, strict=True)]) if len(own) else np.zeros(0, int)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes_), table.column("code").take(own).combine_chunks(), *_lists(first, ids[at], sims[at]), table.column("done").take(own).combine_chunks()],
            ["id", "code", "ids", "sims", "done"],
        )

    for number in range(rounds):
        fresh = F.array("id") if number == 0 else F.array_except("ids", "done")
        state = state.withColumn("fresh", fresh)
        bar = F.when(F.size("sims") >= width, F.array_min("sims")).otherwise(F.lit(float("-inf")))
        asked = state.select("id", "code", bar.alias("bar"), F.explode("fresh").alias("node"))
        found = asked.join(around, "node").select("id", "bar", "code", "others", "codes").mapInArrow(score, _GRAPH)
        found = found.select("id", F.lit(None).cast("binary").alias("code"), "ids", "sims", F.lit(None).cast("array<long>").alias("done"))
        kept = state.select("id", "code", "ids", "sims", F.concat("done", "fresh").alias("done"))
        state = materialise(by_key(kept.union(found), "id", join_state, state_schema))
        left = state.agg(F.sum(F.size(F.array_except("ids", "done"))), F.sum(F.size("ids"))).first()
        if (left[0] or 0) <= STILL * (left[1] or 0):
            break
    return state.select("id", "ids")


def usable(vector: Column) -> Column:
    """Not null, no null, NaN or infinite component, and not all zero."""
    return F.coalesce(
        F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, id: str = "vec_id", vector: str = "embedding", seed: int = 1
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest others of each row whose id ``every`` divides.

    Nearness is the largest inner product, in double precision of the original vectors; ties go
    to the smaller id. Vectors that are null or zero, or hold null or non-finite components,
    take no part, nor do those that differ in length from most. Equal vectors are one node of the
    graph; the least k + 1 ids of each node are kept, which is all that a query can need. Null
    ids take no part; of rows repeated with one id and vector one counts. The graph compares
    vectors rounded to 8 bits of their own largest component; found candidates are ranked by their exact products.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("vec"), F.col(vector).cast("array<float>").alias("v"))
    rows = materialise(rows.filter(usable(F.col("v")) & F.col("vec").isNotNull()).withColumns(dict(zip(("h1", "h2"), two_hashes(F.col("v")), strict=True))))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    dims = lengths["n"]
    rows = rows.filter(F.size("v") == dims)
    top = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]

    @F.arrow_udf("binary")
    def code(column: pa.Array) -> pa.Array:
        return pa.array(_packed(_matrix(column), top), pa.binary())

    # The least ids of each vector, first within shares of its copies.
    shares = rows.groupBy("h1", "h2", F.pmod(F.xxhash64("vec"), F.lit(256)).alias("share")).agg(
        F.first("v").alias("v"), F.slice(F.array_sort(F.collect_set("vec")), 1, k + 1).alias("some")
    )
    nodes = shares.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some")))), 1, k + 1).alias("vecs"))
    nodes = nodes.withColumn("id", F.monotonically_increasing_id())
    nodes = materialise(nodes.withColumn("code", code("v")))

    asked = rows.filter(F.col("vec") % every == 0).select(F.col("vec").alias("query_id"), "h1", "h2").distinct()
    asked = materialise(asked.join(nodes.select("id", "h1", "h2"), ["h1", "h2"]).select("query_id", "id"))
    graph = build_graph(nodes.select("id", "code"), dims, seed)
    starts = nodes.join(asked.select("id").distinct(), "id", "left_semi").select("id", "code")
    found = greedy_search(graph, nodes.select("id", "code"), starts)
    # A query's own node holds its copies.
    pairs = found.select("id", F.explode(F.concat(F.array("id"), "ids")).alias("other"))
    pairs = pairs.join(nodes.select("id", F.col("v").alias("x")), "id")
    pairs = pairs.join(nodes.select(F.col("id").alias("other"), F.col("v").alias("y"), "vecs"), "other")
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)
    pairs = pairs.select("id", product.alias("score"), "vecs")
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.array_min("vecs"))
    pairs = pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    each = asked.join(pairs, "id").select("query_id", "score", F.explode("vecs").alias("vec_id")).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

