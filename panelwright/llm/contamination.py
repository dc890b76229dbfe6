"""Passages of benchmark items in documents: a broadcast hash set of normalised word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import LOWER, Words, _U, slices
from panelwright.session import materialise

WIDTH = 13
#: (window, item) rows that are broadcast at once; more take further passes over the documents.
BLOCK_ROWS = 200_000


def _plain(words: Words, first: int, last: int) -> bytes:
    """The lower-case words first to last (exclusive), joined by a space each."""
    data, low, high = words.data, words.starts[first:last], words.stops[first:last]
    return b" ".join(LOWER[data[i:j]].tobytes() for i, j in zip(low.tolist(), high.tolist(), strict=True))


def benchmark_windows(benchmark: DataFrame, text: str = "text", id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """Distinct (n_words, window, item): all runs of ``width`` words of each item, or all its
    words if fewer, lower-case and joined by spaces."""

    def run(batches):
        for batch in batches:
            items = batch.column(1).to_pylist()
            sizes, texts, owners = [], [], []
            for start, stop, words in slices(batch.column(0)):
                for row in range(stop - start):
                    first, last = int(words.first[row]), int(words.first[row + 1])
                    size = min(width, last - first)
                    for i in range(first, last - size + 1) if size else ():
                        sizes.append(size)
                        texts.append(_plain(words, i, i + size))
                        owners.append(items[start + row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int32()), pa.array(texts, pa.binary()), pa.array(owners, pa.int64())],
                ["n_words", "window", "item"],
            )

    plain = benchmark.select(F.col(text), F.col(id).cast("long"))
    return plain.mapInArrow(run, "n_words int, window binary, item long").distinct()


def _tables(rows) -> tuple[dict, dict]:
    """The windows of one block: items by window, and by size the sorted hashes and a table of
    their leading bits."""
    items: dict[bytes, list[int]] = {}
    by_size: dict[int, list[bytes]] = {}
    for n, window, item in rows:
        window = bytes(window)
        if window not in items:
            by_size.setdefault(n, []).append(window)
        items.setdefault(window, []).extend([] if item is None else [item])
    tables = {}
    for n, texts in by_size.items():
        offsets = np.cumsum([0] + [len(x) for x in texts])
        words = Words(np.frombuffer(b"".join(texts), np.uint8), offsets)
        hashes = np.unique(words.shingles(n)[0])
        seen = np.zeros(1 << 16, dtype=bool)
        seen[hashes >> _U(48)] = True
        tables[n] = (hashes, seen)
    return items, tables


def _occurrences(shared: tuple[dict, dict], words: Words):
    """(row, first word, n words, item ids) of every verified occurrence, by size."""
    items, tables = shared
    for n, (hashes, seen) in tables.items():
        runs, first = words.shingles(n)
        near = np.flatnonzero(seen[runs >> _U(48)])
        near = near[np.isin(runs[near], hashes)]
        rows = np.searchsorted(first, near, side="right") - 1
        at = near - first[rows] + words.first[rows]
        for row, i in zip(rows.tolist(), at.tolist(), strict=True):
            if i + n <= words.first[row + 1]:
                window = _plain(words, i, i + n)
                if window in items:
                    yield row, i, n, items[window]


def _merged(runs: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Disjoint ascending runs (start, stop, and the same in bytes if given)."""
    out: list[list[int]] = []
    for start, stop, *cut in sorted(runs):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1][1::2] = [stop, *cut[1:]]
        else:
            out.append([start, stop, *cut])
    return out


_HITS = "struct<n_words:bigint, runs:array<bigint>, cuts:array<bigint>, items:array<bigint>>"


def _scan(shared) -> Column:
    """Column function: texts to hit word runs, their byte ranges and items, by the windows of one block."""

    def scan(texts: pa.Array) -> pa.Array:
        sizes, runs, cuts, items = [], [], [], []
        for start, stop, words in slices(texts):
            found: dict[int, tuple[list, set]] = {}
            for row, i, size, ids in _occurrences(shared.value, words):
                where, which = found.setdefault(row, ([], set()))
                where.append((i, i + size))
                which.update(ids)
            sizes.append(np.diff(words.first))
            for row in range(stop - start):
                where, which = found.get(row, ([], set()))
                flat = _merged(where)
                first, base = int(words.first[row]), int(words.offsets[row])
                runs.append([x - first for run in flat for x in run])
                cuts.append([int(x) - base for i, j in flat for x in (words.starts[i], words.stops[j - 1])])
                items.append(sorted(which))
        return pa.StructArray.from_arrays(
            [
                pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                pa.array(runs, pa.list_(pa.int64())),
                pa.array(cuts, pa.list_(pa.int64())),
                pa.array(items, pa.list_(pa.int64())),
            ],
            ["n_words", "runs", "cuts", "items"],
        )

    return F.arrow_udf(scan, _HITS)


def _sizes(texts: pa.Array) -> pa.Array:
    found = [np.diff(words.first) for _, _, words in slices(texts)]
    return pa.array(np.concatenate(found) if found else [], pa.int64())


def _joined(runs: pa.Array, cuts: pa.Array) -> pa.Array:
    """The runs and cuts of several blocks, merged."""
    out = []
    for where, at in zip(runs.to_pylist(), cuts.to_pylist(), strict=True):
        both = _merged(list(zip(where[::2], where[1::2], at[::2], at[1::2], strict=True)))
        out.append({"runs": [x for r in both for x in r[:2]], "cuts": [x for r in both for x in r[2:]]})
    return pa.array(out, pa.struct([("runs", pa.list_(pa.int64())), ("cuts", pa.list_(pa.int64()))]))


def _hits_of_blocks(docs: DataFrame, windows: DataFrame, blocks: int, text: str) -> DataFrame:
    """``docs`` with hits by the windows of several blocks: one job and one broadcast at a time.

    A job writes the rows with hits alone; these are joined to the documents, which are written once.
    """
    number = F.pmod(F.xxhash64("window", "item"), F.lit(blocks))
    numbered = materialise(docs.select("*", F.monotonically_increasing_id().alias("_pw_row")))
    found = None
    for block in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(_tables(windows.filter(number == block).collect()))
        hits = numbered.select("_pw_row", _scan(shared)(F.col(text)).alias("h")).filter(F.size("h.runs") > 0)
        hits = materialise(hits.select("_pw_row", "h.*"))
        shared.destroy()
        found = hits if found is None else found.union(hits)
    # A row has at most one entry per block.
    lists = [F.flatten(F.collect_list(F.struct(c))[c]).alias(c) for c in ("runs", "cuts", "items")]
    whole = found.groupBy(F.col("_pw_row").alias("_pw_of")).agg(*lists)
    kind = "struct<runs:array<bigint>, cuts:array<bigint>>"
    whole = whole.select("_pw_of", F.arrow_udf(_joined, kind)(F.col("runs"), F.col("cuts")).alias("_pw_found"), F.array_sort(F.array_distinct("items")).alias("_pw_items"))
    none = F.array().cast("array<bigint>")
    hits = F.struct(
        F.arrow_udf(_sizes, "bigint")(F.col(text)).alias("n_words"),
        F.coalesce("_pw_found.runs", none).alias("runs"),
        F.coalesce("_pw_found.cuts", none).alias("cuts"),
        F.coalesce("_pw_items", none).alias("items"),
    )
    joined = numbered.join(whole, F.col("_pw_row") == F.col("_pw_of"), "left")
    return joined.withColumn("_pw_hits", hits).select(*docs.columns, "_pw_hits")


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    width: int = WIDTH,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``docs`` with one more column ``_pw_hits``: n_words, runs (hit words, as start and stop word
    numbers), cuts (the same as byte offsets of the UTF-8 text) and items (sorted ids).

    Every input row stays, repeated ones too. Null and empty texts have
    no words and no hits. Items without words have no window; items with a null id cause hits
    but are not listed. The windows are broadcast in blocks of about ``block_rows`` rows at most, one
    after the other: each further block is one more job over the texts. With one block no row
    is shuffled; an empty benchmark has one empty block. A column ``_pw_hits`` is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("_pw_hits")
    windows = materialise(benchmark_windows(benchmark, item_text, item_id, width))
    blocks = max(1, -(-windows.count() // block_rows))
    if blocks > 1:
        # Twice as many blocks as needed on average, so that uneven hashing stays within the bound.
        return _hits_of_blocks(docs, windows, 2 * blocks, text)
    shared = spark.sparkContext.broadcast(_tables(windows.collect()))
    return docs.withColumn("_pw_hits", _scan(shared)(F.col(text)))


def _n_hit(hits: Column) -> Column:
    runs = hits["runs"]
    return F.aggregate(
        F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )


def is_contaminated(hits: Column, share: float = 0.05) -> Column:
    """At least one hit word, and hit words are at least this share of all words (1 in 20)."""
    n = _n_hit(hits)
    return (n > 0) & (n * round(1 / share) >= hits["n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: ``id``, n_words, n_hit, n_items, items_sha256, contaminated, runs, items."""
    found = benchmark_hits(docs.select(F.col(id), F.col(text).alias("_pw_text")), benchmark, "_pw_text", **options)
    hits = F.col("_pw_hits")
    names = F.array_join(F.array_sort(F.transform(hits["items"], lambda x: x.cast("string"))), ",")
    return found.select(
        F.col(id).cast("long").alias(id),
        hits["n_words"].alias("n_words"),
        _n_hit(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        is_contaminated(hits).alias("contaminated"),
        hits["runs"].alias("runs"),
        hits["items"].alias("items"),
    )


def _without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    out = []
    for text, ranges in zip(texts.to_pylist(), cuts.to_pylist(), strict=True):
        if ranges:
            raw, at, kept = text.encode(), 0, []
            for i, j in zip(ranges[::2], ranges[1::2], strict=True):
                kept.append(raw[at:i])
                at = j
            text = b"".join([*kept, raw[at:]]).decode()
        out.append(text)
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "document", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="span"``) with their hit passages cut
    out of the text. All columns and all clean rows stay as they are, repeated rows and null texts
    too; a document that is one passage keeps an empty text. Other columns may have any names but
    those that begin with ``_pw_``."""
    columns = docs.columns
    found = benchmark_hits(docs, benchmark, text, **options)
    flag = is_contaminated(F.col("_pw_hits"))
    if remove == "document":
        return found.filter(~flag).select(*columns)
    if remove != "span":
        raise ValueError("remove must be 'document' or 'span'")
    cut = F.when(flag, F.arrow_udf(_without, "string")(F.col(text), F.col("_pw_hits.cuts"))).otherwise(F.col(text))
    return found.withColumn(text, cut).select(*columns)
