"""Flat token files: written by tasks, and counted per document by scanning for the separator.

A file holds little-endian token ids of one width and nothing else; every document ends with the
separator id. There is no index: document borders are found again by a vectorised search in
blocks, stitched by prefix scans over block summaries.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.session import materialise, shared_folder

#: Bytes that one task step reads.
BLOCK_BYTES = 8 << 20
#: Blocks whose summaries one window holds; groups of so many blocks are summed before.
GROUP = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern of the public byte-level vocabularies, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _uri(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder}"


def write_token_files(
    docs: DataFrame,
    folder: str,
    ranks: bytes,
    text: str = "text",
    pattern: str = PATTERN,
    separator: int | None = None,
) -> DataFrame:
    """Write the texts' tokens, each document followed by the separator; (path, n_docs, n_tokens).

    ``ranks``: a vocabulary file's content, lines of base64 token and rank. Each task writes a
    file of its own name and reports it when it is complete; files of failed attempts are not
    reported, so a task may be repeated. Null and empty texts are documents of no tokens. The
    separator is the first id after the vocabulary by default; texts cannot contain it.
    """
    vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    stop = max(vocabulary.values()) + 1 if separator is None else separator
    kind = np.dtype("<u2") if stop < 1 << 16 else np.dtype("<u4")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    target = _uri(folder)

    def run(batches):
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        store, root = fs.FileSystem.from_uri(target)
        path, out, n_docs, n_tokens = f"{root}/tokens-{uuid.uuid4().hex}.bin", None, 0, 0
        try:
            for batch in batches:
                for item in batch.column(0):
                    tokens = coder.encode_ordinary(item.as_py() or "")
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(path)
                    out.write(np.array([*tokens, stop], dtype=kind).tobytes())
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(tokens)
        finally:
            if out is not None:
                out.close()
        if n_docs:
            name = f"{target.rstrip('/')}/{path.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_pydict({
                "path": [name], "n_docs": [n_docs], "n_tokens": [n_tokens], "separator": [stop], "width": [kind.itemsize],
            })

    schema = "path string, n_docs long, n_tokens long, separator long, width long"
    return materialise(docs.select(F.col(text)).mapInArrow(run, schema))


def token_blocks(spark: SparkSession, files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, start, stop) in tokens for files (path, size in tokens, width)."""
    step = F.greatest(F.lit(block_bytes) / F.col("width"), F.lit(1.0)).cast("long")
    rows = files.withColumn("step", step).filter("size > 0")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("step")))))
    start = F.col("block") * F.col("step")
    return rows.select("path", "width", "block", start.alias("start"), F.least(start + F.col("step"), F.col("size")).alias("stop"))


def _scan(separator: int):
    """Blocks to (path, block, start, stop, ends): the places of the separator, relative to the file."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ends = []
            for r in rows:
                store, path = fs.FileSystem.from_uri(r["path"])
                kind = np.dtype("<u2") if r["width"] == 2 else np.dtype("<u4")
                with store.open_input_file(path) as source:
                    source.seek(r["start"] * r["width"])
                    tokens = np.frombuffer(source.read((r["stop"] - r["start"]) * r["width"]), dtype=kind)
                ends.append(np.flatnonzero(tokens == separator) + r["start"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("path", "block", "start", "stop")), pa.array(ends, pa.list_(pa.int64()))],
                ["path", "block", "start", "stop", "ends"],
            )

    return run


def _before(blocks: DataFrame, value, name: str, fold) -> DataFrame:
    """Add ``fold`` (sum or max) of ``value`` over the file's earlier blocks: first over groups of
    blocks, then within a group, so that no window holds all blocks of a long file."""
    rows = blocks.withColumn("_value", value).withColumn("_group", F.floor(F.col("block") / GROUP))
    groups = rows.groupBy("path", "_group").agg(fold("_value").alias("_of_group"))
    upto = Window.partitionBy("path").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_earlier", fold("_of_group").over(upto)).drop("_of_group")
    inside = Window.partitionBy("path", "_group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_within", fold("_value").over(inside)).join(groups, ["path", "_group"])
    zero = F.lit(0).cast("long")
    both = F.coalesce("_earlier", zero) + F.coalesce("_within", zero) if fold is F.sum else F.greatest("_earlier", "_within")
    return joined.withColumn(name, both).drop("_value", "_group", "_earlier", "_within")


def count_tokens(spark: SparkSession, files: DataFrame, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of flat files: path, doc_no (from 0 in its file), start, n_tokens, ended.

    ``files``: path (a URI), size in tokens, width in bytes. Lengths do not count the separator.
    Tokens after the last separator of a file are a document too, with ``ended`` false; an
    empty file has no documents. Documents may span any number of blocks.
    """
    blocks = token_blocks(spark, files, block_bytes).repartition("path", "block")
    blocks = materialise(blocks.mapInArrow(_scan(separator), "path string, block long, start long, stop long, ends array<long>"))
    sums = blocks.select("path", "block", F.size("ends").cast("long").alias("n"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    sums = _before(_before(sums, F.col("n"), "doc_no", F.sum), F.col("last"), "carry", F.max)
    sums = sums.select("path", "block", "doc_no", F.coalesce(F.col("carry") + 1, F.lit(0).cast("long")).alias("begin"))
    rows = blocks.join(sums, ["path", "block"])
    starts = F.concat(F.array("begin"), F.transform("ends", lambda e: e + 1))
    # Each separator with the start of its document; arrays are not copied into every row.
    pairs = F.arrays_zip(F.slice(starts, 1, F.size("ends")).alias("start"), F.col("ends").alias("end"))
    rows = rows.filter(F.size("ends") > 0).select("path", "doc_no", F.posexplode(pairs).alias("i", "doc"))
    found = rows.select("path", (F.col("doc_no") + F.col("i")).alias("doc_no"), "doc.start", "doc.end", F.lit(True).alias("ended"))
    total = blocks.groupBy("path").agg(
        F.sum(F.size("ends")).cast("long").alias("doc_no"), F.max("stop").alias("end"),
        F.coalesce(F.max(F.array_max("ends")) + 1, F.lit(0).cast("long")).alias("start"),
    )
    rest = total.filter("start < end").select("path", "doc_no", "start", "end", F.lit(False).alias("ended"))
    return found.union(rest).select("path", "doc_no", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended")


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write a table's texts as flat token files in the shared folder and count them from there.

    ``vocabulary``: path of a file of ranks, read by Spark. Same columns as count_tokens.
    """
    spark = docs.sparkSession
    ranks = bytes(spark.read.format("binaryFile").load(_uri(vocabulary)).first()["content"])
    folder = f"{shared_folder(spark)}/panelwright-tokens-{uuid.uuid4().hex}"
    written = write_token_files(docs, folder, ranks, text)
    files = written.select("path", (F.col("n_docs") + F.col("n_tokens")).alias("size"), "width")
    first = written.select("separator").first()
    return count_tokens(spark, files, first[0] if first else 0, block_bytes)
