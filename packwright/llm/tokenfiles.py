"""Flat token files: writing them, and finding their documents by a separator scan.

A token file is nothing but little-endian token ids, one document after another, each
followed by the end-of-document id; there is no index. The scan reads it in blocks that
know nothing of documents: in each block a vector comparison finds all separators. A
prefix scan over the block summaries of a file (tokens and separators before the block,
and where the last separator before it was) then stitches the document that runs over a
block's edge, through however many blocks it takes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_TOKENS = 1 << 16
#: A task's stream is cut into files of about this many tokens.
FILE_TOKENS = 1 << 22
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
#: The public byte-level BPE pattern that this vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Blocks of a large file that a task reads in one go.
RANGE_BLOCKS = 256
DTYPES = {"uint16": np.dtype("<u2"), "uint32": np.dtype("<u4"), "int32": np.dtype("<i4"), "int64": np.dtype("<i8")}

BLOCK_SCHEMA = "file string, block int, tokens binary, doc_ids array<long>"


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken vocabulary file: a token in base64 and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def write_blocks(ranks, eod: int, dtype: str, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS):
    """(doc_id, text) rows to the blocks of flat token files.

    Documents run over block edges. doc_ids lists, for the caller alone, the ids of the
    documents that end in a block, in order: the scan doesn't look at them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        task, file, block, total = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []  # pieces of the block that is open
        n_held, ids = 0, []

        def cut() -> pa.RecordBatch:
            nonlocal held, n_held, ids, block
            row = [[f"{task:06d}-{file:06d}"], [block], [np.concatenate(held).tobytes()], [ids]]
            held, n_held, ids, block = [], 0, [], block + 1
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["file", "block", "tokens", "doc_ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens = np.array(encoding.encode_ordinary(text.as_py() or "") + [eod], DTYPES[dtype])
                total += len(tokens)
                at = 0
                while at < len(tokens):
                    if n_held == block_tokens:
                        yield cut()
                    held.append(tokens[at : at + block_tokens - n_held])
                    n_held += len(held[-1])
                    at += len(held[-1])
                ids.append(doc_id.as_py())
                if total >= file_tokens:
                    yield cut()
                    file, block, total = file + 1, 0, 0
        if n_held:
            yield cut()

    return run


def blocks_of_files(spark: SparkSession, path: str, dtype: str = "uint32", block_tokens: int = BLOCK_TOKENS, max_whole: int = (1 << 31) - 1024, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """(file, block, tokens): raw token files in blocks.

    Spark's binary source lists the files and reads those below its limit of 2 GB, one
    at a time; the ranges of larger ones are dealt out and read one by one by
    pyarrow's filesystems (local paths, s3, gs, hdfs). A length that isn't a multiple of
    the token size is an error. An empty file has no blocks.
    """
    width = DTYPES[dtype].itemsize
    step = block_tokens * width

    def check(file: str, size: int) -> None:
        if size % width:
            raise ValueError(f"{file}: {size} bytes aren't whole tokens")

    def out(file: str, k: int, raw: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int32()), pa.array([raw], pa.binary())], ["file", "block", "tokens"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(content.as_buffer())
                check(file, len(view))
                for k, at in enumerate(range(0, len(view), step)):
                    yield out(file, k, bytes(view[at : at + step]))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, size, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                check(file, size)
                system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                with system.open_input_file(inner) as f:
                    f.seek(first * step)
                    for k in range(first, min(first + range_blocks, -(-size // step))):
                        yield out(file, k, f.read(step))

    schema = "file string, block int, tokens binary"
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= max_whole).select("path", "content").mapInArrow(whole, schema)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / F.lit(step)), F.lit(range_blocks).cast("long"))).alias("first")
    large = files.where(F.col("length") > max_whole).select("path", "length", starts)
    large = large.repartition(F.col("path"), F.col("first")).mapInArrow(ranges, schema)
    return small.unionByName(large)


def scan_separators(blocks: DataFrame, eod: int, dtype: str = "uint32", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document of the files: file, number, start, n_tokens (and ``keep``d).

    n_tokens leaves the separator out; start counts tokens from the file's beginning.
    A file that doesn't end with a separator has its last document end with the file.
    Kept array columns of a block must have an element for each document that ends in
    it; the document's own is returned.

    Defined cases: null token blocks are empty blocks; consecutive separators are empty
    documents; an empty table gives an empty result; repeated (file, block) rows are an
    error of the caller.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for content in batch.column(2):
                raw = content.as_buffer() if content.is_valid else b""
                tokens = np.frombuffer(raw, DTYPES[dtype])
                sizes.append(len(tokens))
                ends.append(np.flatnonzero(tokens == eod))
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ends) if ends else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[batch.column(i) for i in range(3, batch.num_columns)], pa.array(sizes, pa.int64()), flat], ["file", "block", *keep, "size", "ends"])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = "file string, block int, " + "".join(f"{c} {kinds[c]}, " for c in keep) + "size long, ends array<long>"
    found = blocks.select("file", "block", "tokens", *keep).mapInArrow(summary, schema)
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    n_ends = F.size("ends")
    found = found.withColumn("_first", F.coalesce(F.sum("size").over(before), F.lit(0)))
    found = found.withColumn("_number", F.coalesce(F.sum(n_ends).over(before), F.lit(0)))
    # Where the document that is open at the block's beginning began.
    last_end = F.when(n_ends > 0, F.col("_first") + F.element_at("ends", -1) + 1)
    found = found.withColumn("_open", F.coalesce(F.max(last_end).over(before), F.lit(0)))
    found = found.withColumn("_is_last", F.lead("block").over(in_order).isNull())
    stop = F.col("_first") + F.col("size")
    begins_after = F.coalesce(last_end, F.col("_open"))
    ends = F.transform("ends", lambda e: F.col("_first") + e)
    ends = F.when(F.col("_is_last") & (begins_after < stop), F.concat(ends, F.array(stop))).otherwise(ends)
    found = found.withColumn("_ends", ends)
    docs = found.select("file", "_number", "_open", "_ends", *keep, F.posexplode("_ends").alias("_k", "_end"))
    start = F.when(F.col("_k") == 0, F.col("_open")).otherwise(F.get("_ends", F.col("_k") - 1) + 1)
    kept = [F.get(c, F.col("_k")).alias(c) for c in keep]
    return docs.select("file", (F.col("_number") + F.col("_k")).alias("number"), start.alias("start"), (F.col("_end") - start).alias("n_tokens"), *kept)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, eod: int = END_OF_DOCUMENT, dtype: str = "uint16") -> DataFrame:
    """Tokenise all texts into flat token files under path, scan them, count by document.

    One row a row of df: the id, file, number in the file, start and n_tokens. The
    files are kept as Parquet blocks, which any store and a lost executor can take.
    The vocabulary is read on the driver and broadcast: its size is that of a file.

    Defined cases: a null or empty text has 0 tokens; null and repeated ids are just
    carried; an empty table gives an empty result; other columns aren't read.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(tokenizer))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs.mapInArrow(write_blocks(ranks, eod, dtype), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    out = scan_separators(blocks, eod, dtype, keep=("doc_ids",))
    return out.select(F.col("doc_ids").alias(id_col), "file", "number", "start", "n_tokens")
