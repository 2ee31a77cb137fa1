"""Corpus-wide line deduplication: explode, hash, count documents, drop, reassemble."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.shared import salted_join
from packwright.llm.textcore import SPACE, SpanHash, chunks

LINE_SCHEMA = "doc_id long, row_key long, pos int, h1 long, h2 long"


def _lines(c):
    """Starts and ends of all lines of a chunk, each line's text, and its place there."""
    breaks = np.flatnonzero(c.buf == 10)
    starts = np.concatenate([c.starts, breaks + 1])
    owner = np.concatenate([np.arange(len(c)), np.searchsorted(c.ends, breaks, "right")])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = c.ends[owner[last]]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    pos = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    return starts, ends, owner, pos


def _strip(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lines without white space at both ends."""
    solid = np.flatnonzero(~SPACE[buf])
    if not len(solid):
        return starts, starts
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends) - 1
    some = b >= a
    return np.where(some, solid[np.minimum(a, len(solid) - 1)], starts), np.where(some, solid[b] + 1, starts)


def hashed_lines(min_chars: int):
    """(doc_id, row_key, text) batches to the 128-bit key hashes of all lines long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for c in chunks(batch.column(2)):
                starts, ends, owner, pos = _lines(c)
                s, e = _strip(c.buf, starts, ends)
                points = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])
                keep = points[e] - points[s] >= min_chars
                s, e = s[keep], e[keep]
                rows = pa.array(owner[keep] + c.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows),
                        keys.take(rows),
                        pa.array(pos[keep].astype(np.int32)),
                        pa.array(SpanHash(c.buf, True, 0).of(s, e).view(np.int64)),
                        pa.array(SpanHash(c.buf, True, 1).of(s, e).view(np.int64)),
                    ],
                    ["doc_id", "row_key", "pos", "h1", "h2"],
                )

    return run


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, drops) to (doc_id, n_lines, n_dropped, kept)."""
    for batch in batches:
        drops = batch.column(2)
        n_lines, n_dropped, kept = [], [], []
        for text, drop in zip(batch.column(1), drops, strict=True):
            text = text.as_py() or ""
            gone = drop.as_py()
            if gone:
                lines = text.split("\n")
                gone = set(gone)
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            else:
                kept.append(text)
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_text"],
        )


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row_key, drops): the line positions that each row loses, where it loses any.

    row_key is a hash of the text: it tells rows apart that share an id.

    Distinct documents are counted by two hash aggregations with partial sums, so a
    line that a third of all documents hold reaches its reducer as one row a task. The
    join back splits hot lines.
    """
    lines = _rows(df, id_col, text_col).where("doc_id is not null and text is not null").mapInArrow(hashed_lines(min_chars), LINE_SCHEMA)
    common = (
        lines.select("h1", "h2", "doc_id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    hit = salted_join(lines, common, ["h1", "h2"], "doc_id").where("doc_id <> keeper")
    return hit.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("drops"))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row a row of df: the id, n_lines, n_dropped and the text that is left.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
    lower-cased. Keys of at least min_chars code points found in at least min_docs
    distinct ids lose all their lines except in the largest id that holds them.

    Defined cases: a null or empty text is one empty line, kept as the empty text; rows
    with a null id keep all their lines and don't count as documents; rows that repeat
    an id are one document for the count and each keeps or loses its own lines; an
    empty table gives an empty result; other columns aren't read.
    """
    drops = dropped_lines(df, id_col, text_col, min_chars, min_docs)
    docs = _rows(df, id_col, text_col).join(drops, ["doc_id", "row_key"], "left").select("doc_id", "text", "drops")
    out = docs.mapInArrow(_reassembled, "doc_id long, n_lines long, n_dropped long, kept_text string")
    return out.withColumnRenamed("doc_id", id_col)


def replace_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """df with each text replaced by its kept lines; all rows, columns and ids stay.

    A null text stays null. Columns of df may have any names.
    """
    drops = dropped_lines(df, id_col, text_col, min_chars, min_docs).select(F.col("doc_id").alias("_drop_id"), F.col("row_key").alias("_drop_key"), F.col("drops").alias("_drops"))
    names = [f"_c{i}" for i in range(len(df.columns))]
    place = dict(zip(df.columns, names, strict=True))
    rows = df.toDF(*names)
    text = F.col(place[text_col])
    joined = rows.join(drops, (F.col(place[id_col]) == F.col("_drop_id")) & (F.xxhash64(text.cast("string")) == F.col("_drop_key")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drops"))
    new = F.when(F.col("_drops").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return joined.select(*[(new if c == text_col else F.col(place[c])).alias(c) for c in df.columns])
