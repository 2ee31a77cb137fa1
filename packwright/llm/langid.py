"""Language identification with string kernels.

Kernel: blended spectrum of byte n-grams over lower-cased UTF-8 letters, presence only
(a text counts as the set of its n-grams of all lengths in ``NGRAMS``), hashed to DIM
cells and normalised: k(x, y) = |X & Y| / sqrt(|X| |Y|). Nystroem: with landmarks L,
features are K(x, L) K(L, L)^(-1/2); one ridge regression a language against the rest is
solved on them. Scoring folds both matrices into one: presence matrix times landmark
matrix times weights, a batch of texts at once, with no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.textcore import Chunk, chunks

NGRAMS = (1, 2, 3, 4)
DIM = 1 << 13
#: Bounds of the labelled sample, fixed parameters: rows a language, and least landmarks.
MAX_PER_LANG = 400
LANDMARKS = 128
#: With many languages, so many landmarks each.
LANDMARKS_PER_LANG = 4
RIDGE = 1e-2
SHARPNESS = 8.0

_MULT = np.uint32(0x9E3779B1)
UNKNOWN = "und"


def normalised(buf: np.ndarray) -> np.ndarray:
    """Lower-cased bytes: A-Z and the Latin-1 capitals; other ASCII becomes a space."""
    out = buf.copy()
    upper = (buf >= 65) & (buf <= 90)
    out[upper] += 32
    letters = (out >= 97) & (out <= 122) | (out >= 128)
    out[~letters] = 32
    capital = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
    out[1:][capital] += 32
    return out


def presence(c: Chunk) -> np.ndarray:
    """The n-gram presence matrix (texts x DIM, float32) of a chunk."""
    x = np.zeros((len(c), DIM), np.float32)
    flat = x.reshape(-1)
    low = normalised(c.buf)
    owner = np.repeat(np.arange(len(c), dtype=np.int64) * DIM, c.ends - c.starts)
    code = np.zeros(len(low), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        m = len(low) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + low[n - 1 : n - 1 + m]
        if n not in NGRAMS:
            continue
        cell = (code * _MULT + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * _MULT >> np.uint32(19)
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        # A run of spaces says nothing: n-grams that begin with two of them are left out.
        if n > 1:
            inside &= (low[:m] != 32) | (low[1 : 1 + m] != 32)
        flat[(owner[:m] + cell)[inside]] = 1
    return x


def has_letter(c: Chunk, i: int) -> bool:
    part = c.buf[c.starts[i] : c.ends[i]]
    if (((part | 32) >= 97) & ((part | 32) <= 122) & (part < 128)).any():
        return True
    return bool((part >= 128).any()) and any(ch.isalpha() for ch in c.text(i).decode())


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # packed presence bits, landmarks x DIM/8
    weights: np.ndarray  # landmarks x langs

    def scores(self, x: np.ndarray) -> np.ndarray:
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return _kernel(x, marks) @ self.weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x) * SHARPNESS
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Presence kernels between the rows of two presence matrices, in one product."""
    nx, ny = np.sqrt(np.maximum(x.sum(axis=1), 1)), np.sqrt(np.maximum(y.sum(axis=1), 1))
    return (x @ y.T) / nx[:, None] / ny[None, :]


def fit(langs: list[str], packed: list[bytes], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression, one language against the rest, on Nystroem features.

    Landmarks are taken from the languages in turn. None if there is nothing to learn.
    """
    names = sorted(set(langs))
    if not names:
        return None
    bits = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), DIM // 8)
    place = {v: k for k, v in enumerate(names)}
    y = np.array([place[v] for v in langs])
    turn = np.zeros(len(y), np.int64)
    for k in range(len(names)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, turn))[: max(landmarks, LANDMARKS_PER_LANG * len(names))]
    marks = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    kmm = _kernel(marks, marks).astype(np.float64)
    val, vec = np.linalg.eigh(kmm)
    good = val > 1e-6 * val.max()
    root = vec[:, good] / np.sqrt(val[good]) @ vec[:, good].T
    # Every language weighs the same, however many rows it has.
    w = (1.0 / np.bincount(y, minlength=len(names)))[y][:, None]
    left, right = ridge * np.eye(len(root)) * w.sum() / len(y), np.zeros((len(root), len(names)))
    # A block of rows at once: unpacked, the sample of many languages is large.
    for at in range(0, len(y), 2048):
        part = slice(at, at + 2048)
        phi = _kernel(np.unpackbits(bits[part], axis=1).astype(np.float32), marks).astype(np.float64) @ root
        target = np.where(y[part, None] == np.arange(len(names)), 1.0, -1.0 if len(names) > 1 else 1.0)
        left += phi.T @ (w[part] * phi)
        right += phi.T @ (w[part] * target)
    coef = np.linalg.solve(left, right)
    return Model(names, bits[chosen], (root @ coef).astype(np.float32))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(2)):
            bits = np.packbits(presence(c).astype(bool), axis=1)
            rows = batch.slice(c.first, len(c))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], ["h", "lang", "bits"])


def remainder(id_col: Column) -> Column:
    """crc32 of the id as decimal text, modulo 4."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4


def train(df: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_per_lang: int = MAX_PER_LANG) -> Model | None:
    """Fit on at most max_per_lang rows of each language, those with the smallest id hash.

    One count a language sets the share of hashes that is looked at, so the candidates
    that reach the driver are bounded whatever the size of the table, as fixed-size bit
    sets (DIM/8 bytes) and not as texts. Every label value is learned. Null labels, null
    texts and null ids aren't used.
    """
    rows = df.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("i"))
    rows = rows.where("i is not null and lang is not null and text is not null").drop("i")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    # Twice the rows wanted in expectation; a small language is taken whole.
    shares = [(lang, int(min(1.0, 2.0 * max_per_lang / n) * (1 << 40))) for lang, n in counts]
    wanted = F.broadcast(df.sparkSession.createDataFrame(shares, "lang string, below long"))
    picked = rows.join(wanted, "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("below")).select("h", "lang", "text")
    bits = picked.mapInArrow(_features, "h long, lang string, bits binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "bits"))
    got = bits.withColumn("_nth", first).where(F.col("_nth") <= max_per_lang).drop("_nth").collect()
    got = sorted((h, lang, bytes(b)) for h, lang, b in got)
    langs, packed = [lang for _, lang, _ in got], [b for _, _, b in got]
    return fit(langs, packed)


def predictor(model: Model | None):
    """(anything..., text) batches with the predicted language and its score appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for c in chunks(batch.column(batch.num_columns - 1), 1 << 19):
                # At most 256 rows of the presence matrix at once.
                for at in range(0, len(c), 256):
                    s, e = c.starts[at : at + 256], c.ends[at : at + 256]
                    part = Chunk(c.first + at, c.buf[s[0] : e[-1]], s - s[0], e - s[0])
                    known = np.array([model is not None and has_letter(part, i) for i in range(len(part))], bool)
                    if model is None:
                        langs += [UNKNOWN] * len(part)
                        scores += [0.0] * len(part)
                        continue
                    p = model.probabilities(presence(part))
                    best = p.argmax(axis=1)
                    langs += [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    scores += [float(v) if k else 0.0 for v, k in zip(p.max(axis=1), known, strict=True)]
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return run


def identify(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """df's rows and columns, followed by lang_pred and score.

    Only the text is read for a prediction, the whole of it. Defined cases: a null text
    or one without a letter is ``und`` with score 0, and so is every row without a model;
    a column of df that is named lang_pred or score is replaced. Repeated rows and an
    empty table pass through.
    """
    names = [c for c in df.columns if c not in ("lang_pred", "score", text_col)]
    place = {c: f"_{i}" for i, c in enumerate(names)}
    packed = df.select(*[F.col(f"`{c}`").alias(place[c]) for c in names], F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema) + ", lang_pred string, score double"
    out = packed.mapInArrow(predictor(model), schema)
    back = [F.col(place[c]).alias(c) if c in place else F.col("_text").alias(text_col) for c in df.columns if c not in ("lang_pred", "score")]
    return out.select(*back, "lang_pred", "score")


def crc_remainder(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
