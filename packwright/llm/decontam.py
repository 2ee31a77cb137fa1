"""Benchmark decontamination by spaced-seed hashing.

Every mask looks at some positions of a word window and ignores the others, so a
substituted word in an ignored position leaves the hash as it was. The hashes of all
benchmark windows form a table; the training side computes the same hashes at every
position of every text and joins them with it. A hit proposes (item, diagonal); the
whole diagonal is then compared word by word, and the best window on it decides. Items
that agree with a text in the same words are looked at together and reported together,
so a template that many items share gives one row a document, not one a pair.

The masks lose nothing at the default identity. Of n words with at most n // 5 replaced,
some run of equal words has 4 or more, unless n is 15 and all runs have 3: there, as in
some shorter windows, 3 equal words, a replaced and an equal one stand together. Items of
5 to 7 words need the mirrored and the middle mask too; shorter ones must be equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.shared import without_ids
from packwright.llm.textcore import chunks, mix, word_hashes

#: The spaced seeds: 1 is a position that counts.
MASKS = ("1111", "11101")
#: More of them for items whose windows may be as short as 5 words.
SHORT_MASKS = ("10111", "11011")
SHORT_ITEM = 7
MIN_WINDOW = 13
IDENTITY = 0.8
#: Benchmark text that is held by one pass over the documents, in characters: the
#: table made from it is broadcast. A larger benchmark takes several passes.
MAX_BLOCK_CHARS = 4 << 20
#: Words compared on either side of a hit at first, and hits that are compared at once.
REACH = 2 * MIN_WINDOW
HITS_AT_ONCE = 1 << 16
#: Hits of one diagonal within so many words are judged by the first of them.
NEAR = 8
#: Word comparisons held at once, and pairs held before repeated ones are dropped.
CELLS_AT_ONCE = 1 << 22
PAIRS_AT_ONCE = 1 << 20
_BITS = 22

RESULT = "doc_id long, item_id long, doc_start int, item_start int, n_words int, n_same int, item_words int, n_items int"


def mask_offsets(mask: str) -> list[int]:
    return [i for i, x in enumerate(mask) if x == "1"]


def seed_hashes(words: np.ndarray, offsets: list[int], salt: int) -> np.ndarray:
    """The hash of each window of the word hashes; windows over text ends included."""
    m = max(0, len(words) - offsets[-1])
    acc = np.full(m, salt + 1, np.uint64)
    for o in offsets:
        acc = (acc ^ words[o : o + m]) * np.uint64(0x9FB21C651E98DF25)
        acc ^= acc >> np.uint64(29)
    return mix(acc)


class SeedTable:
    """The benchmark's seeds: sorted hashes, with the item and position of each."""

    def __init__(self, ids: list[int], texts: list[str | None], min_window: int = MIN_WINDOW):
        # Windows of less than 7 words come from short items, or from a lower min_window.
        self.short_item = SHORT_ITEM if min_window >= SHORT_ITEM else 1 << 31
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for c in chunks(pa.array(texts, pa.string())):
            w, offs = word_hashes(c)
            for i in range(len(c)):
                if offs[i + 1] > offs[i]:
                    self.ids.append(ids[c.first + i])
                    self.words.append(w[offs[i] : offs[i + 1]].copy())
        # Items shorter than every mask get one seed over all their words.
        shapes = [mask_offsets(m) for m in MASKS + SHORT_MASKS]
        least = min(s[-1] + 1 for s in shapes)
        short = sorted({len(w) for w in self.words if len(w) < least})
        self.shapes = shapes + [list(range(n)) for n in short]
        h, item, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for k, w in enumerate(self.words):
            for salt, shape in enumerate(self.shapes):
                if salt < len(MASKS) or (len(w) <= self.short_item if salt < len(shapes) else len(w) == len(shape)):
                    x = seed_hashes(w, shape, salt)
                    h.append(x)
                    item.append(np.full(len(x), k, np.int32))
                    pos.append(np.arange(len(x), dtype=np.int32))
        hashes = np.concatenate(h)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.pos = hashes[order], np.concatenate(item)[order], np.concatenate(pos)[order]
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.begins = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.words])

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, places in the table) of the seeds shared with a run of words."""
        if not len(self.hashes):
            return
        for salt, shape in enumerate(self.shapes):
            h = seed_hashes(words, shape, salt)
            near = np.flatnonzero(self.filter[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, h[near], "left"), np.searchsorted(self.hashes, h[near], "right")
            n = hi - lo
            # A word run that many items share has many places: a bounded number at once.
            stops = np.cumsum(n)
            a = 0
            while a < len(near):
                b = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + HITS_AT_ONCE, "right")))
                m = n[a:b]
                yield np.repeat(near[a:b], m), np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                a = b

    def likely(self, words: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, place: np.ndarray, min_window: int, identity: float) -> np.ndarray:
        """Which hits have enough equal words near them on their diagonal.

        A window of twice min_window or more splits into two, one of them with the identity
        too; so one shorter than that holds a hit, with all its words within its length. The
        hit given may stand for others up to NEAR - 1 words on.
        """
        item, pos = self.item[place], self.pos[place].astype(np.int64)
        size = self.begins[item + 1] - self.begins[item]
        need = np.minimum(min_window, -(-size * 8 // 10))
        reach = min(2 * min_window, max(REACH, int(2 * need.max(initial=0)))) + NEAR - 1
        equal = np.zeros(len(at), np.int64)
        for step in range(-reach, reach + 1):
            w, b = at + step, pos + step
            good = (w >= first) & (w < last) & (b >= 0) & (b < size)
            equal += good & (words[np.where(good, w, 0)] == self.flat[np.where(good, self.begins[item] + b, 0)])
        return equal >= identity * need - 1e-6


def best_window(same: np.ndarray, identity: float) -> tuple[int, int]:
    """The longest window with at least that share of equal words, its ends equal."""
    score = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - identity, -identity))]) + 1e-9 * np.arange(len(same) + 1)
    low = np.minimum.accumulate(score)
    best = (0, 0)
    for end in np.flatnonzero(same) + 1:
        start = int(np.searchsorted(-low, -score[end], "left"))  # the first start not above the end
        while start < end and not same[start]:
            start += 1
        if end - start > best[1] - best[0]:
            best = (start, int(end))
    return best


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The rows of a table in order, each once."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))[: len(rows)]]


def _pairs(table: SeedTable, words: np.ndarray, offs: np.ndarray, min_window: int, identity: float) -> np.ndarray:
    """(text, diagonal, item) rows, each once, of the hits with enough equal words around."""
    found, held = [np.zeros((0, 3), np.int64)], 0
    for at, place in table.hits(words):
        doc = np.searchsorted(offs, at, "right") - 1
        item, diag = table.item[place].astype(np.int64), at - offs[doc] - table.pos[place]
        order = np.lexsort((at, item, diag, doc))
        key = np.stack([doc, diag, item, at // NEAR], axis=1)[order]
        first = order[np.append(True, (key[1:] != key[:-1]).any(axis=1))[: len(order)]]
        at, place, doc, diag, item = at[first], place[first], doc[first], diag[first], item[first]
        keep = table.likely(words, offs[doc], offs[doc + 1], at, place, min_window, identity)
        found.append(np.stack([doc, diag, item], axis=1)[keep])
        held += int(keep.sum())
        if held > PAIRS_AT_ONCE:
            found, held = [_distinct(np.concatenate(found))], 0
    return _distinct(np.concatenate(found))


def _windows(table: SeedTable, words: np.ndarray, offs: np.ndarray, pairs: np.ndarray, min_window: int, identity: float) -> Iterator[tuple]:
    """(text, start in it, words, equal words, start in the items, items) of the best windows.

    The items of one diagonal are compared with the text as one table; those that agree
    with it in the same places have one window, which is looked for once.
    """
    sizes = np.diff(table.begins)
    needs = np.minimum(min_window, -(-sizes * 8 // 10))
    for group in np.split(pairs, np.flatnonzero((pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)) + 1):
        if not len(group):
            continue
        doc, diag = group[0, :2].tolist()
        w = words[offs[doc] : offs[doc + 1]]
        lo = max(0, -diag)
        stops = np.minimum(sizes[group[:, 2]], len(w) - diag)
        wide = int(stops.max()) - lo
        if wide <= 0:
            continue
        at, own = lo + np.arange(wide), w[lo + diag : lo + diag + wide]
        step = max(1, CELLS_AT_ONCE // wide)
        for k in range(0, len(group), step):
            items = group[k : k + step, 2]
            places = np.minimum(table.begins[items][:, None] + at, len(table.flat) - 1)
            same = (table.flat[places] == own) & (at < stops[k : k + step, None])
            _, first, kind = np.unique(np.packbits(same, axis=1), axis=0, return_index=True, return_inverse=True)
            kind = kind.reshape(-1)
            by_kind = np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind))[:-1])
            for row, members in zip(first.tolist(), by_kind, strict=True):
                start, end = best_window(same[row], identity)
                fit = items[members][needs[items[members]] <= end - start]
                if end > start and len(fit):
                    yield doc, lo + start + diag, end - start, int(same[row, start:end].sum()), lo + start, fit


def _verified(table: SeedTable, min_window: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0)
            for c in chunks(batch.column(1)):
                words, offs = word_hashes(c)
                pairs = _pairs(table, words, offs, min_window, identity)
                passages: dict[tuple, tuple] = {}
                for doc, start, n, n_same, item_start, items in _windows(table, words, offs, pairs, min_window, identity):
                    best = min(items.tolist(), key=lambda i: (table.ids[i] is None, table.ids[i] or 0))
                    order = (-n_same, table.ids[best] is None, table.ids[best] or 0, item_start)
                    old, names = passages.get((doc, start, n), (None, set()))
                    names.update(table.ids[i] for i in items.tolist())
                    made = (order, best, item_start, n_same)
                    passages[doc, start, n] = (made if old is None or order < old[0] else old), names
                for (doc, start, n), ((_, best, item_start, n_same), names) in sorted(passages.items(), key=lambda x: x[0]):
                    rows.append((ids[c.first + doc].as_py(), table.ids[best], start, item_start, n, n_same, len(table.words[best]), len(names)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return run


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_window: int = MIN_WINDOW,
    identity: float = IDENTITY,
    max_block_chars: int = MAX_BLOCK_CHARS,
) -> DataFrame:
    """One row a passage of a document that repeats benchmark items.

    A passage is the longest window on one diagonal with at least ``identity`` of its
    words equal, of min_window words or more (four fifths of a shorter item). Columns:
    doc_id, item_id, where it begins in the document and the item (in words), its
    length, the number of equal words, the item's length, and n_items, the number of
    items with this window of the document. item_id is that with most equal words, of
    those the smallest; the other items hold the same words there, but for substituted ones.

    No such passage is missed at an ``identity`` of 0.8 or more; at a lower one some may be.

    The benchmark's size is measured first; each ``max_block_chars`` of it are one
    broadcast table and one pass over the documents, without a shuffle of either. Items
    of different passes have rows of their own.

    Defined cases: null, empty and wordless texts and items take no part; null ids come
    back as null; repeated rows give repeated results; an empty table on either side
    gives an empty result; other columns aren't read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // max_block_chars))
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        table = SeedTable([r[0] for r in part], [r[1] for r in part], min_window)
        sent = df.sparkSession.sparkContext.broadcast(table)
        found = docs.mapInArrow(_on(sent, min_window, identity), RESULT)
        out = found if out is None else out.unionByName(found)
    return out


def _on(sent, min_window: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _verified(sent.value, min_window, identity)(batches)

    return run


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """df without the documents that hold a benchmark passage; rows with a null id stay.

    An empty benchmark leaves df as it is; df's columns may have any names.
    """
    return without_ids(df, contaminated(df, benchmark, id_col, **options).select("doc_id"), id_col)
