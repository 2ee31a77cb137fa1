"""Exact Jaccard join of word n-gram sets by a prefix tree.

Distribution. Equal sets are one node from the start. Sets of similar size meet only if
some part of them is equal: the hash space is cut into k parts with k above the largest
symmetric difference that the threshold allows for the size class, so two sets within
the threshold agree on at least one whole part (pigeonhole). A part's content hash is
its signature; small sets use the shingles of their prefix instead. Very frequent
shingles (by counts in hash buckets, gathered in the first pass) are left out of parts,
so that passages which very many documents share don't bring them together. Sets that share signatures, directly or through others, form a block;
each set is sent to its block once. Nothing is lost by this, and a shared passage alone
makes no block.

Heavy blocks. A block of more than ``max_shingles`` shingles is split before its texts
move: its shingles are counted, and two sets within the threshold share one of the
rarest that each set's prefix holds, so sets without a common prefix shingle part ways.
Only shingles that two sets of the block hold are ordered; a set's own ones just take
up its prefix.

Join. A block's sets, all ordered by the block's rarest shingle first, are stored in
radix tries, one for each group of sets whose prefixes meet. Each set walks its trie: a segment that many sets share is intersected
once, and a subtree is left as soon as the overlap so far plus the shorter of the
remaining lengths can't reach the threshold, or when all its sets are already in the
walking set's component. So a large group of near copies costs about one path a copy,
not one pair.

What is heavy even then is a group of near copies in truth. It is cut into slices of at
most ``max_shingles`` (a set alone may have more); each slice is joined by itself, and
one representative of each slice's main component with those of the other slices. Sets
that the block's main component doesn't hold by then are joined with all slices: the
cost grows with the block, times the slices that those few fill. A task returns a
spanning forest, never all pairs.
"""

from __future__ import annotations

import bisect
import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.graph import EDGE_SCHEMA, Forest, connected_components
from packwright.llm.shared import bounded_filter, materialize, maybe_in, salted_join
from packwright.llm.textcore import chunks, mix, shingle_sets

#: Shingles of a slice: 2 MB of hashes, and a task that joins two slices takes some
#: twenty times that at once.
MAX_SHINGLES = 1 << 18
#: Signatures that a task holds at once.
SIGNATURES_AT_ONCE = 1 << 20
#: Ratio of a size class's bounds: wider classes need more parts, narrower ones send
#: more sets to two classes.
CLASS_RATIO = 1.4
#: Shingles are counted in this many hash buckets, as so many pieces: the counts a task
#: sends and the mask that comes back (a bit a bucket) have a fixed size at any scale.
BUCKET_BITS, PIECES = 20, 16
#: Classes that begin below this size use prefixes.
SMALL = 48


def linked(inter: int, union: int, num: int, den: int) -> bool:
    """Jaccard similarity of at least num/den in whole numbers."""
    return den * inter >= num * union


def _bounds() -> list[int]:
    """Lower bounds of the size classes; the last is above any text's size."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_RATIO)))
    return out


_BOUNDS = _bounds()


def class_of(n: int) -> int:
    return bisect.bisect_right(_BOUNDS, n) - 1


def classes(n: int, num: int, den: int) -> range:
    """A set's own size class and those above that a partner's may be.

    Two sets within the threshold meet in the larger one's own class.
    """
    return range(class_of(n), class_of(n * den // num) + 1)


@functools.lru_cache(maxsize=4096)
def parts(c: int, num: int, den: int) -> tuple[int, int]:
    """(parts, spare) of a size class; a class of small sets has (0, 0).

    |A| + |B| = union + inter and inter >= num/den * union, so the symmetric difference
    is at most d = (|A| + |B|) * (den - num) / (den + num), and of d + 1 + spare parts
    at least spare + 1 are equal. So where a set has at most ``spare`` empty parts, one
    of the equal parts isn't empty, and its empty parts need no signatures.
    """
    # The smallest partner of the class's smallest set has this many shingles.
    least, top = -(-_BOUNDS[c] * num // den), _BOUNDS[c + 1] - 1
    if _BOUNDS[c] < SMALL:
        return 0, 0
    d, spare = 2 * top * (den - num) // (den + num), 0
    for spare in range(d + 1):
        k = d + 1 + spare
        empty = k * (1 - 1 / k) ** least
        if empty + 4 * math.sqrt(empty) <= spare:
            break
    return d + 1 + spare, spare


def set_digest(s: np.ndarray) -> tuple[int, int, int]:
    """128 bits that tell sets apart, and a name that close sets are likely to share.

    The name is made of the least values of two hash orders. Sets of the same name are
    one node while blocks are formed, so near copies send few edges: what that links too
    much is only looked at in the block, and nothing is lost.
    """
    if not len(s):
        return 0, 0, 0
    a, b = mix(s ^ np.uint64(0xA0761D6478BD642F)), mix(s ^ np.uint64(0xE7037ED1A0B428DB))
    name = mix(a.min(keepdims=True) ^ mix(b.min(keepdims=True)))
    return int(np.add.reduce(a).view(np.int64)), int(np.add.reduce(b).view(np.int64)), int(name.view(np.int64)[0])


def signatures(s: np.ndarray, num: int, den: int, hot: np.ndarray | None = None) -> np.ndarray:
    """The signatures of a sorted set, over all its size classes.

    hot marks buckets of very frequent shingles. They are left out of the parts: what is
    left of two sets differs by no more than the sets do, so with the number of parts
    for the whole sizes the argument of ``parts`` holds. Small sets give the shingles
    of the prefix that any partner's prefix must meet, those of hot buckets last.
    """
    out = []
    is_hot = np.zeros(len(s), bool) if hot is None else hot[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    rest = s[~is_hot]
    salted = np.uint64(0x589965CC75374CC3)
    mixed = mix(rest ^ salted)
    lo, hi = (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), (mixed >> np.uint64(32)).astype(np.float64)
    top = (rest >> np.uint64(32)).astype(np.int64)
    for c in classes(len(s), num, den):
        k, spare = parts(c, num, den)
        if not k:
            ordered = np.concatenate([rest, s[is_hot]])
            out.append(mix(ordered[: len(s) - -(-len(s) * num // den) + 1] ^ salted))
            continue
        part = (top * k) >> 32
        # Sums of 32-bit halves stay exact in float64 below 2**21 shingles a part.
        sums = np.bincount(part, lo, k).astype(np.uint64) + (np.bincount(part, hi, k).astype(np.uint64) << np.uint64(32))
        sums = mix(sums ^ mix(np.arange(k, dtype=np.uint64) + np.uint64(c << 40)))
        full = np.bincount(part, minlength=k) > 0
        out.append(sums if k - np.count_nonzero(full) > spare else sums[full])
    return np.unique(np.concatenate(out))


SET_SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, name long, piece int, counts binary"


def _set_rows(n: int):
    """(doc_id, text) to (doc_id, n_shingles, d1, d2, name), and at the end of a task the
    counts of its shingles by bucket (piece, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SET_SCHEMA.split(", ")]
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            size, d1, d2, name = [], [], [], []
            for c in chunks(batch.column(1)):
                sets = shingle_sets(c, n)
                for s in sets:
                    size.append(len(s))
                    for column, v in zip((d1, d2, name), set_digest(s), strict=True):
                        column.append(v)
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (size, d1, d2, name)], pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        parts_ = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in counts.reshape(PIECES, -1)]
        nothing = pa.nulls(PIECES, pa.int64())
        yield pa.RecordBatch.from_arrays([nothing] * 5 + [pa.array(range(PIECES), pa.int32()), pa.array(parts_, pa.binary())], names)

    return run


def _hot_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the counts of each piece; the buckets far above its mean, as bits."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(zlib.decompress(counts.as_buffer()), "<u4").astype(np.int64)
            sums[piece] = sums[piece] + x if piece in sums else x
    bits = [np.packbits(x > x.mean() + 8 * math.sqrt(x.mean()) + 8).tobytes() for x in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["piece", "bits"])


def hot_buckets(counts: DataFrame) -> np.ndarray:
    """The mask of frequent buckets from (piece, counts) rows: 128 KB reach the driver."""
    rows = counts.repartition("piece").mapInArrow(_hot_pieces, "piece int, bits binary").collect()
    out = np.zeros((PIECES, (1 << BUCKET_BITS) // PIECES), bool)
    for piece, bits in rows:
        out[piece] = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return out.reshape(-1)


def _stars(sig: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """The signatures once each with their smallest id, and a forest that links the
    other ids of a signature to it."""
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    first = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
    head = own[first][np.cumsum(first) - 1] if len(sig) else own
    rest = head != own
    forest = Forest()
    if rest.any():
        for x, y in np.unique(np.stack([own[rest], head[rest]], 1), axis=0).tolist():
            forest.union(x, y)
    inner = [x for x, p in forest.parent.items() if p != x]
    return sig[first], own[first], inner, [forest.find(x) for x in inner]


def _signature_rows(n: int, num: int, den: int, hot: np.ndarray):
    """Texts to (sig, name, other) rows.

    Of the names that share a signature, among as many texts as have SIGNATURES_AT_ONCE
    of them, only the smallest is sent; the others come as edges (other not null), a
    spanning forest. So a signature that a third of all documents have costs its
    reducer a row for thousands of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            sig, own, inner, root = _stars(np.concatenate(sigs), np.concatenate(owners))
            for at in range(0, len(sig), 100_000):
                part = own[at : at + 100_000]
                yield _edges(sig[at : at + 100_000].view(np.int64), part, pa.nulls(len(part), pa.int64()))
            yield _edges(mix(np.array(inner, np.int64).view(np.uint64)).view(np.int64), inner, root)

        for batch in batches:
            for c in chunks(batch.column(0)):
                for s in shingle_sets(c, n):
                    if len(s):
                        sigs.append(x := signatures(s, num, den, hot))
                        owners.append(np.full(len(x), set_digest(s)[2]))
                        held += len(x)
                        if held >= SIGNATURES_AT_ONCE:
                            yield from out()
                            sigs, owners, held = [], [], 0
        if held:
            yield from out()

    return run


def _edges(sig, own, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sig, own, other)], ["sig", "name", "other"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature (sig, name, other) to edges among names that share any.

    The rows are taken SIGNATURES_AT_ONCE at a time, each time as a spanning forest;
    the last signature and its head are carried on.
    """
    sigs, owners, held = [], [], 0

    def out() -> pa.RecordBatch:
        sig, own = np.concatenate(sigs), np.concatenate(owners)
        _, _, inner, root = _stars(sig, own)
        sigs[:], owners[:] = [sig[-1:]], [own[sig == sig[-1]].min(keepdims=True)]
        return pa.RecordBatch.from_arrays([pa.array(inner, pa.int64()), pa.array(root, pa.int64())], ["u", "v"])

    for batch in batches:
        given = batch.column(2).is_valid()
        yield pa.RecordBatch.from_arrays([batch.column(1).filter(given), batch.column(2).filter(given)], ["u", "v"])
        sent = batch.column(2).is_null()
        sigs.append(np.asarray(batch.column(0).filter(sent)))
        owners.append(np.asarray(batch.column(1).filter(sent)))
        held += len(sigs[-1])
        if held >= SIGNATURES_AT_ONCE:
            yield out()
            held = 0
    if held:
        yield out()


def _sharing(rows: DataFrame) -> DataFrame:
    """(node, root) of the names that share signatures (sig, name, other), through others too."""
    return connected_components(rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(_met, EDGE_SCHEMA))


class Trie:
    """A radix trie over sorted arrays of hashes, walked by sets that look for links.

    A node is a number. Its children are kept in groups: those known to hold one
    component only, by that component, and the mixed ones. Groups only ever merge, so
    a walk passes over all children in its own component at once. Children that are
    the tail of a single set are intersected together.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray], num: int, den: int, forest: Forest):
        order = sorted(range(len(ids)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.ids, self.sets = [ids[i] for i in order], [sets[i] for i in order]
        self.num, self.den, self.forest = num, den, forest
        self.lens = [len(s) for s in self.sets]
        self.seg: list[np.ndarray] = []  # the hashes between the parent and the node
        self.leaf: list[list[int]] = []  # sets that end here
        self.mixed: list[list[int]] = []  # children not known to be of one component
        self.pure: list[dict[int, list[int]]] = []  # the others, by a member's id
        self.short: list[int] = []  # the shortest and the longest set below
        self.long: list[int] = []
        self.tail: list[int] = []  # the set, if the node holds exactly one; else -1
        self._build()

    def _node(self) -> int:
        for x, empty in ((self.seg, None), (self.leaf, []), (self.mixed, []), (self.pure, {}), (self.short, 0), (self.long, 0), (self.tail, -1)):
            x.append(empty)
        return len(self.seg) - 1

    def _build(self) -> None:
        n = len(self.sets)
        shared = [0] * (n + 1)
        for i in range(1, n):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            apart = a[:m] != b[:m]
            shared[i] = int(apart.argmax()) if apart.any() else m
        # Ranges of sets with a common start: (first, last, depth of the parent, node).
        todo = [(0, n, 0, self._node())]
        while todo:
            first, last, depth, node = todo.pop()
            end = self.lens[first] if last - first == 1 else min(shared[first + 1 : last])
            self.seg[node] = self.sets[first][depth:end]
            below = self.lens[first:last]
            self.short[node], self.long[node] = min(below), max(below)
            if last - first == 1:
                self.tail[node] = first
            i = first
            while i < last and self.lens[i] == end:
                self.leaf[node].append(i)
                i += 1
            while i < last:
                j = i + 1
                while j < last and shared[j] > end:
                    j += 1
                kid = self._node()
                if j - i == 1:
                    self.pure[node].setdefault(self.ids[i], []).append(kid)
                else:
                    self.mixed[node].append(kid)
                todo.append((i, j, end, kid))
                i = j

    def _regroup(self, node: int) -> int | None:
        """Merge the groups of a node; its component if it is found to have only one."""
        find = self.forest.find
        groups: dict[int, list[int]] = {}
        for member, kids in self.pure[node].items():
            have = groups.get(root := find(member))
            if have is None:
                groups[root] = kids
            elif len(have) < len(kids):
                kids.extend(have)
                groups[root] = kids
            else:
                have.extend(kids)
        mixed = []
        for kid in self.mixed[node]:
            if not self.mixed[kid] and (root := self._regroup(kid)) is not None:
                groups.setdefault(root, []).append(kid)
            else:
                mixed.append(kid)
        self.pure[node], self.mixed[node] = groups, mixed
        if mixed or len(groups) > 1:
            return None
        roots = {*groups, *(find(self.ids[i]) for i in self.leaf[node])}
        return roots.pop() if len(roots) == 1 else None

    def link(self, x: int, s: np.ndarray) -> None:
        """Unite set s of id x with every stored set within the threshold."""
        forest, num, den, nx = self.forest, self.num, self.den, len(s)
        stack = [(0, 0, 0, 0)]
        while stack:
            node, at, met, depth = stack.pop()
            if self.long[node] * den < nx * num or nx * den < self.short[node] * num:
                continue
            if (root := self._regroup(node)) is not None and root == forest.find(x):
                continue
            seg = self.seg[node]
            if len(seg):
                rest = s[at:]
                spot = np.searchsorted(rest, seg)
                inside = spot < len(rest)
                met += int(np.count_nonzero(rest[spot[inside]] == seg[inside]))
                at += int(np.searchsorted(rest, seg[-1], "right"))
                depth += len(seg)
            # inter/(nx + ny - inter) >= num/den, so inter >= num*(nx + ny)/(den + num).
            most = met + min(nx - at, self.long[node] - depth)
            if most * (den + num) < num * (nx + max(self.short[node], depth)):
                continue
            for i in self.leaf[node]:
                if met * (den + num) >= num * (nx + self.lens[i]):
                    forest.union(x, self.ids[i])
            tails, own = [], forest.find(x)
            for member, kids in self.pure[node].items():
                if forest.find(member) != own:
                    for kid in kids:
                        if self.tail[kid] >= 0:
                            tails.append(kid)
                        else:
                            stack.append((kid, at, met, depth))
            stack.extend((kid, at, met, depth) for kid in self.mixed[node])
            if tails:
                self._tails(x, s[at:], nx, met, tails)

    def _tails(self, x: int, rest: np.ndarray, nx: int, met: int, nodes: list[int]) -> None:
        """The same test for many single-set tails at once."""
        num, den = self.num, self.den
        ny = np.array([self.short[k] for k in nodes])
        fits = np.flatnonzero((ny * den >= nx * num) & (nx * den >= ny * num))
        if not len(fits):
            return
        segs = [self.seg[nodes[k]] for k in fits]
        every = np.concatenate(segs)
        hit = np.zeros(len(every), np.int64)
        if len(rest):
            spot = np.searchsorted(rest, every)
            np.equal(rest[np.minimum(spot, len(rest) - 1)], every, out=hit, casting="unsafe")
        counts = met + np.add.reduceat(hit, np.cumsum([0, *map(len, segs[:-1])]))
        for k in fits[counts * (den + num) >= num * (nx + ny[fits])].tolist():
            self.forest.union(x, self.ids[self.tail[nodes[k]]])


def join_block(ids: list[int], sets: list[np.ndarray], num: int, den: int, halves: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's sets.

    halves: whether each set is stored (0) or walks (1); without it every set does both.
    """
    crossing = halves is not None
    if crossing and not 0 < sum(halves) < len(halves):
        return []
    if len(ids) == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if linked(inter, len(sets[0]) + len(sets[1]) - inter, num, den) else []
    forest = Forest()
    ranked, groups = rare_first(sets, num, den)
    for own in groups:
        stored = [i for i in own if not crossing or halves[i] == 0]
        walking = [i for i in own if not crossing or halves[i] == 1]
        if stored and walking:
            trie = Trie([ids[i] for i in stored], [ranked[i] for i in stored], num, den, forest)
            for i in walking:
                trie.link(ids[i], ranked[i])
    return [(x, forest.find(x)) for x, p in forest.parent.items() if p != x]


def rare_first(sets: list[np.ndarray], num: int, den: int) -> tuple[list[np.ndarray], list[list[int]]]:
    """The sets as ranks, the block's rarest shingle first, and groups that may link.

    Two sets within the threshold share a shingle of their prefixes, under any common
    order. With the rare ones first, what a common passage brings stands at the end of
    the sets and not in their prefixes; so sets that share no more than a passage fall
    into different groups, and sets without a shared prefix shingle into none.
    """
    sizes = [len(s) for s in sets]
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, counts))] = np.arange(len(values))
    ranked = [np.sort(r) for r in np.split(rank[place], np.cumsum(sizes)[:-1])]
    single = int((counts == 1).sum())  # ranks below are held by one set only
    prefixes = [r[: n - -(-n * num // den) + 1] for r, n in zip(ranked, sizes, strict=True)]
    prefixes = [x[np.searchsorted(x, single) :] for x in prefixes]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in prefixes])
    token = np.concatenate(prefixes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    same = np.flatnonzero(token[1:] == token[:-1])
    near = Forest()
    if len(same):
        for x, y in np.unique(np.stack([owner[same], owner[same + 1]], 1), axis=0).tolist():
            near.union(x, y)
    groups: dict[int, list[int]] = {}
    for i in sorted(near.parent):
        groups.setdefault(near.find(i), []).append(i)
    return ranked, list(groups.values())


def _joined_blocks(n: int, num: int, den: int, crossing: bool):
    """Rows sorted by task (root, low, high, half, node, text) to forest edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sets, halves, edges = None, [], [], [], []

        def flush():
            if len(ids) > 1:
                edges.extend(join_block(ids, sets, num, den, halves if crossing else None))
            ids.clear(), sets.clear(), halves.clear()

        def out():
            part = pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["u", "v"])
            edges.clear()
            return part

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True))
            half, node = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for c in chunks(batch.column(5)):
                for i, s in enumerate(shingle_sets(c, n), c.first):
                    if keys[i] != block:
                        flush()
                        block = keys[i]
                    ids.append(node[i])
                    sets.append(s)
                    halves.append(half[i])
            if len(edges) > 10_000:
                yield out()
        flush()
        yield out()

    return run


def _block_tokens(n: int):
    """(root, doc_id, n, text) to (doc_id, n, token): the set's shingles, told apart by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, ids, sizes = (np.asarray(batch.column(i)) for i in range(3))
            for c in chunks(batch.column(3)):
                sets = shingle_sets(c, n)
                lens = [len(s) for s in sets]
                rows = np.repeat(np.arange(c.first, c.first + len(c)), lens)
                token = mix(np.concatenate(sets) ^ mix(roots[rows].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(sizes[rows]), pa.array(token.view(np.int64))], ["doc_id", "n", "token"])

    return run


class _Join:
    """The steps of one join that need its parameters and texts."""

    def __init__(self, texts: DataFrame, n: int, num: int, den: int, max_shingles: int):
        self.texts, self.n, self.num, self.den, self.max_shingles = texts, n, num, den, max_shingles

    def with_texts(self, placed: DataFrame) -> DataFrame:
        """placed with its texts; texts that aren't asked for stay where they are."""
        needed = maybe_in(self.texts, "doc_id", bounded_filter(placed.select("doc_id")))
        return placed.join(needed.hint("merge"), "doc_id")

    def split(self, inside: DataFrame) -> DataFrame:
        """Heavy blocks (doc_id, n, root) as lighter ones; sets that can't link drop out."""
        tokens = self.with_texts(inside).select("root", "doc_id", "n", "text").mapInArrow(_block_tokens(self.n), "doc_id long, n long, token long")
        tokens = materialize(tokens, "tokens")
        held = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
        shared = salted_join(tokens, held, ["token"], "doc_id")
        own = Window.partitionBy("doc_id")
        shared = shared.withColumn("_nth", F.row_number().over(own.orderBy("held", "token"))).withColumn("_all", F.count("*").over(own))
        # The prefix is the n - ceil(n * num / den) + 1 rarest; n - _all of them are the set's alone.
        prefix = shared.where(F.expr(f"_nth <= _all + 1 - (n * {self.num} + {self.den - 1}) div {self.den}"))
        roots = _sharing(prefix.select(F.col("token").alias("sig"), F.col("doc_id").alias("name"), F.lit(None).cast("long").alias("other")))
        return inside.join(roots, inside.doc_id == roots.node).select("doc_id", "n", roots.root)

    def run(self, tasks: DataFrame, crossing: bool = False) -> DataFrame:
        """Forest edges of the tasks (root, low, high, half, doc_id)."""
        texts = self.with_texts(tasks).select("root", "low", "high", "half", F.col("doc_id").alias("node"), "text")
        # The number is given so that small blocks aren't put together again by their bytes.
        n_parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = texts.repartition(n_parts, "root", "low", "high").sortWithinPartitions("root", "low", "high")
        return materialize(texts.mapInArrow(_joined_blocks(self.n, self.num, self.den, crossing), EDGE_SCHEMA), "links")

    def sliced(self, members: DataFrame) -> DataFrame:
        """(doc_id, n, root, slices, slice): each root's sets dealt to slices by size."""
        sizes = members.groupBy("root").agg(F.count("*").alias("_sets"), F.sum("n").alias("_all")).where("_sets > 1")
        cut = sizes.select("root", F.ceil(F.col("_all") / F.lit(self.max_shingles)).cast("int").alias("slices"))
        placed = salted_join(members, cut, ["root"], "doc_id")
        return placed.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))

    def links(self, blocks: DataFrame) -> DataFrame:
        """Edges (u, v) that link what is linked within the blocks (doc_id, n, root)."""
        placed = materialize(self.sliced(blocks), "slices")
        links = self.run(placed.select("root", F.col("slice").alias("low"), F.col("slice").alias("high"), F.lit(0).alias("half"), "doc_id"))
        members = placed.where("slices > 1")
        if not members.take(1):
            return links
        parts = self.components(members, links)
        main = parts.groupBy("root", "slice", "part").agg(F.sum("n").alias("_n")).groupBy("root", "slice").agg(F.max_by("part", "_n").alias("doc_id"))
        links = links.unionByName(self.run(main.select("root", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("half"), "doc_id")))
        parts = materialize(self.components(members, links), "parts")
        main = parts.groupBy("root", "part").agg(F.sum("n").alias("_n")).groupBy("root").agg(F.max_by("part", "_n").alias("_main"))
        rest = salted_join(parts, main, ["root"], "doc_id").where("part <> _main").select("doc_id", "n", "root", F.col("slices").alias("_others"))
        sizes = rest.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(self.max_shingles)).cast("int").alias("walks"))
        walking = salted_join(rest, sizes, ["root"], "doc_id")
        walking = walking.select("root", F.pmod(F.xxhash64("doc_id"), F.col("walks")).cast("int").alias("low"), F.explode(F.sequence(F.lit(0), F.col("_others") - 1)).alias("high"), F.lit(1).alias("half"), "doc_id")
        stored = salted_join(members, sizes, ["root"], "doc_id")
        stored = stored.select("root", F.explode(F.sequence(F.lit(0), F.col("walks") - 1)).alias("low"), F.col("slice").alias("high"), F.lit(0).alias("half"), "doc_id")
        return links.unionByName(self.run(stored.unionByName(walking), crossing=True))

    def components(self, members: DataFrame, links: DataFrame) -> DataFrame:
        """members with the smallest id that the links reach from each, as part."""
        roots = connected_components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("_part"))
        return members.join(roots, "doc_id", "left").withColumn("part", F.coalesce("_part", "doc_id")).drop("_part")


def jaccard_components(
    df: DataFrame,
    n: int = 5,
    num: int = 8,
    den: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_shingles: int = MAX_SHINGLES,
) -> DataFrame:
    """One row a row of df: the id, n_shingles and component_id.

    Two documents link when inter * den >= union * num over their sets of n-word
    shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; with fewer than n words
    the whole sequence is one shingle). component_id is the smallest id reachable.

    Defined cases: a null, empty or wordless text has the empty set, which is linked
    with nothing; rows with a null id get a null component_id; rows that repeat an id
    are one node (each row keeps its own n_shingles, the node has the links of all of
    them); an empty table gives an empty result; other columns aren't read. Ids are
    whole numbers: the column is cast to long, and text that isn't one fails the job.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(docs.mapInArrow(_set_rows(n), SET_SCHEMA), "sets")
    hot = hot_buckets(rows.where("piece is not null").select("piece", "counts"))
    sized = rows.where("piece is null").drop("piece", "counts")
    some = sized.where("n_shingles > 0 and doc_id is not null")
    # Equal sets are one node: only the smallest id of each goes on.
    same = materialize(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("_last"), F.max("n_shingles").alias("n"), F.max("name").alias("name")), "nodes")

    full = docs.where("doc_id is not null and text is not null")
    blocks = _sharing(full.select("text").mapInArrow(_signature_rows(n, num, den, hot), "sig long, name long, other long"))
    alone = salted_join(same.select(F.col("node").alias("doc_id"), "n", "name"), blocks.withColumnRenamed("node", "name"), ["name"], "doc_id", how="left")
    alone = materialize(alone.select("doc_id", "n", F.coalesce("root", "name").alias("root")), "blocks")
    join = _Join(full, n, num, den, max_shingles)
    heavy = materialize(alone.groupBy("root").agg(F.sum("n").alias("_all")).where(F.col("_all") > max_shingles).select("root"), "heavy")
    if heavy.take(1):
        inside = materialize(salted_join(alone, heavy, ["root"], "doc_id"), "inside")
        light = alone.join(heavy, "root", "left_anti")
        alone = light.select("doc_id", "n", "root").unionByName(join.split(inside).select("doc_id", "n", "root"))
    links = join.links(alone)

    # Ids whose rows have different sets hold those sets' nodes together.
    many = materialize(some.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("b")).where("a <> b").select("doc_id"), "repeated")
    if many.take(1):
        rows_of = some.join(many, "doc_id").select("doc_id", "d1", "d2").distinct()
        links = links.unionByName(rows_of.join(same, ["d1", "d2"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    roots = connected_components(links)
    known = same.join(roots, "node", "left").where("root is not null or _last > node").select("d1", "d2", F.coalesce("root", "node").alias("component_id"))
    found = salted_join(some, known, ["d1", "d2"], "doc_id", how="left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    without = sized.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(without).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")
