import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from packwright.llm import chains, graph, jaccard
from packwright.llm.textcore import chunks, gram_hashes, word_hashes

WORD = r"[^\x20\x09-\x0d]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, n):
    w = re.findall(WORD, lower(t))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, num, den):
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    inter = Counter((b, a) for own in held.values() for k, a in enumerate(own) for b in own[:k])
    for (a, b), m in inter.items():
        if den * m >= num * (len(sets[a]) + len(sets[b]) - m):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def vary(rng, words, rate):
    return " ".join(rng.choice(["zz", "yy", w.upper(), w + "x"]) if rng.random() < rate else w for w in words)


def corpus(seed, n=140):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(m)] for m in (2, 3, 5, 12, 40, 90, 160, 400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs = []
    for i in range(n):
        base = rng.choice(bases)
        text = vary(rng, base, rng.choice([0, 0, 0.005, 0.02, 0.05]))
        if rng.random() < 0.3:
            text += "\n" + passage
        docs.append((i * 3, text))
    docs += [(1000, ""), (1001, None), (1002, "\t \n"), (1003, "one"), (1004, "ONE"), (1005, "one\xa0two"), (1006, "ONE\xa0two")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 8, 10)])
@pytest.mark.parametrize("max_shingles", [1 << 18, 700])
def test_components_equal_brute_force(spark, n, num, den, max_shingles):
    docs = corpus(n)
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, n, num, den, max_shingles=max_shingles).collect()}
    assert got == brute(docs, n, num, den)


def test_jaccard_edge_rows(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (7, "q r s t u"), (9, "q r s t u"), (3, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, schema), 3, 9, 10).collect()), key=str)
    assert got == sorted([(None, 2, None), (7, 2, 7), (7, 2, 7), (7, 3, 7), (9, 3, 7), (3, 0, 3)], key=str)
    assert jaccard.jaccard_components(spark.createDataFrame([], schema)).count() == 0


def test_trie_and_signatures_lose_nothing():
    rng = np.random.default_rng(0)
    pick = random.Random(1)
    for _ in range(120):
        num, den = pick.choice([(9, 10), (8, 10), (1, 2)])
        ids = list(range(pick.randint(2, 30)))
        pick.shuffle(ids)
        bases = [rng.integers(0, 2**63, m, dtype=np.uint64) for m in (3, 20, 60, 150)]
        sets = []
        for _ in ids:
            b = pick.choice(bases)
            s = np.unique(np.concatenate([b[rng.random(len(b)) > pick.choice([0, 0.02, 0.1])], rng.integers(0, 2**63, pick.choice([0, 0, 2]), dtype=np.uint64)]))
            sets.append(s if len(s) else np.unique(b))
        want, got = graph.Forest(), graph.Forest()
        hot = np.zeros(1 << jaccard.BUCKET_BITS, bool)
        for s in sets[:2]:  # any shingles may count as frequent
            hot[(s[pick.random() < 0.5 :: pick.choice([1, 2, 5])] >> np.uint64(64 - jaccard.BUCKET_BITS)).astype(np.int64)] = True
        signed = [set(jaccard.signatures(s, num, den, hot).tolist()) for s in sets]
        for i in range(len(ids)):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if jaccard.linked(inter, len(sets[i]) + len(sets[j]) - inter, num, den):
                    want.union(ids[i], ids[j])
                    assert signed[i] & signed[j]
        for a, b in jaccard.join_block(ids, sets, num, den):
            got.union(a, b)
        assert [got.find(i) for i in ids] == [want.find(i) for i in ids]


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(-50, 400), rng.randint(-50, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(3000, 3200)] + [(5, 5)]
    forest = graph.Forest()
    for a, b in edges:
        forest.union(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(4)
    got = {r.node: r.root for r in graph.connected_components(df).collect()}
    assert got == {x: forest.find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.connected_components(df.limit(0)).count() == 0


def test_words_and_grams_equal_the_pattern():
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab AB\t\n\x0b\x1f\xa0é　") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, ""]
    for limit in (8, 1 << 20):
        seen = {}
        for c in chunks(pa.array(texts, pa.string()), limit):
            words, offs = word_hashes(c)
            for i in range(len(c)):
                want = re.findall(WORD, lower(texts[c.first + i]))
                own = words[offs[i] : offs[i + 1]].tolist()
                assert len(own) == len(want)
                for h, w in zip(own, want, strict=True):
                    assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(gram_hashes(np.arange(4, dtype=np.uint64), 9)) == 0


# ---- chains ---------------------------------------------------------------------------


def passages(spark, docs, **options):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, anchor int").repartition(3)
    return {(r.doc_id, r.anchor): r for r in chains.repeated_passages(df, **options).collect()}


def test_planted_passages(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    exact, fuzzy, short, huge = fresh(60), fresh(90), fresh(30), fresh(1500)
    edited = list(fuzzy)
    edited[20] = "changed"
    del edited[50]
    edited.insert(70, "added")
    text = lambda *parts: " ".join(w for p in parts for w in p)
    docs = [
        (1, text(fresh(80), exact, fresh(30))), (2, text(exact, fresh(200))), (3, text(fresh(5), fuzzy)), (4, text(fresh(100), edited, fresh(10))), (5, text(fresh(50), short)), (6, text(short, fresh(50))),
        (7, text(huge)), (8, text(huge)), (9, text(fresh(20), huge[:700], ["odd"], huge[701:], fresh(20))), (10, text(fresh(300))), (11, ""), (12, None), (13, text(exact, fresh(40), exact)),
    ]
    got = passages(spark, docs)
    assert set(got) == {(2, 1), (13, 1), (4, 3), (8, 7), (9, 7)}
    assert (got[2, 1].start, got[2, 1].end, got[2, 1].anchor_start, got[2, 1].anchor_end) == (0, 60, 80, 140)
    assert got[4, 3].start == 100 and got[4, 3].end == 190 and got[4, 3].n_same == 88
    assert (got[9, 7].start, got[9, 7].end, got[9, 7].n_same) == (20, 1520, 1499)
    both = chains.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id = 13").orderBy("start").collect()
    assert [(r.start, r.end) for r in both] == [(0, 60), (100, 160)]


def test_a_passage_of_repeated_lines(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    line = fresh(20)
    got = passages(spark, [(1, " ".join(fresh(30) + line * 4)), (2, " ".join(line * 4 + fresh(30))), (3, " ".join(line + fresh(60)))])
    assert set(got) == {(2, 1)} and (got[2, 1].start, got[2, 1].end, got[2, 1].anchor_start, got[2, 1].n_same) == (0, 80, 30, 80)


@pytest.mark.parametrize("smaller", [True, False])
def test_third_documents_that_hold_pieces_hide_no_passage(spark, smaller):
    rng = random.Random(19)
    fresh = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    passage, pieces = fresh(120), fresh(60)
    third = [(k + (0 if smaller else 120), " ".join(fresh(20) + passage[11 * k : 11 * k + 22])) for k in range(10)]
    third += [(10 + (0 if smaller else 120), " ".join(pieces[:40])), (11 + (0 if smaller else 120), " ".join(pieces[20:]))]
    docs = [(100, " ".join(fresh(30) + passage)), (200, " ".join(passage + fresh(9))), (301, " ".join(fresh(8) + pieces)), (305, " ".join(pieces + fresh(8)))]
    got = passages(spark, docs + third)
    assert {(200, 100), (305, 301)} <= set(got)
    assert (got[200, 100].start, got[200, 100].end) == (0, 120) and (got[305, 301].start, got[305, 301].end) == (0, 60)


@pytest.mark.parametrize("smaller", [True, False])
def test_third_documents_that_hold_pieces_hide_no_fuzzy_passage(spark, smaller):
    rng = random.Random(31)
    fresh = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    passage = fresh(88)
    edited = [w if i % 22 != 21 else f"e{i}" for i, w in enumerate(passage)]  # no long run is left
    third = [(k + (0 if smaller else 70), " ".join(fresh(20) + passage[11 * k : 11 * k + 22] + fresh(20))) for k in range(8)]
    docs = [(60, " ".join(fresh(30) + passage)), (200, " ".join(edited + fresh(9))), (201, " ".join(fresh(4) + edited))]
    df = spark.createDataFrame(docs + third, "doc_id long, text string").coalesce(1)  # all texts are held at once
    got = {(r.doc_id, r.anchor): r for r in chains.repeated_passages(df).collect()}
    assert {(200, 60)} < set(got) <= {(200, 60), (201, 60), (201, 200)}
    assert (got[200, 60].start, got[200, 60].anchor_start, got[200, 60].n_same) == (0, 30, 84)


def test_a_seed_that_repeats_in_the_anchor(spark):
    rng = random.Random(29)
    fresh = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    q, r = fresh(40), fresh(20)
    got = passages(spark, [(1, " ".join(q + fresh(300) + q + r)), (2, " ".join(fresh(5) + q + r))])
    assert (got[2, 1].start, got[2, 1].end, got[2, 1].anchor_start) == (5, 65, 340)


def test_alignments_are_optimal_and_long_ones_bounded():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = (rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64) for _ in range(2))
        score = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                score[i, j] = max(0, score[i - 1, j - 1] + (1 if x == y else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
        c = chains.align(a, b)
        assert 2 * int(c.same[-1]) - len(c.equal) == score.max()
        for t, same in enumerate(c.equal):
            if c.a[t + 1] > c.a[t] and c.b[t + 1] > c.b[t]:
                assert (a[c.a[t]] == b[c.b[t]]) == same
            else:
                assert not same
    tracemalloc.start()
    a = np.tile(rng.integers(0, 2**60, 7).astype(np.uint64), 7200)
    b = np.delete(a, [5, 700, 30_000])
    b[400::997] = 3
    c = chains.align_chain(a, b)
    assert int(c.same[-1]) > 50_300 and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_the_window_minima_of_many_texts():
    rng = np.random.default_rng(8)
    for _ in range(40):
        lens = rng.integers(0, 40, 12)
        offs = np.concatenate([[0], np.cumsum(lens)])
        words = rng.integers(0, 6, offs[-1]).astype(np.uint64)
        grams = gram_hashes(words, 4)
        want = [x for a, b in zip(offs, offs[1:], strict=False) for x in (chains.minimizers(grams[a : max(a, b - 3)], 5) + a).tolist()]
        assert chains.batch_minimizers(grams, offs, 4, 5).tolist() == want


def test_an_exact_passage_before_a_filled_in_template(spark):
    rng = random.Random(17)
    fresh = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    exact, shared = fresh(50), [fresh(17) for _ in range(3)]
    form = lambda: exact + [w for s in shared for w in fresh(25) + s]
    got = passages(spark, [(1, " ".join(form())), (2, " ".join(fresh(9) + form()))])
    assert set(got) == {(2, 1)}
    assert (got[2, 1].start, got[2, 1].end, got[2, 1].anchor_start, got[2, 1].n_same) == (9, 59, 0, 50)


def test_stretches_find_every_alignment_that_holds_one():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(0, 40))
        equal = rng.random(n) < rng.choice([0.5, 0.7, 0.9])
        kind = np.where(equal, 2, rng.integers(0, 3, n))
        c = chains.Columns(3, 5, kind != 0, kind != 1, equal)
        good = lambda t: min(t[1] - t[0], t[3] - t[2]) >= 10 and t[4] >= 0.7 * t[5]
        found = chains.stretches(c, 10, 0.7)
        assert all(map(good, found)) and all(a[1] <= b[0] and a[3] <= b[2] for a, b in zip(found, found[1:], strict=False))
        assert bool(found) == any(good(c.bounds(i, j)) for i in range(n) for j in range(i + 1, n + 1) if equal[i] and equal[j - 1])


def test_alignments_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(11)
    for _ in range(20):
        some = [[rng.integers(0, 5, rng.integers(1, 40)).astype(np.uint64) for _ in range(2)] for _ in range(17)]
        x, y = np.full((17, 40), -2, np.int16), np.full((17, 40), -1, np.int16)
        for r, (a, b) in enumerate(some):
            x[r, : len(a)], y[r, : len(b)] = a, b
        for (a, b), c in zip(some, chains.best_alignments(x, y), strict=True):
            want = chains.align(a, b)
            assert all((getattr(c, v) == getattr(want, v)).all() for v in ("a", "b", "same", "equal"))


def test_a_hot_seeds_places_are_connected_by_few_alignments(monkeypatch):
    """Places of a repeated word that share no passage aren't aligned; those that do are connected, as all pairs say."""
    rng = np.random.default_rng(23)
    tables = []
    one, many = chains._align_table, getattr(chains, "best_alignments", None)
    monkeypatch.setattr(chains, "_align_table", lambda a, b: tables.append(1) or one(a, b))
    if many:
        monkeypatch.setattr(chains, "best_alignments", lambda x, y: tables.extend([1] * len(x)) or many(x, y))
    hot, passage = np.full(28, 7, np.uint64), rng.integers(100, 1 << 60, 60).astype(np.uint64)
    texts = []
    for i in range(60):
        own, usual = rng.integers(1000, 1 << 60, 4).astype(np.uint64), rng.integers(8, 30, 6).astype(np.uint64)
        around = [np.repeat(np.append(usual[:3], own[:2]), 14), np.repeat(np.append(own[2:], usual[3:]), 14)]
        if i % 12 == 0:
            around[1] = np.concatenate([np.delete(passage, i % 50 + 1), around[1]])
        texts.append(np.concatenate([around[0], hot, around[1]])[:200])
    rows = {"seed": np.ones(60, int), "low": np.zeros(60, int), "high": np.zeros(60, int), "block": np.zeros(60, np.int32), "part": np.arange(60), "doc_id": np.arange(60)[::-1].copy()}
    rows |= {"start": np.full(60, 70, np.int32), "end": np.full(60, 88, np.int32), "words": [t.tobytes() for t in texts]}
    batch = pa.record_batch(rows)
    found = [r for b in chains._compared(10, 50, 0.7, 98)(iter([batch.slice(0, 25), batch.slice(25)])) for r in b.to_pylist()]
    few, forest, plain = len(tables), graph.Forest(), graph.Forest()
    for r in found:
        assert min(r["end"] - r["start"], r["anchor_end"] - r["anchor_start"]) >= 50 and r["n_same"] >= 0.7 * r["n_aligned"] and r["doc_id"] > r["anchor"]
        forest.union(r["doc_id"], r["anchor"])
    for i in range(60):
        for j in range(i):
            if any(t[0] < 98 and t[1] > 70 and t[2] < 98 and t[3] > 70 for t in chains.compare(texts[i], texts[j], 0, 50, 0.7)):
                plain.union(59 - i, 59 - j)
    assert [forest.find(i) for i in range(60)] == [plain.find(i) for i in range(60)]
    assert len({forest.find(59 - i) for i in range(0, 60, 12)}) == 1 and few < 150


def test_passage_edges(spark):
    assert passages(spark, []) == {}
    rows = [(None, "a b " * 100), (1, " ".join(f"v{i}" for i in range(200))), (1, " ".join(f"v{i}" for i in range(200)))]
    assert passages(spark, rows) == {}


def best_plain(points, k, cost):
    """The best chain's score by the quadratic program."""
    order = sorted(range(len(points)), key=lambda i: points[i])
    score = {}
    for i in order:
        x, y = points[i]
        score[i] = k + max([0.0, *(score[j] - cost * (x - points[j][0] + y - points[j][1]) for j in score if points[j][0] < x and points[j][1] < y)])
    return max(score.values())


def test_chains_are_optimal():
    rng = random.Random(9)
    for _ in range(100):
        points = list({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 25))})
        found = chains.best_chains([p[0] for p in points], [p[1] for p in points], 10, max_gap=1000)
        assert sorted(i for c in found for i in c) == list(range(len(points)))
        value = lambda c: sum(10 for _ in c) - sum(0.1 * (points[b][0] - points[a][0] + points[b][1] - points[a][1]) for a, b in zip(c, c[1:], strict=False))
        assert all(points[a][0] < points[b][0] and points[a][1] < points[b][1] for c in found for a, b in zip(c, c[1:], strict=False))
        assert abs(max(map(value, found)) - best_plain(points, 10, 0.1)) < 1e-6


def test_minimizers_cover_every_window():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 8, 9, 200):
        g = rng.integers(0, 50, n, dtype=np.uint64)
        at = chains.minimizers(g, 8)
        for s in range(max(0, n - 7)):
            assert ((at >= s) & (at < s + 8)).any()
        assert (n == 0) == (len(at) == 0)
