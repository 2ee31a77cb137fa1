import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packwright.functions.permute import shuffled
from packwright.operators import bm25, budget, pool, selectors

FUNCTIONS = [
    ("w", "target", "a.c", 50, "int target(int x) { return alpha(x) + betaGamma(x); }"),
    ("w", "alpha", "a.c", 40, "int alpha(int x) { return gamma_delta(x); }"),
    ("w", "caller", "a.c", 60, "int caller(int x) { return target(x); }"),
    ("w", "near", "a.c", 45, "int near(int y) { return 0; }"),
    ("w", "other", "b.c", 3, "int other(int x) { return caller(x) + alpha(x); }"),
    ("w", "common", "b.c", 9, "int common(int x) { return x; }"),
    ("z", "alpha", "a.c", 1, "int alpha(void) { return 1; }"),
]


def index_of(spark, rows=FUNCTIONS):
    from packwright.functions.ccode import parse_detached

    full = []
    for i, (w, name, file, line, source) in enumerate(rows):
        walk = parse_detached(source)
        full.append((w, name, file, line, source, "function", i, [(c.name, c.conditions, "") for c in walk.calls], sorted(walk.identifiers), sorted(walk.keep_lines)))
    from packwright.sources.pairs import FUNCTION_SCHEMA

    return pool.with_tokens(pool.symbol_index(spark.createDataFrame(full, FUNCTION_SCHEMA)))


def samples_of(spark):
    return spark.createDataFrame([("1-vuln", "w", "a.c", FUNCTIONS[0][4]), ("2-vuln", "z", "a.c", "no function here"), ("3-vuln", "gone", "a.c", FUNCTIONS[0][4])], "sample_id string, worktree string, file_name string, func_body string")


def ranked(df, sample):
    return [r.name for r in df.where(F.col("sample_id") == sample).orderBy("rank").collect()]


def test_same_file(spark):
    got = selectors.same_file(samples_of(spark), index_of(spark))
    assert ranked(got, "1-vuln") == ["near", "alpha", "caller"] and ranked(got, "2-vuln") == ["alpha"]


def test_random_is_the_seeded_shuffle(spark):
    index = index_of(spark)
    names = [r.name for r in index.where("worktree = 'w' and name <> 'target'").orderBy("ord").collect()]
    order = list(names)
    random.Random("0-1-vuln").shuffle(order)
    assert ranked(selectors.random_order(samples_of(spark), index), "1-vuln") == order
    assert [names[i] for i in shuffled("0-1-vuln", len(names))] == order


def test_call_graph(spark):
    got = selectors.call_graph(samples_of(spark), index_of(spark))
    assert ranked(got, "1-vuln") == ["alpha", "caller", "other"] and ranked(got, "2-vuln") == []


def brute_bm25(docs, query):
    toks = {k: v for k, v in docs.items()}
    n, total = len(toks), sum(map(len, toks.values()))
    df = Counter(t for v in toks.values() for t in set(v))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    avg = total / n
    out = {}
    for k, v in toks.items():
        tf = Counter(v)
        out[k] = sum(idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(v) / avg)) for q in query)
    return out


def test_bm25_without_the_target(spark):
    from packwright.functions import text as X

    index = index_of(spark)
    toks = {(r.worktree, r.name): r.t for r in index.select("worktree", "name", X.code_tokens(F.col("source")).alias("t")).collect()}
    query = toks["w", "target"]
    want = brute_bm25({k[1]: v for k, v in toks.items() if k[0] == "w" and k[1] != "target"}, query)
    q = pool.target_names(samples_of(spark)).select("sample_id", "worktree", "target_name", F.col("func_body").alias("query"))
    got = {r.name: r.score for r in bm25.bm25_scores(q, index).where("sample_id = '1-vuln'").collect()}
    assert set(got) == {k for k, v in want.items() if v} and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    order = sorted(want, key=lambda k: (-round(want[k], 9), k))
    assert ranked(selectors.lexical(samples_of(spark), index), "1-vuln") == order


def fill(items, limit):
    kept, used = [], 0
    for t in items:
        if used + t <= limit:
            kept.append(t)
            used += t
    return kept


def test_fill_literal(spark):
    df = spark.createDataFrame([("s", i, t, f"n{i}") for i, t in enumerate([6, 6, 4, 0])], "sample_id string, rank int, tokens int, name string")
    assert [r.name for r in budget.greedy_fill(df, 10).orderBy("pos").collect()] == ["n0", "n2", "n3"]


def test_fill_is_the_loop(spark):
    cases = []

    @settings(max_examples=30, deadline=None, database=None)
    @given(st.lists(st.integers(0, 12), max_size=12))
    def gather(items):
        cases.append(items)

    gather()
    rows = [(str(c), i, t, "x") for c, items in enumerate(cases) for i, t in enumerate(items)]
    got = {}
    for r in budget.greedy_fill(spark.createDataFrame(rows or [("x", 0, 99, "x")], "sample_id string, rank int, tokens int, name string"), 15).orderBy("pos").collect():
        got.setdefault(r.sample_id, []).append(r.tokens)
    assert all(got.get(str(c), []) == fill(items, 15) for c, items in enumerate(cases))


def direct_walk(target, edges, names):
    reached, front = {}, [target]
    for distance in (1, 2):
        following = []
        for node in front:
            near = [(n, 0) for n in sorted({b for a, b in edges if a == node} & names)] + [(n, 1) for n in sorted({a for a, b in edges if b == node} & names)]
            for n, direction in near:
                if n not in reached and n != target:
                    reached[n] = (distance, direction)
                    following.append(n)
        front = following
    return reached


def test_neighbourhood_is_the_direct_walk(spark):
    rng = random.Random(1)
    edges, targets, want = [], [], {}
    for g in range(12):
        names = [f"n{i}" for i in range(9)]
        own = {(rng.choice(names), rng.choice(names)) for _ in range(14)}
        edges += [(f"w{g}", a, b) for a, b in own]
        targets.append((f"s{g}", f"w{g}", "n0"))
        want[f"s{g}"] = direct_walk("n0", own, set(names))
    got = {}
    e = spark.createDataFrame(edges, "worktree string, caller string, callee string").where("caller <> callee")
    for r in selectors.neighbourhood(spark.createDataFrame(targets, "sample_id string, worktree string, target_name string"), e).collect():
        got.setdefault(r.sample_id, {})[r.name] = (r.distance, r.direction)
    assert all(got.get(s, {}) == w for s, w in want.items())


def test_selectors_do_not_see_the_label(spark):
    assert not {"cve", "cwe", "label"} & set(samples_of(spark).columns)
    for name in selectors.SELECTORS:
        kept = selectors.select(name, samples_of(spark), index_of(spark), 20)
        assert all(r.used <= 20 for r in kept.collect())
