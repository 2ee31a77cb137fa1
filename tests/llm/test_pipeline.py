import re
from collections import defaultdict

from conftest import SF
from pyspark.sql import functions as F
from test_joins import WORD, brute, lower
from test_texts import brute_lines, fill

import corpus_pipeline
from packwright.llm.queries import MIX_WEIGHTS, oracle_sql, queries


def words(t):
    return re.findall(WORD, lower(t))


def leaked(text, items):
    """Whether a whole benchmark item stands in the text, word for word."""
    w = words(text)
    return any(w[i : i + len(b)] == b for b in items for i in range(len(w) - len(b) + 1) if w[i] == b[0])


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "source_mixing"]

    known = stages["language_id"](spark, docs, SF)
    assert known.columns == docs.columns
    kept = {i for i, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in known.collect()} == kept

    lines = stages["line_dedup"](spark, known, SF)
    texts = {i: t for (i, _, _, t) in brute_lines([(i, rows[i].text) for i in kept])}
    got = lines.collect()
    assert lines.columns == docs.columns and {r.doc_id: (r.text, r.n_chars, r.lang, r.source) for r in got} == {i: (t, len(t), rows[i].lang, rows[i].source) for i, t in texts.items()}

    groups = brute(list(texts.items()), 5, 8, 10)
    single = stages["ngram_jaccard"](spark, lines, SF)
    want = {i for i in texts if groups[i][1] == i}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == want

    clean = stages["decontamination"](spark, single, SF)
    want = {i for i in want if not leaked(texts[i], items)}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want

    mixed = stages["source_mixing"](spark, clean, SF).collect()
    assert {r.doc_id for r in mixed} <= want and len({r.doc_id for r in mixed}) == len(mixed)
    room, used, most = defaultdict(float), defaultdict(int), 0
    for i in want:
        room[domain(rows[i].source)] += 2 * len(words(texts[i]))
        most = max(most, len(words(texts[i])))
    for r in mixed:
        assert r.text == texts[r.doc_id] and r.n_tokens == len(words(r.text)) and r.copies in (1, 2)
        used[r.domain] += r.copies * r.n_tokens
    names = sorted(room)
    goal = dict(zip(names, fill(sum(room.values()) / 4, [(MIX_WEIGHTS["domain"][d], room[d]) for d in names]), strict=True))
    # A leaf falls short of its budget by less than one document.
    assert all(goal[d] - 80 * most <= used[d] <= goal[d] + 1 for d in names)

    whole = {r.doc_id: r.copies for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {r.doc_id: r.copies for r in mixed}


def domain(source):
    return ("web", "books", "code")[int(re.search(r"(\d+)$", source)[1]) % 3]


def test_every_query_is_registered():
    assert sorted(re.match(r"op(\d+)_", n)[1] for n in queries() if n.startswith("op")) == sorted(map(str, range(1, 11))) and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_clashing_names_and_odd_rows(spark):
    names = ["_gone", "_leaked_id", "score", "lang_pred", "component_id", "_drops", "_c0", "a.b", "name"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(None, "some words in a text", None, None, None), (5, None, "en", "s1", 0), (5, "", "en", "s1", 0), (6, "twice here", "en", "s1", 3), (6, "twice here", "en", "s1", 3)], docs.schema)
    docs = docs.unionByName(odd)
    for c in names:
        docs = docs.withColumn(c, F.lit("kept"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        got, want = stage(spark, docs, SF), stage(spark, plain, SF)
        assert got.columns[: len(docs.columns)] == docs.columns
        assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, want.select(plain.columns).collect())), name
        assert {tuple(r) for r in got.select(*[f"`{c}`" for c in names]).collect()} <= {("kept",) * len(names)}
