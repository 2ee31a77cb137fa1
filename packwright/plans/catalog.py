"""The queries over the driver's tables, with the SQL each is checked against.

Each operator is generic; here it runs on tables in the roles of its inputs: documents
as the candidate pool, benchmark as targets, events as a paired verdict ledger, an edge
table from lineitem as the call graph of orders, C sources made from part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packwright.functions import text as X
from packwright.operators import bm25, budget, metrics, pool, represent, selectors
from packwright.operators import samples as S
from packwright.session import scratch, table
from packwright.sources import pairs, sinks

BUDGET = 2000
DRAW = 100

# ---- the tables in their roles ------------------------------------------------------


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """documents as functions of one worktree."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.lit("w").alias("worktree"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"),
        F.col("source").alias("file"),
        F.col("doc_id").cast("int").alias("line"),
        F.col("text").alias("source"),
        F.col("doc_id").alias("ord"),
        X.count_tokens(F.col("text")).alias("tokens"),
    )


def targets(spark: SparkSession, d: str) -> DataFrame:
    """benchmark as samples that aren't in the pool themselves."""
    items = table(spark, d, "benchmark")
    return items.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("sample_id"),
        F.lit("w").alias("worktree"),
        F.lit(None).cast("string").alias("target_name"),
        F.col("text").alias("query"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("file_name"),
        (F.col("item_id") * 25).cast("int").alias("target_line"),
        F.col("item_id"),
    )


def event_ledger(spark: SparkSession, d: str) -> DataFrame:
    """events as a ledger: two halves a pair, every verdict, failures and costs."""
    e = table(spark, d, "events")
    verdict = F.when(F.col("event_type") == "error", -1).when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0)
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("sample_id"),
        F.expr("event_id div 2").alias("pair_id"),
        (F.col("event_id") % 2).cast("int").alias("label"),
        verdict.alias("prediction"),
        (F.col("user_id") % 25 == 0).cast("int").alias("n_backend_failures"),
        (F.col("user_id") % 3).cast("int").alias("cell"),
        F.floor("value").cast("long").alias("pack_tokens"),
        F.floor(F.col("value") / 2).cast("long").alias("n_evidence_tokens"),
        (F.col("event_id") % 97).alias("n_candidates_pool"),
        (F.col("event_id") % 13).alias("n_candidates_selected"),
        (F.col("event_id") % 1009).cast("double").alias("index_time_s"),
        (F.col("event_id") % 503).cast("double").alias("build_time_cold_ms"),
        (F.col("event_id") % 251).cast("double").alias("build_time_warm_ms"),
    )


SQL_LEDGER = """
    SELECT 'e' || event_id AS sample_id, event_id // 2 AS pair_id, CAST(event_id % 2 AS INT) AS label,
           CASE WHEN event_type = 'error' THEN -1 WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS prediction,
           CAST(user_id % 25 = 0 AS INT) AS n_backend_failures, CAST(user_id % 3 AS INT) AS cell,
           CAST(floor(value) AS BIGINT) AS pack_tokens, CAST(floor(value / 2) AS BIGINT) AS n_evidence_tokens,
           event_id % 97 AS n_candidates_pool, event_id % 13 AS n_candidates_selected,
           CAST(event_id % 1009 AS DOUBLE) AS index_time_s, CAST(event_id % 503 AS DOUBLE) AS build_time_cold_ms,
           CAST(event_id % 251 AS DOUBLE) AS build_time_warm_ms
    FROM events"""


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders that follow each other in holding a part, as calls within one worktree."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    following = F.lead("l_orderkey").over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))
    pairs_ = items.select(F.col("l_orderkey").alias("a"), following.alias("b")).where("b is not null and a <> b").distinct()
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    return pairs_.select(F.lit("w").alias("worktree"), name("a").alias("caller"), name("b").alias("callee"))


SQL_EDGES = """
    edges AS (
        SELECT DISTINCT 'o' || a AS caller, 'o' || b AS callee FROM (
            SELECT l_orderkey AS a, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS b FROM lineitem)
        WHERE b IS NOT NULL AND a <> b)"""


def graph_targets(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a sample whose target is its function."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select(key.alias("sample_id"), F.lit("w").alias("worktree"), F.concat(F.lit("o"), key).alias("target_name"))


def c_sources(spark: SparkSession, d: str) -> DataFrame:
    """A small C file a part; its calls and conditions are known by construction."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    body = F.concat(
        F.lit("static int\nfn_"), k, F.lit("(int a)\n{\n    int r = init_"), n, F.lit("(a);\n    if (a > "), n, F.lit(") {\n        hit_"), k,
        F.lit("(a);\n    } else {\n        miss(r);\n    }\n    r = r + 1;\n    while (a--)\n        step(a);\n    return done(r);\n}\n"),
    )
    return table(spark, d, "part").select(F.lit("w").alias("worktree"), F.concat(F.lit("f"), k, F.lit(".c")).alias("file"), body.alias("content"))


# ---- queries ------------------------------------------------------------------------


def clean_body(spark, d):
    docs = table(spark, d, "documents")
    body = F.concat(F.when(F.col("doc_id") % 3 == 0, "cpp\n").when(F.col("doc_id") % 3 == 1, " c\n").otherwise(""), "text", F.lit(" \n"))
    return docs.select("doc_id", F.md5(F.encode(X.clean_body(body), "UTF-8")).alias("body_md5"))


def guess_name(spark, d):
    header = F.concat(F.lit("static "), "p_name", F.lit(" f_"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 4 == 0, " {").otherwise(" (int a) {"), F.lit("bar(); }"))
    return table(spark, d, "part").select("p_partkey", X.guess_function_name(header).alias("name"))


def count_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("tokens"))


def verdict_parse(spark, d):
    reply = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  vulnerable "), "text")).when(F.col("doc_id") % 4 == 1, F.lit("SAFE.")).otherwise(F.col("text"))
    verdict = X.extract_verdict(reply)
    mark = X.correctness_mark(verdict, (F.col("doc_id") % 2).cast("int"))
    return table(spark, d, "documents").select("doc_id", verdict.alias("prediction"), X.verdict_label(verdict).alias("label"), mark.alias("mark"))


def cell_ids(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.cell_id(F.lit("S1"), F.lit("R0"), F.col("p_size") * 100, F.lit("ts")).alias("cell"), X.relative_path(F.concat(F.lit("/w/src/"), "p_name"), F.lit("/w")).alias("path"))


def dedup_first(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 500).alias("idx"), F.col("doc_id").alias("ord"), F.md5(F.encode("text", "UTF-8")).alias("body_md5"))
    return S.first_by(docs, ["idx"], ["ord"])


def _documents_as_pairs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("ord"), F.col("doc_id").alias("idx"), F.concat(F.lit("CVE-"), F.col("doc_id").cast("string")).alias("cve"), F.array("lang").alias("cwe"), F.col("source").alias("project"),
        F.lit("u").alias("project_url"), F.col("lang").alias("file_name"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("vulnerable_commit_id"),
        F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("vulnerability_introducing_commit_id"), F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("vulnerability_fixing_commit_id"),
        F.concat(F.lit("c\n"), "text").alias("vulnerable_function_body"), F.col("text").alias("non_vulnerable_function_body"),
    )


def pair_explode(spark, d):
    out = S.explode_pairs(_documents_as_pairs(spark, d))
    return out.select("sample_id", "pair_id", "half", "label", "commit", "worktree", F.md5(F.encode("func_body", "UTF-8")).alias("body_md5"))


def pair_explode_introducing(spark, d):
    return S.explode_pairs(_documents_as_pairs(spark, d), "vul-intro").select("sample_id", "commit", "label")


def pair_scan(spark, d):
    """Pair lines written and scanned: each pair's place, fields and bodies."""
    rows, path = _documents_as_pairs(spark, d), scratch(spark, "pairs")
    line = F.to_json(F.struct(*[F.col(c) for c, _ in pairs.PAIR_FIELDS]), {"ignoreNullFields": "false"})
    rows.repartitionByRange("idx").sortWithinPartitions("idx").select(line.alias("value")).write.text(path)
    scanned = pairs.scan_pairs(spark, path, introducing=True)
    md5 = lambda c: F.md5(F.encode(c, "UTF-8"))
    place = F.row_number().over(Window.partitionBy("project").orderBy("ord"))
    return scanned.select("idx", "cve", F.element_at("cwe", 1).alias("cwe"), "project", "vulnerability_introducing_commit_id", place.alias("place"),
                          md5("vulnerable_function_body").alias("vulnerable_md5"), md5("non_vulnerable_function_body").alias("fixed_md5"))


def sample_set_id(spark, d):
    items = table(spark, d, "benchmark").withColumn("bucket", F.col("item_id") % 4)
    return items.groupBy("bucket").agg(X.sample_set_id(F.concat(F.col("item_id").cast("string"), F.lit("-vuln"))).alias("set_id"))


def strat_draw_md5(spark, d):
    out = S.hashed_draw(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id", ["source", "lang"], DRAW)
    return out.select("doc_id", "source", "lang", "round")


def strat_draw_mt(spark, d):
    samples = S.explode_pairs(_documents_as_pairs(spark, d))
    return S.stratified_draw(samples, DRAW, seed=0).select("sample_id", "pair_id", "project", "pos")


def frozen_apply(spark, d):
    samples = S.explode_pairs(_documents_as_pairs(spark, d))
    ids = [f"{k}-{h}" for k in (7, 3, 7, 150, 42) for h in ("benign", "vuln")]
    return S.apply_frozen(samples, ids).select("pos", "sample_id", "label", "commit")


def limit_samples(spark, d):
    samples = S.explode_pairs(_documents_as_pairs(spark, d))
    return S.limit_samples(samples, 25).select("sample_id", "label")


def dataset_hash(spark, d):
    """The content hash of each document's bytes."""
    return table(spark, d, "documents").select("doc_id", pairs.content_hash(F.encode("text", "UTF-8")).alias("hash"))


def pool_exclude_target(spark, d):
    c = candidates(spark, d).withColumn("worktree", F.col("file"))
    t = c.select(F.col("name").alias("sample_id"), "worktree", F.concat(F.lit("int "), "name", F.lit("(void) {}")).alias("func_body"), F.col("file").alias("file_name"))
    return pool.build_pool(t, c).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.min("ord").alias("first"))


def symbol_index(spark, d):
    f = candidates(spark, d).withColumn("name", F.concat(F.lit("s"), (F.col("line") % 300).cast("string")))
    return pool.symbol_index(f).select("name", "file", "line", "ord")


def _same_file(spark, d):
    rows = candidates(spark, d).join(targets(spark, d).select("sample_id", "file_name", "target_line"), F.col("file") == F.col("file_name"))
    return selectors.rank_by_distance(rows, "sample_id")


def same_file_rank(spark, d):
    return _same_file(spark, d).select("sample_id", "name", "rank")


def same_file_fill(spark, d):
    return budget.greedy_fill(_same_file(spark, d), BUDGET).select("sample_id", "pos", "name", "tokens", "used")


def random_perm(spark, d):
    """The random selector over every sample's whole pool: where each candidate comes."""
    t = targets(spark, d).select("sample_id", "worktree", F.col("query").alias("func_body"), "file_name")
    return selectors.random_order(t, candidates(spark, d)).select("sample_id", "name", "rank")


def code_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(F.array_join(X.code_tokens(F.col("text")), " "), "UTF-8")).alias("tokens_md5"), F.size(X.code_tokens(F.col("text"))).cast("long").alias("n"))


def bm25_stats(spark, d):
    c = candidates(spark, d)
    return bm25.postings(c, ["worktree", "name"]).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def bm25_scores(spark, d):
    out = bm25.bm25_scores(targets(spark, d), candidates(spark, d))
    return out.select("sample_id", "name", F.round("score", bm25.SCORE_DECIMALS).alias("score"))


def _bm25_ranked(spark, d):
    t, c = targets(spark, d), candidates(spark, d)
    rows = t.select("sample_id", "worktree").join(c.select("worktree", "name", "ord", "tokens"), "worktree")
    return bm25.bm25_rank(t, c, rows)


def bm25_topk(spark, d):
    return _bm25_ranked(spark, d).where("rank <= 20").select("sample_id", "name", "rank")


def bm25_fill(spark, d):
    return budget.greedy_fill(_bm25_ranked(spark, d), BUDGET).select("sample_id", "pos", "name", "tokens", "used")


def greedy_fill(spark, d):
    rows = candidates(spark, d).select(F.col("file").alias("sample_id"), "name", "tokens", F.row_number().over(Window.partitionBy("file").orderBy("line")).alias("rank"))
    return budget.greedy_fill(rows, BUDGET).select("sample_id", "pos", "name", "tokens", "used")


def callees(spark, d):
    return selectors.callees_of(graph_targets(spark, d), call_edges(spark, d))


def callers(spark, d):
    return selectors.callers_of(graph_targets(spark, d), call_edges(spark, d))


def callgraph_2hop(spark, d):
    t, e = graph_targets(spark, d), call_edges(spark, d)
    return selectors.neighbourhood(t, e)


def _evidence(spark, d):
    kept = budget.greedy_fill(_same_file(spark, d), BUDGET, carry=("worktree", "name", "file", "line"))
    index = candidates(spark, d).withColumn("keep_lines", F.array(F.lit(1)))
    return targets(spark, d).join(represent.gather_evidence(kept, index), "sample_id", "left")


def pack_r0(spark, d):
    pack = represent.render_raw(F.col("query"), F.coalesce("evidence", F.array().cast("array<struct<pos:int,file:string,name:string,line:int,source:string,keep_lines:array<int>,tokens:bigint>>")))
    return _evidence(spark, d).select("sample_id", F.md5(F.encode(pack, "UTF-8")).alias("pack_md5"), F.length(pack).cast("long").alias("n_chars"))


def pack_r1_lines(spark, d):
    rows = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(F.contains(x, F.lit("the ")), i)), lambda i: i.isNotNull())
    out = represent.snippet(F.col("text"), (F.col("doc_id") % 1000 + 1).cast("int"), rows)
    return table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", F.md5(F.encode(out, "UTF-8")).alias("snippet_md5"))


def ledger_fields(spark, d):
    kept = budget.greedy_fill(_same_file(spark, d), BUDGET)
    chosen = kept.groupBy("sample_id").agg(F.sum("tokens").alias("n_evidence_tokens"), F.count("*").alias("n_candidates_selected"))
    sizes = _same_file(spark, d).groupBy("sample_id").agg(F.count("*").alias("n_candidates_pool"))
    out = targets(spark, d).join(sizes, "sample_id", "left").join(chosen, "sample_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("sample_id", X.count_tokens(F.col("query")).cast("long").alias("target_tokens"), zero("n_candidates_pool"), zero("n_candidates_selected"), zero("n_evidence_tokens"))


def ledger_rows(spark, d):
    """A whole cell without a model: the same-file selector, raw packs, their ledger written and read."""
    from packwright.plans import cell

    index = pool.with_tokens(pool.symbol_index(candidates(spark, d).withColumn("kind", F.lit("function")))).withColumn("keep_lines", F.array(F.lit(1)))
    key = F.col("item_id").cast("string")
    constants = {"cve": F.lit("CVE"), "cwe": F.array(F.lit("CWE")), "project": F.lit("p"), "commit": F.lit("c"), "label": (F.col("item_id") % 2).cast("int")}
    body = F.concat(F.lit("int d"), (F.col("item_id") * 25).cast("string"), F.lit("(int a) { "), "text", F.lit(" }\n"))
    samples = table(spark, d, "benchmark").select(
        F.concat(F.lit("b"), key).alias("sample_id"), F.col("item_id").alias("pair_id"), F.lit("w").alias("worktree"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("file_name"), body.alias("func_body"), *[v.alias(k) for k, v in constants.items()],
    )
    cfg = cell.CellConfig(selector="C1", representation="R0", budget=BUDGET)
    told = cell.predict(cell.build_packs(samples, index, cfg), None)
    path = scratch(spark, "ledger")
    sinks.append_ledger(cell.ledger(told, cfg, "run", "set"), path)
    out = pairs.scan_results(spark, path)
    return out.select("sample_id", "pair_id", "label", "selector", "representation", "encoding", "budget", "backend", "prediction", "target_tokens", "prompt_tokens_total", "pack_tokens",
                      "n_evidence_tokens", "n_candidates_pool", "n_candidates_selected", "n_backend_failures")


def target_line(spark, d):
    """The line of the symbol that each sample's function is named like."""
    f = candidates(spark, d).withColumn("name", F.concat(F.lit("s"), (F.col("line") % 300).cast("string"))).withColumn("line", F.col("line") % 50)
    body = F.concat(F.lit("static int s"), (F.col("doc_id") % 400).cast("string"), F.lit(" (int a) { return f(a); }"))
    samples = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.lit("w").alias("worktree"), body.alias("func_body"))
    return pool.target_lines(samples, pool.symbol_index(f)).select("sample_id", F.col("target_line").cast("string").alias("target_line"))


def function_facts(spark, d):
    """What a sample's function calls: by name from the index, else read off its own text."""
    files = c_sources(spark, d).where(F.regexp_extract("file", r"(\d+)", 1).cast("long") % 2 == 0)
    k = F.col("p_partkey").cast("string")
    body = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("int fn_"), k, F.lit("(a)\n    int a;\n{\n    return own_"), k, F.lit("(a, next());\n}\n")))
    samples = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("sample_id"), F.lit("w").alias("worktree"), body.alias("func_body"))
    parsed = samples.select("sample_id", pairs.parsed_source(F.col("func_body")).alias("parsed"))
    facts = pool.function_facts(samples, pool.symbol_index(pairs.scan_functions(files)), parsed)
    rows = F.array_join(F.col("keep_lines").cast("array<string>"), ",")
    return facts.select("sample_id", "name", F.array_join("calls.name", ",").alias("calls"), rows.alias("rows"), "missed")


def calls_extract(spark, d):
    f = pairs.scan_functions(c_sources(spark, d))
    return f.select("name", "file", "line", F.posexplode("calls").alias("place", "c")).select("name", "file", "line", "place", F.col("c.name").alias("callee"))


def enclosing_conditions(spark, d):
    f = pairs.scan_functions(c_sources(spark, d))
    return f.select("name", F.explode("calls").alias("c")).select("name", F.col("c.name").alias("callee"), F.array_join("c.conditions", " && ").alias("conditions"))


def keep_lines(spark, d):
    f = pairs.scan_functions(c_sources(spark, d))
    return f.select("name", F.array_join(F.col("keep_lines").cast("array<string>"), ",").alias("rows"), F.array_join("identifiers", ",").alias("identifiers"))


def pairwise_outcomes(spark, d):
    return metrics.pair_outcomes(event_ledger(spark, d))


_CELL_METRICS = ["pAcc", "MCC", "F1", "F1_trivial", "precision", "recall", "balanced_accuracy", "accuracy", "unparsable_rate"]


def cell_metrics(spark, d):
    out = metrics.cell_metrics(event_ledger(spark, d), ["cell"])
    kinds = [F.col(f"`{k}`").alias(k.replace("-", "_")) for k in ("P-C", "P-V", "P-B", "P-R")]
    return out.select("cell", "n_samples", "n_samples_excluding_backend_failures", "n_pairs", "n_pairs_dropped_unparsable", *kinds, *[F.round(c, 9).alias(c) for c in _CELL_METRICS])


def f1_trivial(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("pair_id"), F.col("quality").alias("label"), F.col("toxic").alias("prediction"), F.lit(0).alias("n_backend_failures"))
    for c in ("pack_tokens", "n_evidence_tokens", "n_candidates_pool", "n_candidates_selected", "index_time_s", "build_time_cold_ms", "build_time_warm_ms"):
        rows = rows.withColumn(c, F.lit(0.0))
    return metrics.cell_metrics(rows).select("n_samples", F.round("F1", 9).alias("f1"), F.round("F1_trivial", 9).alias("f1_trivial"))


def cost_medians(spark, d):
    out = metrics.cell_metrics(event_ledger(spark, d), ["cell"])
    means = ["mean_pack_tokens", "mean_evidence_tokens", "mean_candidates_pool", "mean_candidates_selected", "n_backend_failures_rate"]
    return out.select("cell", *[F.round(c, 6).alias(c) for c in means], "median_index_time_s", "median_build_cold_ms", "median_build_warm_ms")


def latest_cell(spark, d):
    """The rows of each cell's last file, with orders as files and customers as cells."""
    rows = table(spark, d, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("_path"), F.col("o_orderkey").alias("_at"), F.col("o_custkey").cast("string").alias("selector"), F.lit("R0").alias("representation"),
        F.lit(None).cast("int").alias("budget"), F.lit(None).cast("string").alias("backend"), "o_orderstatus",
    )
    return pairs.latest_cells(rows).select("cell", F.col("_at").alias("path"), "o_orderstatus")


def miss_counts(spark, d):
    facts = table(spark, d, "lineitem").select(F.when(F.col("l_partkey") % 7 > 0, F.concat(F.lit("p"), (F.col("l_partkey") % 100).cast("string"))).alias("name"), (F.col("l_linenumber") > 2).alias("missed"))
    return pool.miss_counts(facts)


def cell_grid(spark, d):
    """Two selectors over the shared pool at one budget: what each keeps."""
    fills = [same_file_fill(spark, d).withColumn("selector", F.lit("C1")), bm25_fill(spark, d).withColumn("selector", F.lit("S1"))]
    both = fills[0].unionByName(fills[1])
    return both.groupBy("selector").agg(F.countDistinct("sample_id").alias("n_samples"), F.count("*").alias("n_selected"), F.sum("tokens").alias("n_tokens"), F.max("used").alias("most_used"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return bm25_fill(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_body, guess_name, count_tokens, verdict_parse, cell_ids, dedup_first, pair_explode, pair_explode_introducing, pair_scan, sample_set_id, strat_draw_md5, strat_draw_mt,
        frozen_apply, limit_samples, dataset_hash, pool_exclude_target, symbol_index, same_file_rank, same_file_fill, random_perm, code_tokens, bm25_stats, bm25_scores,
        bm25_topk, bm25_fill, greedy_fill, callees, callers, callgraph_2hop, pack_r0, pack_r1_lines, ledger_fields, ledger_rows, target_line, function_facts, calls_extract, enclosing_conditions, keep_lines,
        pairwise_outcomes, cell_metrics, f1_trivial, cost_medians, latest_cell, miss_counts, cell_grid,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from packwright.plans.oracles import SQL

    return dict(SQL)
