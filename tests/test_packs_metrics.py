import json
import math
import time

import pytest
from pyspark.sql import functions as F
from test_samples import line, write
from test_selectors import FUNCTIONS, index_of

from packwright.operators import metrics, represent
from packwright.plans import cell, grid
from packwright.sources import pairs, sinks
from packwright.streaming import ledger as stream


def one(spark, column, **values):
    return spark.range(1).select(column).first()[0]


def test_snippet(spark):
    source = F.lit("a\nb \nc\nd\ne\n")
    got = one(spark, represent.snippet(source, F.lit(10), F.array(F.lit(2), F.lit(99))))
    assert got == "    10| a\n      ...\n    12| c\n      ...\n    14| e"
    assert one(spark, represent.snippet(F.lit(" a\nb\n"), F.lit(1), F.array().cast("array<int>"))) == "a\nb"


def test_raw_pack(spark):
    e = F.array(F.struct(F.lit("f.c").alias("file"), F.lit("g").alias("name"), F.lit(3).alias("line"), F.lit(" body ").alias("source")))
    got = one(spark, represent.render_raw(F.lit(" t "), e))
    assert got == "=== TARGET FUNCTION ===\nt\n\n=== CONTEXT (selected functions, raw source) ===\n[EVIDENCE E1]\nfile: f.c\nfunction: g\nline: 3\n\nbody\n[/EVIDENCE]"
    assert one(spark, represent.render_raw(F.lit("t"), F.slice(e, 1, 0))) == "=== TARGET FUNCTION ===\nt"


def ledger_rows(spark, rows):
    """(pair, label, prediction, failure) to ledger rows."""
    df = spark.createDataFrame(rows, "pair_id long, label int, prediction int, n_backend_failures int")
    for c in ("pack_tokens", "n_evidence_tokens", "n_candidates_pool", "n_candidates_selected", "index_time_s", "build_time_cold_ms", "build_time_warm_ms"):
        df = df.withColumn(c, F.col("pair_id").cast("double"))
    return df


def test_outcomes(spark):
    rows = [(p, y, v, 0) for p, (a, b) in enumerate([(1, 0), (1, 1), (0, 0), (0, 1), (1, -1)]) for y, v in ((1, a), (0, b))] + [(9, 1, 1, 0), (10, 1, 1, 1), (10, 0, 0, 0)]
    df = ledger_rows(spark, rows)
    assert {r.pair_id: r.outcome for r in metrics.pair_outcomes(df).collect()} == {0: "P-C", 1: "P-V", 2: "P-B", 3: "P-R", 4: "dropped"}
    m = metrics.cell_metrics(df).first().asDict()
    assert (m["n_samples"], m["n_samples_excluding_backend_failures"], m["n_pairs"], m["n_pairs_dropped_unparsable"], m["pAcc"]) == (13, 12, 4, 1, 0.25)
    assert m["unparsable_rate"] == pytest.approx(1 / 12) and m["n_backend_failures_rate"] == pytest.approx(1 / 13) and len(m) == 25


def test_edges(spark):
    empty = metrics.cell_metrics(ledger_rows(spark, []).limit(0)).first().asDict()
    assert empty["n_samples"] == 0 and empty["n_pairs"] == 0 and all(math.isnan(empty[k]) for k in ("pAcc", "MCC", "F1", "accuracy", "mean_pack_tokens", "median_index_time_s"))
    same = metrics.cell_metrics(ledger_rows(spark, [(1, 1, 1, 0), (2, 1, 1, 0)])).first()
    assert (same.MCC, same.F1, same.balanced_accuracy, same.F1_trivial) == (0.0, 1.0, 1.0, 1.0)
    none = metrics.cell_metrics(ledger_rows(spark, [(1, 0, 0, 0)])).first()
    assert (none.F1, none.precision, none.recall, none.balanced_accuracy) == (0.0, 0.0, 0.0, 1.0)
    half = metrics.cell_metrics(ledger_rows(spark, [(1, 1, 1, 0), (1, 0, 1, 0)])).first()
    assert half.F1_trivial == pytest.approx(2 / 3)
    medians = metrics.cell_metrics(ledger_rows(spark, [(p, 1, 1, 0) for p in (1, 2, 10, 4)])).first()
    assert medians.median_index_time_s == 3.0


def config(tmp_path, **more):
    rows = [line(i, project="w", vulnerable_commit_id="c", vulnerability_fixing_commit_id="gone", vulnerable_function_body=FUNCTIONS[0][4]) for i in range(4)]
    data = write(tmp_path / "pairs.jsonl", rows)
    return cell.CellConfig(data=data, out_dir=str(tmp_path / "out"), budget=25, **more)


def index_for(spark):
    return index_of(spark, [("w-c", *f[1:]) for f in FUNCTIONS if f[0] == "w"])


@pytest.mark.parametrize("selector", ["C0", "C1", "C2", "S1", "S4"])
@pytest.mark.parametrize("representation", ["R0", "R1"])
def test_run_cell(spark, tmp_path, selector, representation):
    cfg = config(tmp_path, selector=selector, representation=representation)
    path, found = cell.run_cell(spark, cfg, ask=lambda pack: "VULNERABLE" if "TARGET" in pack else "SAFE", index=index_for(spark))
    rows = [json.loads(x) for x in open(path)]
    assert len(rows) == 8 and list(rows[0]) == [n for n, _ in pairs.LEDGER_FIELDS]
    assert [r["sample_id"] for r in rows][:2] == ["0-vuln", "0-benign"]
    assert all(r["n_evidence_tokens"] <= 25 for r in rows)
    failed = 0 if selector == "C0" else 4
    assert sum(r["n_backend_failures"] for r in rows) == failed and found["n_samples"] == 8
    assert selector == "C0" or {r["n_candidates_pool"] for r in rows if not r["n_backend_failures"]} == {5}


def test_phase_skips_what_is_done(spark, tmp_path):
    cfg = config(tmp_path, no_llm=True)
    first = grid.run_phase(spark, cfg, chosen=("C0", "S1"), subsample=2, index=index_for(spark))
    assert [c for c, _ in first] == ["C0_R0_b25_ts", "S1_R0_b25_ts"] and first[0][1]["unparsable_rate"] == 1.0
    assert grid.run_phase(spark, cfg, chosen=("C0", "S1"), subsample=2, index=index_for(spark)) == []
    text = grid.show_metrics(cfg.out_dir)
    assert "S1_R0_b25_ts" in text and "pAcc" in text
    time.sleep(1)
    cell.run_cell(spark, cell.CellConfig(**{**vars(cfg), "selector": "C0", "limit": 3}))
    cells = {r.cell: r.n_samples for r in grid.load_cells(spark, cfg.out_dir).collect()}
    assert cells == {"C0_R0_b25_ts": 3, "S1_R0_b25_ts": 4}


def test_freeze_only_and_errors(spark, tmp_path):
    frozen = str(tmp_path / "set.json")
    cfg = config(tmp_path, subsample=1, freeze_samples=frozen, freeze_only=True)
    assert cell.run_cell(spark, cfg) is None and len(sinks.load_frozen(frozen)["sample_ids"]) == 2
    with pytest.raises(ValueError):
        cell.set_backend("nope")
    with pytest.raises(ModuleNotFoundError):
        cell.set_backend("joern")
    with pytest.raises(SystemExit):
        cell.main(["--freeze-only"])


def test_report_with_missing_keys():
    text = sinks.report([("c", {"pAcc": 0.5, "n_pairs": 3})], sinks.DETECTION_COLUMNS, "t")
    assert "0.500" in text and "3" in text


def test_sources_from_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.c").write_text("int f(void) { return g(); }\nint g(void) { return 1; }\n")
    (tmp_path / "src" / "b.txt").write_text("int no(void) { }")
    files = pairs.scan_sources(spark, str(tmp_path), "w")
    got = pairs.scan_functions(files).orderBy("ord").collect()
    assert [(r.name, r.file, r.line) for r in got] == [("f", "src/a.c", 1), ("g", "src/a.c", 2)] and got[0].calls[0].name == "g"


def test_ledger_append_and_stream(spark, tmp_path):
    cfg = config(tmp_path, no_llm=True)
    path, _ = cell.run_cell(spark, cfg)
    rows = pairs.scan_results(spark, path)
    sinks.append_ledger(rows, str(tmp_path / "ledger"))
    sinks.append_ledger(rows, str(tmp_path / "ledger"))
    assert pairs.scan_results(spark, str(tmp_path / "ledger")).count() == 16
    query = stream.watch(spark, cfg.out_dir, "progress_table", str(tmp_path / "cp"), once=True)
    query.awaitTermination()
    assert spark.table("progress_table").first().n_unreadable == 8


def test_every_sample_is_asked_once_and_a_broken_cell_goes_on(spark, tmp_path):
    rows = [line(i, project="w", vulnerable_commit_id="c", vulnerability_fixing_commit_id="c", vulnerable_function_body=f"int t{i}(void) {{ return {i}; }}") for i in range(20)]
    cfg = cell.CellConfig(data=write(tmp_path / "pairs.jsonl", rows), out_dir=str(tmp_path / "out"), ask_batch=7)
    asked, broken = str(tmp_path / "asked"), str(tmp_path / "broken")
    open(broken, "w").close()

    def ask(pack):
        import os

        with open(asked, "a") as out:
            out.write("x")
        if os.path.exists(broken) and os.path.getsize(asked) > 20:
            raise RuntimeError("the endpoint is gone")
        return "SAFE"

    with pytest.raises(Exception, match="endpoint"):
        cell.run_cell(spark, cfg, ask=ask)
    assert not list((tmp_path / "out").glob("results_*"))
    kept = sum(1 for f in (tmp_path / "out").glob("asked_*/*.json") for _ in open(f))
    assert kept == 14
    (tmp_path / "broken").unlink()
    before = len(open(asked).read())
    path, found = cell.run_cell(spark, cfg, ask=ask)
    assert len(open(asked).read()) - before == 40 - kept and found["n_samples"] == 40
    assert [json.loads(x)["sample_id"] for x in open(path)] == [f"{i}-{h}" for i in range(20) for h in ("vuln", "benign")]
    assert not list((tmp_path / "out").glob("asked_*"))


def test_checkout_of_a_commit(spark, tmp_path):
    import subprocess

    origin = tmp_path / "origin"
    git = lambda *args: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=origin, check=True, capture_output=True, text=True).stdout.strip()
    origin.mkdir()
    git("init", "-q")
    commits = []
    for body in ("int f(void) { return g(); }", "int h(void) { return 2; }"):
        (origin / "a.c").write_text(body)
        git("add", "."), git("commit", "-qm", "x")
        commits.append(git("rev-parse", "HEAD"))
    for commit, name in zip(commits, "fh", strict=True):
        where = pairs.checkout(str(origin), "p", commit, str(tmp_path / "ws"))
        assert where == str(tmp_path / "ws" / "trees" / f"p-{commit[:12]}") == pairs.checkout("nowhere", "p", commit, str(tmp_path / "ws"))
        found = pairs.scan_functions(pairs.scan_sources(spark, f"file://{where}", "w", where)).collect()
        assert [(r.name, r.file) for r in found] == [(name, "a.c")]
    assert pairs.checkout(str(origin), "p", "0" * 40, str(tmp_path / "ws")) is None
    samples = spark.createDataFrame([("p-" + commits[0][:12], "p", str(origin), commits[0]), ("p-0", "p", str(origin), "0" * 40)], "worktree string, project string, project_url string, commit string")
    index, times = cell.checkout_all(spark, samples, cell.CellConfig(workspace=str(tmp_path / "ws")))
    assert [r.name for r in index.collect()] == ["f"] and times.count() == 1 and times.first().index_time_s > 0.01
