"""One cell: a selector, a representation, a budget and a backend over one sample set."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions import text as X
from packwright.functions.tokens import exact_counter
from packwright.operators import metrics, pool, represent, selectors
from packwright.operators import samples as S
from packwright.sources import pairs, sinks

#: One word first, and a balanced prior stated: true of paired sets only.
SYSTEM_PROMPT = (
    "You judge one C or C++ function, shown as TARGET FUNCTION; a CONTEXT section may follow with other functions of its repository.\n"
    "Half of all targets are sound. Reply VULNERABLE only when you can name a definite flaw in the target itself, else reply SAFE.\n"
    "Your reply is one word, VULNERABLE or SAFE, with nothing in front of it and nothing after it."
)
REQUEST_TIMEOUT_S = 120
MAX_REPLY_TOKENS = 16
BACKENDS = ("ts", "joern")
NO_LLM = "[no-llm]"
EVIDENCE = "array<struct<pos:int,file:string,name:string,line:int,source:string,keep_lines:array<int>,tokens:int>>"


@dataclass
class CellConfig:
    """What identifies a cell and how it is run."""

    selector: str = "C0"
    representation: str = "R0"
    budget: int = 2000
    backend: str = "ts"
    data: str = "data/pairs.jsonl"
    model: str = "google/gemma-3n-e4b-it"
    base_url: str = "http://localhost:11434/v1"
    api_key: str | None = None
    no_llm: bool = False
    seed: int = 0
    limit: int | None = None
    subsample: int | None = None
    sample_set: str | None = None
    freeze_samples: str | None = None
    freeze_only: bool = False
    show_pack: bool = False
    out_dir: str | None = None
    workspace: str = "workspace"
    #: Samples that are asked about between two writes of the ledger.
    ask_batch: int = 256
    #: A vocabulary file to count tokens with; without one words are counted.
    tokenizer: str | None = None

    def counter(self) -> Callable[[Column], Column]:
        return exact_counter(self.tokenizer) if self.tokenizer else X.count_tokens

    def cell_id(self) -> str:
        return f"{self.selector}_{self.representation}_b{self.budget}_{self.backend}"


def set_backend(name: str) -> Callable[[DataFrame], DataFrame]:
    """The function scan of a backend; only the built-in reader is there."""
    if name not in BACKENDS:
        raise ValueError(f"there is no backend {name!r}, only {list(BACKENDS)}")
    if name != "ts":
        raise ModuleNotFoundError(f"the backend {name!r} isn't part of this package")
    return pairs.scan_functions


def resolve_samples(spark: SparkSession, cfg: CellConfig) -> tuple[DataFrame, str]:
    """The cell's samples with their order in ``pos``, and the set's id.

    A frozen set goes before a subsample, that before a limit; 0 means not set.
    """
    if not Path(cfg.data).exists():
        raise SystemExit(f"there is no pair file {cfg.data}; pass its path as data")
    every = S.load_samples(pairs.scan_pairs(spark, cfg.data))
    if cfg.sample_set:
        frozen = sinks.load_frozen(cfg.sample_set, cfg.data)
        return S.apply_frozen(every, frozen["sample_ids"]), frozen["sample_set_id"]
    if cfg.subsample:
        chosen = S.stratified_draw(every, cfg.subsample, cfg.seed)
        ordered = chosen.orderBy("pos", "ord", "half")
    elif cfg.limit:
        ordered = S.limit_samples(every, cfg.limit).orderBy("ord", "half")
    else:
        ordered = every.orderBy("ord", "half")
    # The ids of a sample set are what is frozen: they are meant for the driver.
    ids = [r[0] for r in ordered.select("sample_id").collect()]
    if cfg.freeze_samples:
        sinks.save_frozen(cfg.freeze_samples, ids, cfg.seed, cfg.data)
    places = spark.createDataFrame(list(enumerate(ids)), "pos int, sample_id string")
    last = ordered.drop("pos") if "pos" in ordered.columns else ordered
    return places.join(last, "sample_id"), sinks.frozen_set_id(ids)


def build_packs(samples: DataFrame, index: DataFrame | None, cfg: CellConfig, worktrees: DataFrame | None = None, counter=X.count_tokens) -> DataFrame:
    """samples with pack_text and the ledger's counts.

    worktrees: (worktree, index_time_s) of those that could be checked out. A sample
    without a checkout, or with one that has no symbols, gets a target-only pack and one
    backend failure; a pool that is empty for another reason is none.
    """
    render = represent.REPRESENTATIONS[cfg.representation]
    target = X.strip(F.col("func_body"))
    empty = F.array().cast(EVIDENCE)
    if cfg.selector not in selectors.NEEDS_POOL:
        rows = samples.withColumn("evidence", empty).withColumn("n_candidates_pool", F.lit(0).cast("long"))
        rows = rows.withColumn("n_backend_failures", F.lit(0)).withColumn("index_time_s", F.lit(0.0))
    else:
        kept = selectors.select(cfg.selector, samples, index, cfg.budget)
        evidence = represent.gather_evidence(kept, index)
        sizes = pool.build_pool(samples, index).groupBy("sample_id").agg(F.count("*").alias("n_candidates_pool"))
        symbols = pool.symbol_counts(index)
        rows = samples.join(symbols, "worktree", "left").join(evidence, "sample_id", "left").join(sizes, "sample_id", "left")
        failed = F.coalesce(F.col("n_symbols"), F.lit(0)) == 0
        rows = rows.withColumn("n_backend_failures", failed.cast("int"))
        rows = rows.join(worktrees, "worktree", "left") if worktrees is not None else rows.withColumn("index_time_s", F.lit(0.0))
        rows = rows.withColumn("index_time_s", F.coalesce("index_time_s", F.lit(0.0)))
        rows = rows.withColumn("n_candidates_pool", F.coalesce("n_candidates_pool", F.lit(0).cast("long")))
        rows = rows.withColumn("evidence", F.coalesce(F.col("evidence").cast(EVIDENCE), empty))
    rows = rows.withColumn("pack_text", render(target, F.col("evidence")))
    tokens = F.aggregate("evidence", F.lit(0).cast("long"), lambda a, e: a + e["tokens"].cast("long"))
    return rows.select(
        *[F.col(c) for c in samples.columns],
        "pack_text",
        counter(F.col("pack_text")).cast("long").alias("pack_tokens"),
        tokens.alias("n_evidence_tokens"),
        "n_candidates_pool",
        F.size("evidence").cast("long").alias("n_candidates_selected"),
        "index_time_s",
        "n_backend_failures",
    )


def chat_predictor(model: str, base_url: str, api_key: str | None = None, seed: int | None = None) -> Callable[[str], str]:
    """A function that asks a chat endpoint for a verdict; made once a partition."""

    def make():
        from openai import APIError, OpenAI

        client = OpenAI(base_url=base_url, api_key=api_key or "not-needed", timeout=REQUEST_TIMEOUT_S)
        extra = {} if seed is None else {"seed": seed}

        def ask(pack: str) -> str:
            messages = [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": pack}]
            try:
                reply = client.chat.completions.create(model=model, messages=messages, temperature=0, max_tokens=MAX_REPLY_TOKENS, **extra)
            except APIError as e:
                return f"[api_error] {e}"
            return reply.choices[0].message.content or ""

        return ask

    made: list = []

    def predict(pack: str) -> str:
        if not made:
            made.append(make())
        return made[0](pack)

    return predict


def predict(packs: DataFrame, ask: Callable[[str], str] | None) -> DataFrame:
    """packs with model_output_raw, llm_time_s and prediction.

    Without ``ask`` nothing is called: prediction -1. An API error is unreadable too, and
    no backend failure. Give each partition as many packs as its time allows.
    """
    if ask is None:
        return packs.withColumn("model_output_raw", F.lit(NO_LLM)).withColumn("llm_time_s", F.lit(0.0)).withColumn("prediction", F.lit(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, took = [], []
            for pack in batch.column(batch.schema.get_field_index("pack_text")).to_pylist():
                began = time.time()
                raw.append(ask(pack) or "")
                took.append(time.time() - began)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.string()), pa.array(took, pa.float64())], [*batch.schema.names, "model_output_raw", "llm_time_s"])

    schema = packs.limit(0).withColumn("model_output_raw", F.lit("")).withColumn("llm_time_s", F.lit(0.0)).schema
    out = packs.mapInArrow(run, schema)
    error = F.startswith(F.col("model_output_raw"), F.lit("[api_error]"))
    return out.withColumn("prediction", F.when(error, -1).otherwise(X.extract_verdict(F.col("model_output_raw"))))


def ledger(packs: DataFrame, cfg: CellConfig, run_id: str, set_id: str, cold_ms: float = 0.0, warm_ms: float = 0.0, counter=X.count_tokens) -> DataFrame:
    """The 30 ledger columns. The pack itself isn't kept.

    Build times are the batch's wall clock by sample: a lazy plan has no other.
    """
    constants: dict[str, Column] = {
        "run_id": F.lit(run_id), "sample_set_id": F.lit(set_id), "selector": F.lit(cfg.selector), "representation": F.lit(cfg.representation), "encoding": F.lit("text"),
        "budget": F.lit(cfg.budget), "backend": F.lit(cfg.backend), "seed": F.lit(cfg.seed), "model": F.lit(cfg.model), "base_url": F.lit(cfg.base_url),
        "target_tokens": counter(F.col("func_body")), "prompt_tokens_total": counter(F.lit(SYSTEM_PROMPT)) + F.col("pack_tokens"),
        "build_time_cold_ms": F.lit(cold_ms), "build_time_warm_ms": F.when(F.col("n_backend_failures") > 0, 0.0).otherwise(F.lit(warm_ms)),
    }
    return packs.select(*[constants.get(n, F.col(n)).cast(t).alias(n) for n, t in pairs.LEDGER_FIELDS])


def checkout_all(spark: SparkSession, samples: DataFrame, cfg: CellConfig, scan=None) -> tuple[DataFrame, DataFrame]:
    """(index, worktrees) of the samples' checkouts; git runs on the driver.

    Keyed by worktree, so every sample sees its own commit's symbols. Each worktree's
    index is made and kept before the next one's, which is what its time is measured by.
    """
    scan = scan or set_backend(cfg.backend)
    needed = samples.select("worktree", "project", "project_url", "commit").distinct().orderBy("worktree").collect()
    empty = spark.createDataFrame([], "worktree string, file string, content binary")
    index, done = pool.with_tokens(pool.symbol_index(scan(empty)), cfg.counter()), []
    for w in needed:
        where = pairs.checkout(w["project_url"], w["project"], w["commit"], cfg.workspace)
        if where is not None:
            began = time.time()
            own = pool.symbol_index(scan(pairs.scan_sources(spark, f"file://{where}", w["worktree"], where)))
            own = pool.with_tokens(own, cfg.counter()).persist()
            own.count()
            done.append((w["worktree"], time.time() - began))
            index = index.unionByName(own)
    return index, spark.createDataFrame(done, "worktree string, index_time_s double")


def ask_in_batches(packs: DataFrame, cfg: CellConfig, ask: Callable[[str], str] | None, folder: str, to_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ledger rows of all packs, of which each was asked about once.

    Packs are taken ``cfg.ask_batch`` at a time in their order; a batch's rows are on
    disk before the next one is asked, in a folder that executors see too. Where the folder holds rows of a run that broke
    off, only the packs without one are asked about.
    """
    spark = packs.sparkSession
    every = [r[0] for r in packs.select("sample_id").orderBy("pos").collect()]
    told = set()
    if os.path.isdir(folder):
        told = {r[0] for r in spark.read.schema(pairs.LEDGER_SCHEMA).json(folder).select("sample_id").collect()}
    left = [x for x in every if x not in told]
    tasks = max(1, spark.sparkContext.defaultParallelism)
    for at in range(0, len(left), cfg.ask_batch):
        now = packs.where(F.col("sample_id").isin(left[at : at + cfg.ask_batch]))
        # Dealt out before the call and not sorted after it: a sort would sample, and so ask twice.
        rows = to_rows(predict(now.repartition(min(tasks, cfg.ask_batch), "sample_id"), ask))
        rows.write.mode("append").json(folder, ignoreNullFields=False)
        print(f"{min(at + cfg.ask_batch, len(left))} of {len(left)} samples: " + "".join(MARKS[r[0]] for r in _marks(spark, folder, left[at : at + cfg.ask_batch])), flush=True)
    if not every:
        return spark.createDataFrame([], pairs.LEDGER_SCHEMA)
    order = spark.createDataFrame(list(enumerate(every)), "pos long, sample_id string")
    return spark.read.schema(pairs.LEDGER_SCHEMA).json(folder).join(order, "sample_id").orderBy("pos")


#: How a sample's outcome is shown while a cell runs.
MARKS = {1: "+", 0: "-", -1: "?"}


def _marks(spark: SparkSession, folder: str, ids: list[str]) -> list:
    rows = spark.read.schema(pairs.LEDGER_SCHEMA).json(folder).where(F.col("sample_id").isin(ids))
    right = F.when(F.col("prediction") < 0, -1).otherwise((F.col("prediction") == F.col("label")).cast("int"))
    return rows.select(right.alias("mark")).collect()


def run_cell(spark: SparkSession, cfg: CellConfig, ask: Callable[[str], str] | None = None, index: DataFrame | None = None, worktrees: DataFrame | None = None) -> tuple[str, dict] | None:
    """Run a cell end to end: (results path, metrics); None if it only freezes.

    ``ask`` replaces the chat call; ``index`` and ``worktrees`` replace the checkouts.
    """
    scan = set_backend(cfg.backend)
    if cfg.selector not in selectors.SELECTORS or cfg.representation not in represent.REPRESENTATIONS:
        raise KeyError(f"{cfg.selector} / {cfg.representation}")
    samples, set_id = resolve_samples(spark, cfg)
    if cfg.freeze_only:
        return None
    out_dir = Path(cfg.out_dir or "results")
    run_id = f"{cfg.cell_id()}_{time.strftime('%Y%m%d_%H%M%S')}"
    began = time.time()
    if cfg.selector in selectors.NEEDS_POOL and index is None:
        index, worktrees = checkout_all(spark, samples, cfg, scan)
    warm = time.time()
    packs = build_packs(samples, index, cfg, worktrees, cfg.counter()).cache()
    n = max(1, packs.count())
    now = time.time()
    if cfg.show_pack:
        for r in packs.select("sample_id", "pack_text").orderBy("pos").toLocalIterator():
            print(f"\n----- {r[0]} -----\n{r[1]}")
    ask = None if cfg.no_llm else ask or chat_predictor(cfg.model, cfg.base_url, cfg.api_key, cfg.seed)
    to_rows = lambda rows: ledger(rows, cfg, run_id, set_id, (now - began) * 1000 / n, (now - warm) * 1000 / n, cfg.counter())
    same = hashlib.sha256(json.dumps([set_id, cfg.model, cfg.base_url, cfg.seed, cfg.no_llm, cfg.tokenizer]).encode()).hexdigest()[:12]
    folder = str((out_dir / f"asked_{cfg.cell_id()}_{same}").resolve())
    path = str(out_dir / f"results_{run_id}.jsonl")
    sinks.write_results_file(ask_in_batches(packs, cfg, ask, folder, to_rows), path)
    shutil.rmtree(folder, ignore_errors=True)
    packs.unpersist()
    found = metrics.cell_metrics(pairs.scan_results(spark, path)).first().asDict()
    sinks.write_metrics(found, str(out_dir / f"metrics_{run_id}.json"))
    return path, found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m packwright.plans.cell", description="Run one cell.")
    p.add_argument("--selector", choices=list(selectors.SELECTORS), default="C0")
    p.add_argument("--representation", choices=list(represent.REPRESENTATIONS), default="R0")
    p.add_argument("--backend", choices=sorted(BACKENDS), default="ts")
    p.add_argument("--budget", type=int, default=2000)
    p.add_argument("--data", default=CellConfig.data)
    p.add_argument("--model", default=CellConfig.model)
    p.add_argument("--base-url", default=CellConfig.base_url)
    p.add_argument("--api-key", default=os.environ.get("PACKWRIGHT_API_KEY"))
    p.add_argument("--no-llm", action="store_true")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--limit", type=int)
    p.add_argument("--subsample", type=int)
    p.add_argument("--sample-set")
    p.add_argument("--freeze-samples")
    p.add_argument("--freeze-only", action="store_true")
    p.add_argument("--out-dir")
    p.add_argument("--show-pack", action="store_true")
    p.add_argument("--tokenizer")
    return p


def main(argv: list[str] | None = None) -> None:
    p = parser()
    args = p.parse_args(argv)
    if args.freeze_only and not args.freeze_samples:
        p.error("--freeze-only goes with --freeze-samples and a path")
    spark = SparkSession.builder.getOrCreate()
    done = run_cell(spark, CellConfig(**vars(args)))
    if done:
        print(f"{done[0]}\n" + "\n".join(f"{k}: {v}" for k, v in done[1].items()))


if __name__ == "__main__":
    main()
