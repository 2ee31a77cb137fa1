"""Sinks: the ledger, metrics documents, frozen sample sets and the console."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.sources.pairs import LEDGER_FIELDS, local_hash

FROZEN_FORMAT = 1

# The columns of the two report tables.
DETECTION_COLUMNS = [
    ("pairs", "n_pairs"), ("drop", "n_pairs_dropped_unparsable"), ("unprs", "unparsable_rate"), ("bkfail", "n_backend_failures_rate"),
    ("pAcc", "pAcc"), ("P-C", "P-C"), ("P-V", "P-V"), ("P-B", "P-B"), ("P-R", "P-R"), ("MCC", "MCC"), ("F1", "F1"), ("triv", "F1_trivial"), ("recall", "recall"),
]
COST_COLUMNS = [
    ("pack", "mean_pack_tokens"), ("evid", "mean_evidence_tokens"), ("pool", "mean_candidates_pool"), ("sel", "mean_candidates_selected"),
    ("index_s", "median_index_time_s"), ("cold_ms", "median_build_cold_ms"), ("warm_ms", "median_build_warm_ms"),
]


def append_ledger(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append ledger rows, one folder a cell, so cells are pruned when read back."""
    rows = df.select(*[F.col(n) for n, _ in LEDGER_FIELDS])
    cell = F.format_string("%s_%s_b%d_%s", "selector", "representation", "budget", "backend")
    rows.withColumn("cell", cell).write.mode("append").partitionBy("cell").format(fmt).save(path)


def write_results_file(df: DataFrame, path: str) -> int:
    """The rows as one JSON-lines file on the driver, streamed, not collected at once."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part, n = target.with_name(target.name + ".part"), 0
    with open(part, "w", encoding="utf-8") as out:
        for (line,) in df.select(F.to_json(F.struct(*[F.col(c) for c, _ in LEDGER_FIELDS]), {"ignoreNullFields": "false"})).toLocalIterator():
            out.write(line + "\n")
            n += 1
    part.replace(target)  # a file under its own name is a complete one
    return n


def write_metrics(metrics: dict, path: str) -> None:
    """Metrics as JSON; an undefined one is a bare NaN."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(metrics, indent=2, default=float), encoding="utf-8")


def frozen_set_id(sample_ids: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(sample_ids)).encode()).hexdigest()[:12]


# The keys of a frozen set's file.
def save_frozen(path: str, sample_ids: list[str], seed: int, dataset: str) -> dict:
    payload = {
        "format": FROZEN_FORMAT,
        "sample_set_id": frozen_set_id(sample_ids),
        "seed": seed,
        "dataset": str(dataset),
        "dataset_hash": local_hash(dataset),
        "n_samples": len(sample_ids),
        "sample_ids": list(sample_ids),
    }
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2), encoding="utf-8")
    return payload


def load_frozen(path: str, dataset: str | None = None) -> dict:
    """A frozen set; ValueError if the pair file isn't the one it was drawn from."""
    payload = json.loads(Path(path).read_text(encoding="utf-8"))
    if dataset is not None and (now := local_hash(dataset)) != payload.get("dataset_hash"):
        raise ValueError(f"{path} belongs to a pair file with hash {payload.get('dataset_hash')}, but {dataset} has {now}")
    return payload


def report(cells: list[tuple[str, dict]], columns: list[tuple[str, str]], title: str, width: int = 8) -> str:
    """A text table of cells; floats with three decimals, what is missing stays blank."""

    def text(value) -> str:
        if value is None:
            return ""
        return f"{value:.3f}" if isinstance(value, float) and not math.isinf(value) else str(value)

    first = max([len("cell"), *(len(name) for name, _ in cells)])
    lines = [title, " ".join([f"{'cell':<{first}}", *(f"{label:>{width}}" for label, _ in columns)])]
    lines += [" ".join([f"{name:<{first}}", *(f"{text(m.get(key)):>{width}}" for _, key in columns)]) for name, m in cells]
    return "\n".join(lines)
