"""Detection and cost metrics of ledger rows, as conditional aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def ratio(a: Column, b: Column, empty: float | None = NAN) -> Column:
    """a / b as double, and ``empty`` where b is 0 or null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def pair_outcomes(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., pair_id, outcome) over rows without backend failures.

    P-C both halves right, P-V both called vulnerable, P-B both called benign, P-R both
    wrong; "dropped" if a half is unreadable. Pairs without exactly one half of each
    label don't appear.
    """
    by = by or []
    clean = ledger.where("n_backend_failures = 0")
    pairs = clean.groupBy(*by, "pair_id").agg(
        F.count_if(F.col("label") == 1).alias("_v"),
        F.count_if(F.col("label") == 0).alias("_b"),
        F.max(F.when(F.col("label") == 1, F.col("prediction"))).alias("_pv"),
        F.max(F.when(F.col("label") == 0, F.col("prediction"))).alias("_pb"),
    )
    v, b = F.col("_pv"), F.col("_pb")
    outcome = F.when((v == 1) & (b == 0), "P-C").when((v == 1) & (b == 1), "P-V").when((v == 0) & (b == 0), "P-B").when((v == 0) & (b == 1), "P-R").otherwise("dropped")
    return pairs.where("_v = 1 and _b = 1").select(*by, "pair_id", outcome.alias("outcome"))


def confusion(parsed: Column) -> dict[str, Column]:
    y, p = F.col("label"), F.col("prediction")
    return {
        "tp": F.count_if(parsed & (y == 1) & (p == 1)).cast("double"),
        "fp": F.count_if(parsed & (y != 1) & (p == 1)).cast("double"),
        "fn": F.count_if(parsed & (y == 1) & (p != 1)).cast("double"),
        "tn": F.count_if(parsed & (y != 1) & (p != 1)).cast("double"),
    }


def cell_metrics(ledger: DataFrame, by: list[str] | None = None, undefined: float | None = NAN) -> DataFrame:
    """The 25 metrics, one row a group of ``by`` (one row in all without it).

    ``undefined`` stands for metrics without a value: NaN, or None for null.
    """
    by = by or []
    clean = F.col("n_backend_failures") == 0
    parsed = clean & (F.col("prediction") != -1)
    main = ledger.groupBy(*by).agg(
        F.count("*").alias("n_samples"),
        F.count_if(clean).alias("n_samples_excluding_backend_failures"),
        F.count_if(parsed).alias("_parsed"),
        *[c.alias(f"_{k}") for k, c in confusion(parsed).items()],
        F.avg("pack_tokens").alias("mean_pack_tokens"),
        F.avg("n_evidence_tokens").alias("mean_evidence_tokens"),
        F.avg("n_candidates_pool").alias("mean_candidates_pool"),
        F.avg("n_candidates_selected").alias("mean_candidates_selected"),
        F.median("index_time_s").alias("median_index_time_s"),
        F.median("build_time_cold_ms").alias("median_build_cold_ms"),
        F.median("build_time_warm_ms").alias("median_build_warm_ms"),
        F.avg((F.col("n_backend_failures") > 0).cast("double")).alias("n_backend_failures_rate"),
    )
    kinds = ["P-C", "P-V", "P-B", "P-R"]
    outcomes = pair_outcomes(ledger, by).groupBy(*by).agg(
        *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds], F.count_if(F.col("outcome") == "dropped").alias("n_pairs_dropped_unparsable")
    )
    if by:
        on = reduce(lambda a, b: a & b, [F.col(f"m.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by])
        both = main.alias("m").join(outcomes.alias("o"), on, "left").select("m.*", *[F.col(f"o.`{c}`") for c in [*kinds, "n_pairs_dropped_unparsable"]])
    else:  # one row on either side
        both = main.withColumn("_one", F.lit(1)).join(outcomes.withColumn("_one", F.lit(1)), "_one").drop("_one")
    both = both.fillna(0, [*kinds, "n_pairs_dropped_unparsable"])
    tp, fp, fn, tn = (F.col(f"_{k}") for k in ("tp", "fp", "fn", "tn"))
    n = F.col("_parsed")
    n_pairs = reduce(lambda a, b: a + b, [F.col(f"`{k}`") for k in kinds])

    def defined(value: Column) -> Column:
        return F.when(n > 0, value).otherwise(F.lit(undefined).cast("double"))

    margins = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    sides = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    recalls = ratio(tp, tp + fn, 0.0) + ratio(tn, tn + fp, 0.0)
    cost = ["mean_pack_tokens", "mean_evidence_tokens", "mean_candidates_pool", "mean_candidates_selected", "median_index_time_s", "median_build_cold_ms", "median_build_warm_ms", "n_backend_failures_rate"]
    return both.select(
        *by,
        "n_samples",
        "n_samples_excluding_backend_failures",
        n_pairs.alias("n_pairs"),
        "n_pairs_dropped_unparsable",
        ratio(F.col("`P-C`"), n_pairs, undefined).alias("pAcc"),
        *[F.col(f"`{k}`") for k in kinds],
        defined(ratio(tp * tn - fp * fn, margins, 0.0)).alias("MCC"),
        defined(ratio(2 * tp, 2 * tp + fp + fn, 0.0)).alias("F1"),
        defined(ratio(2 * (tp + fn), 2 * (tp + fn) + fp + tn, 0.0)).alias("F1_trivial"),
        defined(ratio(tp, tp + fp, 0.0)).alias("precision"),
        defined(ratio(tp, tp + fn, 0.0)).alias("recall"),
        defined(ratio(recalls, sides, 0.0)).alias("balanced_accuracy"),
        defined(ratio(tp + tn, n, 0.0)).alias("accuracy"),
        ratio(F.col("n_samples_excluding_backend_failures") - n, F.col("n_samples_excluding_backend_failures"), undefined).alias("unparsable_rate"),
        *[F.coalesce(F.col(c), F.lit(undefined).cast("double")).alias(c) for c in cost],
    )
