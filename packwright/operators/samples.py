"""Samples: deduplication, the two halves of a pair, draws, frozen sets."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.functions import text as X
from packwright.sources.pairs import worktree_id


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key; one aggregation with partial results, no sort.

    Rows come back whole: the row travels as a struct beside its order.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """One line an idx: the first in file order."""
    return first_by(pairs, ["idx"], ["ord"])


def explode_pairs(pairs: DataFrame, commit_mode: str = "parent-of-fix") -> DataFrame:
    """Two samples a pair, the vulnerable half first.

    In the mode "vul-intro" the vulnerable half is on the introducing commit; in any
    other on the parent of the fix.
    """
    vulnerable_at = "vulnerability_introducing_commit_id" if commit_mode == "vul-intro" else "vulnerable_commit_id"

    def half(place: int, name: str, commit: str, body: str, label: int) -> Column:
        return F.struct(
            F.lit(place).alias("half"),
            F.concat(F.col("idx").cast("string"), F.lit(f"-{name}")).alias("sample_id"),
            F.col(commit).alias("commit"),
            X.clean_body(F.col(body)).alias("func_body"),
            F.lit(label).alias("label"),
        )

    halves = F.array(
        half(0, "vuln", vulnerable_at, "vulnerable_function_body", 1),
        half(1, "benign", "vulnerability_fixing_commit_id", "non_vulnerable_function_body", 0),
    )
    out = pairs.select("ord", F.col("idx").alias("pair_id"), "cve", "cwe", "project", "project_url", "file_name", F.explode(halves).alias("h"))
    out = out.select("ord", "h.half", "h.sample_id", "pair_id", "cve", "cwe", "project", "project_url", "file_name", "h.commit", "h.func_body", "h.label")
    return out.withColumn("worktree", worktree_id(F.col("project"), F.col("commit")))


def load_samples(pairs: DataFrame, commit_mode: str = "parent-of-fix") -> DataFrame:
    return explode_pairs(dedup_pairs(pairs), commit_mode)


def stratum(project: Column, cwe: Column) -> Column:
    return F.struct(project.alias("project"), F.coalesce(F.get(cwe, F.lit(0)), F.lit("none")).alias("cwe"))


def round_robin_order(sizes: list[int], n: int, seed: int) -> list[tuple[int, int]]:
    """(stratum, place) in drawing order for strata of the given sizes.

    One generator shuffles the strata and then each stratum's places, in the shuffled
    order of strata; each round takes one from the end of every stratum.
    """
    rng = random.Random(seed)
    strata = list(range(len(sizes)))
    rng.shuffle(strata)
    places = {}
    for s in strata:
        own = list(range(sizes[s]))
        rng.shuffle(own)
        places[s] = own
    out: list[tuple[int, int]] = []
    depth = 0
    while len(out) < n:
        turn = [(s, places[s][-1 - depth]) for s in strata if depth < len(places[s])]
        if not turn:
            break
        out += turn[: n - len(out)]
        depth += 1
    return out


def stratified_draw(samples: DataFrame, n_pairs: int = 120, seed: int = 0) -> DataFrame:
    """About n_pairs pairs, round-robin over (project, first cwe) strata.

    A pair's stratum is its first sample's. Permutations depend on the strata's sizes
    only: those come to the driver (a row a stratum), and the draw goes back as n_pairs
    rows. ``pos`` is the place in drawing order.
    """
    spark = samples.sparkSession
    pairs = samples.groupBy("pair_id").agg(F.min_by(stratum(F.col("project"), F.col("cwe")), F.struct("ord", "half")).alias("stratum"))
    sizes = [(r["stratum"], r["n"]) for r in pairs.groupBy("stratum").agg(F.count("*").alias("n")).orderBy("stratum").collect()]
    drawn = round_robin_order([n for _, n in sizes], n_pairs, seed)
    rows = [(sizes[s][0]["project"], sizes[s][0]["cwe"], place, pos) for pos, (s, place) in enumerate(drawn)]
    picks = spark.createDataFrame(rows, "project string, cwe string, place int, pos int")
    # Only the strata that were drawn from are ranked.
    mine = pairs.join(picks.select("project", "cwe").distinct(), (F.col("stratum.project").eqNullSafe(picks.project)) & (F.col("stratum.cwe") == picks.cwe), "left_semi")
    ranked = mine.withColumn("_place", F.row_number().over(Window.partitionBy("stratum").orderBy("pair_id")) - 1)
    on = F.col("stratum.project").eqNullSafe(picks.project) & (F.col("stratum.cwe") == picks.cwe) & (F.col("_place") == picks.place)
    chosen = ranked.join(F.broadcast(picks), on).select("pair_id", "pos")
    return samples.join(F.broadcast(chosen), "pair_id")


def hashed_draw(df: DataFrame, key: str, strata: list[str], n: int, seed: int = 0) -> DataFrame:
    """The same round-robin with MD5 order keys: no driver step, and plain SQL.

    ``round`` counts within the stratum in the order of md5(seed, key); rows are taken
    by (round, md5 of the stratum).
    """
    own = F.md5(F.encode(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")), "UTF-8"))
    group = F.md5(F.encode(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in strata]), "UTF-8"))
    out = df.withColumn("_own", own).withColumn("stratum_key", group)
    out = out.withColumn("round", F.row_number().over(Window.partitionBy(*strata).orderBy("_own", key))).drop("_own")
    return out.orderBy("round", "stratum_key", key).limit(n)


def apply_frozen(samples: DataFrame, sample_ids: list[str]) -> DataFrame:
    """The frozen samples with their place in ``pos``; repeated ids repeat.

    Of several samples with one id the last counts. Missing ids raise a ValueError that
    names the first five.
    """
    spark = samples.sparkSession
    ids = spark.createDataFrame([(i, s) for i, s in enumerate(sample_ids)], "pos int, sample_id string")
    last = samples.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")
    row = F.struct(*[F.col(c) for c in samples.columns])
    last = last.groupBy("sample_id").agg(F.max_by(row, F.struct("ord", "half")).alias("_row")).select("_row.*")
    missing = ids.join(last, "sample_id", "left_anti")
    n = missing.select("sample_id").count()
    if n:
        some = [r[0] for r in missing.orderBy("pos").limit(5).collect()]
        raise ValueError(f"{n} frozen sample ids aren't in the pair file, first: {some}")
    return ids.join(last, "sample_id")


def limit_samples(samples: DataFrame, n: int) -> DataFrame:
    """The first n samples (not pairs) in file order; a negative n leaves out the last -n."""
    ordered = samples.orderBy("ord", "half")
    return ordered.limit(n if n >= 0 else max(0, samples.count() + n))
