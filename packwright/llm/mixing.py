"""Mixing sources to target weights through a domain-language-source tree.

Weights are propagated from the root to the leaves. A node's budget is shared among its
children by weight, and a child that can't use its share (its subtree has too few
tokens, each usable ``max_epochs`` times) is filled up; what it leaves goes to its
siblings, by weight, as long as any of them has room. As a node never gets more than
its whole subtree can use, a shortage leaves a subtree only when all siblings below it
are full: siblings come before ancestors.

A leaf's budget is then spent on seeded epochs: whole passes over the leaf, and of the
last epoch the prefix of documents, in that epoch's hash order, whose tokens fit.

All of it is DataFrame code. A leaf's prefix is known by its last hash, its cut. Totals
of hash buckets are summed first, and only the bucket in which the budget ends is looked
at row by row, so a leaf with a third of all rows is spread over all tasks. Each row then
compares its own hash with its leaf's cut: no row is joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.shared import SALTS, materialize

#: Leading hex digits of a row's hash that make its bucket: 4,096 buckets a leaf.
BUCKET_DIGITS = 3
#: Budgets are rounded down to whole tokens after this many decimals, so that the order
#: of floating-point sums doesn't matter.
DECIMALS = 4

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_level(df: DataFrame, parent: list[str], budget: str, weight: str, room: str, out: str) -> DataFrame:
    """Share ``budget`` (equal in all rows of a parent) by weight, no child above its room.

    Children in order of room by weight: up to the level at which the rest of the
    budget suits the rest of the weights, children are filled; above it they get the
    level times their weight. From the first child that isn't filled on the computed
    levels only fall, so the level is the largest that no later room undercuts.
    Children of weight 0 get nothing.
    """
    ratio = F.when(F.col(weight) > 0, F.col(room) / F.col(weight))
    by_ratio = Window.partitionBy(*parent).orderBy(F.col("_ratio").asc_nulls_last(), *[c for c in df.columns if c not in parent])
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_ratio", ratio)
    df = df.withColumn("_level", F.try_divide(F.col(budget) - F.coalesce(F.sum(room).over(upto), F.lit(0.0)), F.sum(weight).over(rest)))
    df = df.withColumn("_water", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(Window.partitionBy(*parent)))
    share = F.when(F.col("_ratio").isNull(), F.lit(0.0)).when(F.col("_water").isNull(), F.col(room)).otherwise(F.least(F.col(room), F.col("_water") * F.col(weight)))
    return df.withColumn(out, F.round(share, DECIMALS)).drop("_ratio", "_level", "_water")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], total: float, max_epochs: int) -> DataFrame:
    """(levels..., tokens, budget) for the leaf totals (levels..., tokens).

    weights: for each level the weight of a name relative to its siblings; a name that
    isn't listed has weight 1.
    """
    df = leaves.withColumn("_b", F.lit(float(total)))
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        own = df.groupBy(*path).agg(F.sum("tokens").alias("_t"), F.max("_b").alias("_b"))
        weight = F.lit(1.0)
        for name, w in sorted(weights.get(level, {}).items()):
            weight = F.when(F.col(level).eqNullSafe(name), F.lit(float(w))).otherwise(weight)
        own = own.withColumn("_w", weight).withColumn("_room", (F.col("_t") * max_epochs).cast("double"))
        own = own.withColumn("_root", F.lit(0))
        own = water_level(own, ["_root", *levels[:depth]], "_b", "_w", "_room", "_share")
        joined = df.drop("_b").alias("a").join(own.alias("b"), _same(path))
        df = joined.select(*[F.col(f"a.{c}").alias(c) for c in [*levels, "tokens"]], F.col("b._share").alias("_b"))
    return df.withColumn("budget", F.floor("_b").cast("long")).drop("_b")


def _same(names: list[str]) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return on


def _with_leaf(rows: DataFrame, leaf: DataFrame, names: list[str], *more: str) -> DataFrame:
    """rows (a) joined with their leaf's columns ``more``; a hot leaf's rows are split.

    Null names are equal. The few leaf rows are copied to SALTS groups of rows.
    """
    salt = F.pmod(F.xxhash64("_id", "_key"), F.lit(SALTS)).cast("int")
    copies = leaf.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = _same([*names, "_salt"])
    return rows.withColumn("_salt", salt).alias("a").join(copies.alias("b"), on).select("a.*", *[f"b.{c}" for c in more]).drop("_salt")


LEVELS = ["_domain", "_language", "_source"]


def _order(seed: int) -> Column:
    """The row's place in the epoch that is cut short, number whole + 1 of its leaf."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.col("_id").cast("string"), F.col("_key").cast("string")))


def leaf_cuts(rows: DataFrame, fraction: float, weights: dict[str, dict[str, float]], max_epochs: int, seed: int) -> DataFrame:
    """(levels..., whole, cut): the whole epochs of each leaf, and the last hash of its cut epoch.

    rows: (_id, _key, levels..., _tokens).
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens"))
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(fraction))).first()[0] or 0
    by_level = {place: weights.get(place[1:], {}) for place in LEVELS}
    budgets = leaf_budgets(leaves, LEVELS, by_level, total, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int")
    budgets = budgets.withColumn("whole", whole).select(*LEVELS, "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest"))
    # One row a source; written, as it is joined three times.
    budgets = materialize(budgets, "budgets")
    got = _with_leaf(rows, budgets, LEVELS, "whole", "rest").withColumn("_order", _order(seed))
    got = got.withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    sums = got.groupBy(*LEVELS, "_bucket").agg(F.sum("_tokens").alias("_sum"), F.max("rest").alias("rest"))
    before = Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    last = sums.where("_before <= rest and _before + _sum > rest").select(*LEVELS, "_bucket", "_before")
    inside = _with_leaf(got, last, [*LEVELS, "_bucket"], "_before")
    peers = Window.partitionBy(*LEVELS).orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_tokens").over(peers))
    # A bucket that has no fitting row is cut before its first: a prefix sorts before all it begins.
    cuts = inside.groupBy(*LEVELS).agg(F.coalesce(F.max(F.when(F.col("_upto") <= F.col("rest"), F.col("_order"))), F.max("_bucket")).alias("_cut"))
    out = budgets.alias("a").join(cuts.alias("b"), _same(LEVELS), "left")
    return out.select(*[F.col(f"a.{c}").alias(c) for c in LEVELS], "whole", F.coalesce("_cut", F.lit("g")).alias("cut"))


def _rows(df: DataFrame, domain: Column, language: Column, source: Column, tokens: Column, id_col: str, text_key: Column | None) -> DataFrame:
    """df's columns by number, the row's names and tokens, and its id and key."""
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)]
    names = [x.cast("string").alias(c) for x, c in zip((domain, language, source), LEVELS, strict=True)]
    key = F.lit(None).cast("long") if text_key is None else text_key
    return df.select(*own, F.col(f"`{id_col}`").alias("_id"), key.alias("_key"), *names, F.coalesce(tokens, F.lit(0)).cast("long").alias("_tokens"))


def mix(
    df: DataFrame,
    domain: Column,
    language: Column,
    source: Column,
    tokens: Column,
    id_col: str = "doc_id",
    fraction: float = 0.5,
    weights: dict[str, dict[str, float]] | None = None,
    max_epochs: int = 2,
    seed: int = 0,
    text_key: Column | None = None,
) -> DataFrame:
    """All rows and columns of df, then domain, language, source, n_tokens and copies.

    The total budget is ``fraction`` of all tokens. copies is how often the row is taken:
    once an epoch that is whole, and once more if it is in the prefix of the last.

    Defined cases: null domains, languages and sources are names of their own; a null or
    wordless text has 0 tokens and is taken with whatever precedes it; rows equal in id
    and ``text_key``, nulls included, have one place in an epoch and are taken together or
    not at all; an empty table gives an empty result. Columns of df may have any names;
    those named like one that is added are replaced by it.
    """
    rows = _rows(df, domain, language, source, tokens, id_col, text_key)
    # Narrow rows, written once: the texts are read by one pass for them and one at the end.
    narrow = materialize(rows.select("_id", "_key", *LEVELS, "_tokens"), "tokens")
    cuts = leaf_cuts(narrow, fraction, weights or {}, max_epochs, seed)
    got = _with_leaf(rows, cuts, LEVELS, "whole", "cut")
    copies = F.col("whole") + F.when(_order(seed) <= F.col("cut"), 1).otherwise(0)
    added = dict(zip(("domain", "language", "source"), map(F.col, LEVELS), strict=True)) | {"n_tokens": F.col("_tokens"), "copies": copies}
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns) if c not in added]
    return got.select(*kept, *[x.alias(c) for c, x in added.items()])


def mix_rows(df: DataFrame, domain: Column, language: Column, source: Column, tokens: Column, id_col: str = "doc_id", **options) -> DataFrame:
    """``mix`` for one narrow row a row of df: id, domain, language, source, n_tokens, copies."""
    return mix(df, domain, language, source, tokens, id_col, **options).select(id_col, "domain", "language", "source", "n_tokens", "copies")
