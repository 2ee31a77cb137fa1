"""URL filtering by a sort-merge range join, in DataFrame functions only.

A host becomes its canonical key: labels reversed and each ended by 0x01 (which is escaped
within a label), so that a host and all its subdomains are exactly the keys from ``key``
up to the key whose last 0x01 is a 0x02. Rules and urls are merged in key order by one
sorted window; its running state is a stack with one slot for each number of labels, since
of the rules with equally many labels only the last that began can still be open. A slot
whose interval has ended is popped. The rules of the open slots whose path begins the
url's path are left, and the longest of them decides.

Urls are dealt to groups by a hash of the host's last two labels, and the urls of a group
to as many shares as their part of all urls asks for, so one host with a third of all rows fills no
task alone. A rule of two labels or more is copied to its own group's shares, one of a
single label (a top-level domain) to all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups of hosts, and shares of urls for each shuffle partition beyond one a group.
GROUPS = 1024
SHARES = 4
RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """The host as written between ``://`` and the first of ``/?#``, A-Z lower-cased.

    Null and a url without ``://`` give the empty string.
    """
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """The path after the host up to ``?``, ``#`` or the end; empty like the host."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by 0x01: prefixes of labels are prefixes of keys."""
    plain = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x03")), F.lit("\x01"), F.lit("\x02\x04"))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), "\x01"), F.lit("\x01"))


def _group(key: Column) -> Column:
    """The group of a key: a hash of its first two labels."""
    return F.pmod(F.xxhash64(F.substring_index(key, "\x01", 2)), F.lit(GROUPS)).cast("int")


def filter_urls(
    df: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str, str]],
    url_col: str = "url",
    id_col: str = "page_id",
    default: str = "allow",
    share_rows: int | None = None,
) -> DataFrame:
    """Judge every row's url; returns the id, host, path, rule and verdict.

    rules: (host, path, verdict) triples or a DataFrame of them. A rule fits its host
    and all subdomains of it if the url's path starts with the rule's path. The longest
    rule text (host and path together) wins, then the smallest text, then the
    smallest verdict. No fitting rule: rule null, verdict ``default``.

    Defined cases: a null id stays null; a null, empty or malformed url has an empty
    host and path and gets the default (unless a rule has the empty host); repeated
    rows stay repeated; rules with a null part are ignored, repeated rules count once;
    an empty table gives an empty result, no rules give the default everywhere. Other
    columns of df aren't read, so their names can't clash.
    """
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    by_host = rules.groupBy(F.translate("host", UPPER, LOWER).alias("rule_host")).agg(
        F.sort_array(
            F.collect_set(F.struct((-F.length("path")).alias("order"), F.concat("host", "path").alias("rule"), "path", "verdict"))
        ).alias("paths")
    )
    by_host = by_host.select(host_key(F.col("rule_host")).alias("key"), "paths")
    by_host = by_host.withColumn("level", F.size(F.split("key", "\x01")) - 1)
    # One small job: how deep the rules nest.
    depth = by_host.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]

    url = F.col(url_col)
    urls = df.select(F.lit(1).alias("kind"), F.col(id_col).alias("id"), F.xxhash64(url, F.col(id_col)).alias("dealt"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("bucket", _group(F.col("key")))
    # At most GROUPS rows, whatever the tables' sizes, and GROUPS + SHARES * partitions shares.
    shares = urls.groupBy("bucket").agg(F.count("*").alias("n"))
    most = F.lit(SHARES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = F.lit(share_rows) if share_rows else F.greatest(F.ceil(F.sum("n").over(Window.partitionBy(F.lit(0))) / most), F.lit(1))
    shares = shares.select("bucket", (1 + F.floor(F.col("n") / size)).cast("int").alias("shares"))
    urls = urls.join(F.broadcast(shares), "bucket").withColumn("share", F.pmod("dealt", F.col("shares")).cast("int")).drop("shares", "dealt")
    copied = shares.select("bucket", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    narrow = by_host.where("level > 1").withColumn("bucket", _group(F.col("key"))).join(F.broadcast(copied), "bucket")
    wide = by_host.where("level = 1").join(F.broadcast(copied.withColumn("one", F.lit(1))), F.col("level") == F.col("one"))
    opens = narrow.unionByName(wide.drop("one")).select("bucket", "share", F.lit(0).alias("kind"), "key", "level", "paths")
    merged = urls.unionByName(opens, allowMissingColumns=True)
    sweep = Window.partitionBy("bucket", "share").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slot = F.struct(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("\x02")).alias("end"), F.col("key").alias("begin"), "paths")
    merged = merged.select(
        "*", *[F.last(F.when(F.col("level") == n, slot), ignorenulls=True).over(sweep).alias(f"slot{n}") for n in range(1, depth + 1)]
    )
    judged = merged.where("kind = 1")
    best = F.lit(None)
    if depth:
        opened = [F.when((F.col("key") >= F.col(f"slot{n}.begin")) & (F.col("key") < F.col(f"slot{n}.end")), F.col(f"slot{n}.paths")) for n in range(1, depth + 1)]
        stack = F.flatten(F.filter(F.array(*opened), lambda paths: paths.isNotNull()))
        fitting = F.filter(stack, lambda r: F.startswith(F.col("path"), r["path"]))
        ranked = F.array_sort(F.transform(fitting, lambda r: F.struct((-F.length(r["rule"])).alias("order"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
        best = F.get(ranked, F.lit(0))
        judged = judged.withColumn("best", best)
        rule, verdict = F.col("best.rule"), F.coalesce(F.col("best.verdict"), F.lit(default))
    else:
        rule, verdict = F.lit(None).cast("string"), F.lit(default)
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
