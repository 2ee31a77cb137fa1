"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own where that is unset in local mode.

    On a cluster a folder that only one machine sees would lose rows, so there it must be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="packwright-"))
        where = _own[0]
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/packwright-{uuid.uuid4().hex}/{name}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet and read it back, which cuts its lineage durably."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: 64-bit words of a bounded filter: its broadcast is some 16 MB at most, at any scale.
FILTER_WORDS = 1 << 19


def _probe(id_col: str) -> tuple[Column, Column]:
    """A filter's word for an id, and the two bits that the id sets in it."""
    h = F.xxhash64(F.col(f"`{id_col}`").cast("long"))
    bits = [F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(cast(`{id_col}` as bigint)), {at}), 64) as int))") for at in (40, 50)]
    return F.pmod(h, F.lit(FILTER_WORDS)), bits[0].bitwiseOR(bits[1])


def bounded_filter(ids: DataFrame) -> DataFrame:
    """A blocked Bloom filter of a bigint column: (_word, _bits), at most FILTER_WORDS rows."""
    word, bits = _probe(ids.columns[0])
    return ids.select(word.alias("_word"), bits.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def maybe_in(df: DataFrame, id_col: str, words: DataFrame) -> DataFrame:
    """The rows of df whose id may be in the filter, with no shuffle of df.

    None that is in it is lost; of the others, few get through as long as the filter
    isn't full (some 4% at 3 million ids, most from 30 million on: then a later join
    shuffles them all the same). It saves that join from shuffling rows without a partner.
    """
    word, bits = _probe(id_col)
    hit = df.join(F.broadcast(words), word == F.col("_word"))
    return hit.where(F.col("_bits").bitwiseAND(bits) == bits).drop("_word", "_bits")


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id isn't in the first column of ids; null ids stay.

    Rows that a filter of the ids rules out stay where they are, only the others are
    shuffled for the join. df's columns may have any names.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    own = names[df.columns.index(id_col)]
    rows = df.toDF(*names)
    gone = materialize(ids.select(F.col(ids.columns[0]).cast("long").alias("_gone")).where("_gone is not null").distinct(), "gone")
    word, bits = _probe(own)
    words = F.broadcast(bounded_filter(gone))
    marked = rows.join(words, word == F.col("_word"), "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(bits) == bits, F.lit(False))
    clear = marked.where(~maybe).select(*names)
    asked = marked.where(maybe).select(*names)
    return clear.unionByName(asked.join(gone, F.col(own).cast("long") == F.col("_gone"), "left_anti")).toDF(*df.columns)


SALTS = 4


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_by: str, how: str = "inner") -> DataFrame:
    """An inner or left join whose hot keys are split.

    big's rows of a key go to SALTS groups by a hash of ``salt_by``; small's rows are
    copied to each. As small is dealt out anew (it may come from an aggregation by the
    same keys), adaptive execution can split what is still skewed.
    """
    salt = F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")
