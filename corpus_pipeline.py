"""A training-data pipeline over ``documents``, one operator a stage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and reread as the next stage's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm import decontam, jaccard, langid, linededup, mixing
from packwright.llm.queries import MIX_WEIGHTS, domain_of
from packwright.llm.shared import materialize, without_ids

#: A text that no language scores this much of 1 for is rejected, like one without letters.
MIN_LANG_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised.

    Null texts and texts without a letter go; null ids, languages and sources, repeated
    rows and an empty table are no exceptions. Columns may have any names.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    model = langid.train(docs)
    judged = langid.identify(docs.toDF(*names), model, names[docs.columns.index("text")])
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANG_SCORE))
    return kept.select(*names).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each text by what line deduplication leaves of it, and n_chars by its length.

    All rows stay, null and empty texts as they are; rows with a null id keep all lines,
    rows that repeat an id are one document for the counts. Columns may have any names.
    """
    return linededup.replace_texts(docs).withColumn("n_chars", F.length("text").cast("long"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each near-duplicate group.

    Rows without an id or without words stay, and so do rows that repeat a kept id.
    Columns may have any names; an empty table stays empty.
    """
    groups = jaccard.jaccard_components(docs)
    return without_ids(docs, groups.where("component_id <> doc_id").select("doc_id"), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage.

    Null texts and null ids stay; of rows that repeat an id all go if one holds a passage.
    An empty benchmark drops nothing. Columns may have any names.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are taken, with domain, n_tokens and copies of each.

    Null languages and sources are names of their own; rows equal in id and text are
    taken together. Columns of docs named like the three are replaced, the others may
    have any names; an empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    rows = docs.select(*[F.col(f"`{c}`") for c in own])
    inner = rows.toDF(*[f"_d{i}" for i in range(len(own))])
    place = {c: f"_d{i}" for i, c in enumerate(own)}
    text = F.col(place["text"])
    mixed = mixing.mix(
        inner, domain_of(place["source"]), F.col(place["lang"]), F.col(place["source"]), mixing.word_count(text), place["doc_id"], weights=MIX_WEIGHTS, text_key=F.xxhash64(text)
    )
    return mixed.where("copies > 0").select(*[F.col(place[c]).alias(c) for c in own], "domain", "n_tokens", "copies")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Language identification and the trie join aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
