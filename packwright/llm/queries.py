"""The registered queries of the training-data operators, and SQL for those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm import chains, decontam, flac, htmltext, jaccard, langid, linededup, mixing, tokenfiles, urlfilter
from packwright.llm.shared import scratch_path

#: Fixed rules of the URL query: (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Targets of the mixing query: names that aren't listed weigh 1.
MIX_WEIGHTS = {"domain": {"web": 3.0, "books": 2.0, "code": 1.0}, "language": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def domain_of(source: str = "source"):
    """The tables have no domains: sources are dealt to three by their number."""
    n = F.pmod(F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("long"), F.lit(0)), F.lit(3))
    return F.when(n == 0, "web").when(n == 1, "books").otherwise("code")


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = flac.encode_column(_table(spark, sf_dir, "documents"))
    return flac.digest_column(media)


def op2_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_counts(_table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.remainder(F.col("doc_id")) == 2
    model = langid.train(docs.where(~held_out))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(_table(spark, sf_dir, "pages"))


def op8_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_rows(docs, domain_of(), F.col("lang"), F.col("source"), mixing.word_count(F.col("text")), weights=MIX_WEIGHTS)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def _mixing_sql(fraction: float = 0.5, max_epochs: int = 2, seed: int = 0) -> str:
    """The mixing query: one water level for each level of the tree, then running sums."""
    levels = ["domain", "language", "source"]
    steps = [f"b0 AS (SELECT *, floor(sum(tokens) OVER () * {fraction}) AS b FROM leaf)"]
    for k, level in enumerate(levels):
        path, parent = ", ".join(levels[: k + 1]), ", ".join(["1", *levels[:k]])
        weight = " ".join(f"WHEN {level} = '{name}' THEN {float(w)}" for name, w in MIX_WEIGHTS.get(level, {}).items())
        weight = f"CASE {weight} ELSE 1.0 END" if weight else "1.0"
        on = " AND ".join(f"l.{c} IS NOT DISTINCT FROM s.{c}" for c in levels[: k + 1])
        order = f"PARTITION BY {parent} ORDER BY ratio NULLS LAST, {path} ROWS BETWEEN"
        steps += [
            f"own{k} AS (SELECT {path}, max(b) AS b, ({weight})::DOUBLE AS w, (sum(tokens) * {max_epochs})::DOUBLE AS room FROM b{k} GROUP BY {path})",
            f"ratio{k} AS (SELECT *, CASE WHEN w > 0 THEN room / w END AS ratio FROM own{k})",
            f"level{k} AS (SELECT *, (b - coalesce(sum(room) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"
            f" / sum(w) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM ratio{k})",
            f"water{k} AS (SELECT *, max(CASE WHEN lv <= ratio THEN lv END) OVER (PARTITION BY {parent}) AS water FROM level{k})",
            f"share{k} AS (SELECT *, round(CASE WHEN ratio IS NULL THEN 0 WHEN water IS NULL THEN room ELSE least(room, water * w) END, 4) AS share FROM water{k})",
            f"b{k + 1} AS (SELECT l.domain, l.language, l.source, l.tokens, s.share AS b FROM b{k} l JOIN share{k} s ON {on})",
        ]
    on = " AND ".join(f"d.{c} IS NOT DISTINCT FROM e.{c}" for c in levels)
    return rf"""
        WITH docs AS (
            SELECT doc_id, CASE coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) AS BIGINT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain,
                   lang AS language, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
        leaf AS (SELECT domain, language, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY domain, language, source),
        {", ".join(steps)},
        epochs AS (SELECT *, CASE WHEN tokens > 0 THEN floor(b)::BIGINT // tokens ELSE 0 END AS whole FROM b3),
        placed AS (
            SELECT d.*, e.whole, floor(e.b)::BIGINT - e.whole * e.tokens AS rest, md5(concat_ws(':', '{seed}', e.whole::VARCHAR, d.doc_id::VARCHAR)) AS place
            FROM docs d JOIN epochs e ON {on}),
        sums AS (
            SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
        SELECT doc_id, domain, language, source, n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM sums"""


SQL: dict[str, str] = {
    "op9_source_mixing": _mixing_sql(),
    "op4_url_filter": r"""
        WITH rules(rhost, rpath, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        fit AS (
            SELECT page_id, rhost || rpath AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath, verdict) AS place
            FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT p.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fit f ON p.page_id = f.page_id AND f.place = 1""",
    "op5_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
        grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT s.doc_id, len(s) AS n_shingles, low AS component_id
        FROM sets s JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) ON x = s.doc_id""",
    "op10_line_dedup": r"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        each_line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each_line),
        common AS (
            SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT e.*, c.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed e LEFT JOIN common c ON e.k = c.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    own = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return own | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    return SQL | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
