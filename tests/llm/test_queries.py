import pytest
from conftest import SF
from helpers import same

from packwright.llm.queries import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck):
    same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize(
    ("name", "table", "columns"),
    [
        ("op1_flac_media", "documents", ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]),
        ("op2_token_scan", "documents", ["doc_id", "file", "number", "start", "n_tokens"]),
        ("op4_url_filter", "pages", ["page_id", "host", "path", "rule", "verdict"]),
        ("op5_ngram_jaccard", "documents", ["doc_id", "n_shingles", "component_id"]),
        ("op6_language_id", "documents", ["doc_id", "held_out", "lang_pred", "score"]),
        ("op7_html_text", "pages", ["page_id", "url", "text", "n_chars"]),
        ("op9_source_mixing", "documents", ["doc_id", "domain", "language", "source", "n_tokens", "copies"]),
        ("op10_line_dedup", "documents", ["doc_id", "n_lines", "n_dropped", "kept_sha256"]),
    ],
)
def test_one_row_a_row(name, table, columns, spark):
    out = QUERIES[name](spark, SF)
    assert out.columns == columns and out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
