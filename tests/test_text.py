import hashlib

import pytest
from pyspark.sql import functions as F

from packwright.functions import text as X


def each(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_code_tokens(spark):
    got = each(spark, ["read_buffer readBuffer HTTPServer x2Y aB1C", "", None, "é_ñ a"], X.code_tokens)
    assert got == [["read", "buffer", "read", "buffer", "httpserver", "x2", "y", "a", "b1", "c"], [], None, ["a"]]


def test_guess_function_name(spark):
    got = each(spark, ["int foo (int a)\n{bar();}", "static int __attribute__((x)) foo (", "no name {f()}", "// bar()\nint f(", None], X.guess_function_name)
    assert got == ["foo", "__attribute__", None, "bar", None]


def test_extract_verdict(spark):
    got = each(spark, ["  Vulnerable.", "SAFE", "Sure, vulnerable", "**SAFE**", "", "\n\tvuln", "maybe"], X.extract_verdict)
    assert got == [1, 0, 0, -1, -1, 1, -1]


def test_clean_body(spark):
    got = each(spark, ["cpp\nint f(){}", " c\nint f(){}", "int f(){} \n", "H\nc\nx", "\x1c\xa0x　"], X.clean_body)
    assert got == ["int f(){}", "c\nint f(){}", "int f(){}", "c\nx", "x"]


@pytest.mark.parametrize("text", ["", "a", "a b  c\n\td", " x ", "\x1cy\xa0z"])
def test_count_tokens(spark, text):
    assert each(spark, [text], X.count_tokens) == [int(len(text.split()) * 1.3)]


def test_marks_and_ids(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (-1, 0)], "p int, y int")
    assert [tuple(r) for r in df.select(X.verdict_label(F.col("p")), X.correctness_mark(F.col("p"), F.col("y"))).collect()] == [("VULN", "OK"), ("SAFE", "FAIL"), ("??", "??")]
    ids = spark.createDataFrame([("10-vuln",), ("2-benign",)], "s string")
    assert ids.agg(X.sample_set_id(F.col("s"))).first()[0] == "71b7859ce8c6" == hashlib.sha256(b"10-vuln\n2-benign").hexdigest()[:12]
    assert each(spark, ["/w/a/b.c", "/x/b.c"], lambda c: X.relative_path(c, F.lit("/w"))) == ["a/b.c", "/x/b.c"]


def test_exact_counter(spark):
    from pathlib import Path

    from packwright.functions.tokens import exact_counter

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not Path(path).exists():
        pytest.skip("no vocabulary file")
    assert each(spark, ["hello world", "", "<|endoftext|>"], exact_counter(path))[:2] == [2, 0]
