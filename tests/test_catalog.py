import random

import pytest
from conftest import SF
from helpers import same

from packwright.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck):
    same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_random_order_of_the_whole_pool(spark, tmp_path):
    docs = [(i, f"word{i} some text", f"src{i % 20}") for i in random.Random(1).sample(range(1000), 230)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"item {i}") for i in range(3)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["random_perm"](spark, str(tmp_path)).collect()
    want = set()
    for i in range(3):
        order = [f"d{k}" for k in sorted(d[0] for d in docs)]
        random.Random(f"0-b{i}").shuffle(order)
        want |= {(f"b{i}", name, rank) for rank, name in enumerate(order, 1)}
    assert len(got) == 690 and {tuple(r) for r in got} == want


def test_entry_contract(spark):
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["sample_id", "pos", "name", "tokens", "used"]
