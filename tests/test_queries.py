"""Every query of the library against its oracle, and the others for their rows."""

import pytest

from fieldspark.plans import registry

from .oracle import connect, rows_of, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    found = rows_of(registry.QUERIES[name](spark, SF))
    assert found[1]
    if name in registry.ORACLES:
        assert found == sql_rows(db, registry.ORACLES[name])


def test_same_rows_for_any_partitioning(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows_of(registry.QUERIES["q_scatter_capped_counts"](spark, SF)))
        assert results[0] == results[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
