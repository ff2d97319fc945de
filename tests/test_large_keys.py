"""Queries over keys that the test tables are too small to have, against their SQL where it gives a result."""

import duckdb
import pytest

from tidewheel.plans import catalog

KEYS = [0, 1, 3, 4, 25, 26, 1023, 1024, 1664510, 1664511, 1999999, 2097151, -1, -5, -1664511]
#: Their cubes don't fit in a BIGINT: the SQL of quic_varint and uvarint ends with an error.
BEYOND = [2097152, 8999999, 53999999]


def orders(spark, path, keys):
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").coalesce(1).write.parquet(f"{path}/orders.parquet")
    return str(path)


def by_sql(path, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/orders.parquet/*.parquet'")
    return sorted(c.execute(catalog.ORACLE[name]).fetchall())


@pytest.mark.parametrize("name", ["quic_varint", "uvarint"])
def test_cubes_of_all_sizes(spark, tmp_path, name):
    fit, beyond = orders(spark, tmp_path / "fit", KEYS), orders(spark, tmp_path / "beyond", KEYS + BEYOND)
    want = by_sql(fit, name)
    assert sorted(tuple(x) for x in catalog.QUERIES[name](spark, fit).collect()) == want
    got = {tuple(x) for x in catalog.QUERIES[name](spark, beyond).collect()}
    assert got == {*want, *((k, None, None, None) for k in BEYOND)}


def test_identifiers_of_late_and_early_times(spark, tmp_path):
    fit = orders(spark, tmp_path / "fit", [0, 1, 3257811, 3257812, 3257813, 8999999, 53999999, 10**11, -1, -3257813])
    got = sorted(tuple(x) for x in catalog.QUERIES["uuid_fields"](spark, fit).collect())
    assert got == by_sql(fit, "uuid_fields")
