"""Every registered query with an oracle gives DuckDB's rows."""

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(table) -> list:
    """Sorted rows of an Arrow table: integers stay integers where there are nulls."""

    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    names = sorted(table.column_names)
    return [names, *sorted([plain(r[c]) for c in names] for r in table.to_pylist())]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    assert rows(catalog.QUERIES[name](spark, sf).toArrow()) == rows(duck.sql(catalog.ORACLES[name]).to_arrow_table())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
