"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from engramlake.plans import catalog, catalog_memory, catalog_rules, catalog_text  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame, columns):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 6))
        return str(x.to_pydatetime()) if hasattr(x, "to_pydatetime") else str(x)

    return sorted(tuple(cell(x) for x in row) for row in frame[columns].itertuples(index=False))


assert set(catalog.QUERIES) > {f for f in dir(catalog_memory) if f.startswith("m_")}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    rows = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.SQL:
        assert len(rows) > 0
        return
    expected = duck.sql(catalog.SQL[name]).df()
    columns = sorted(rows.columns)
    assert columns == sorted(expected.columns)
    assert plain(rows, columns) == plain(expected.astype({c: rows[c].dtype for c in columns if rows[c].dtype.kind in "if" and not expected[c].isna().any()}), columns)
