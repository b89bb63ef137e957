"""Every registered query against its oracle, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from vellum.plans import corpus_queries  # noqa: F401
from vellum.plans.registry import ORACLES, QUERIES

TABLES = "orders documents nation".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def rows(frame):
    return sorted(tuple("~" if pd.isna(v) else v if isinstance(v, str) else float(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = connection.execute(ORACLES[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in found.description}
    assert rows(df.toPandas()) == rows(found.fetch_df())


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
