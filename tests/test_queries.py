"""Every registered query against its SQL on the smallest tables."""

from collections import Counter

import pytest

from seqloom.plans.oracle import SQL
from seqloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def db(small):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return Counter(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, small, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got)
    if name in SQL:
        want = db.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        for c in want.columns:
            if want[c].dtype.kind == "f" or got[c].dtype.kind == "f":
                want[c], got[c] = want[c].astype(float), got[c].astype(float)
        assert rows(got) == rows(want)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(QUERIES)


def test_multisets_do_not_depend_on_the_order_of_lines(spark, db, small, monkeypatch):
    """Lines of an order share numbers, so a plan that ranks them and reads its tables several times
    ranks them differently each time. Here rows come in another order whenever they are read."""
    import numpy as np

    from seqloom.plans import queries

    read = queries._t

    def shuffled(spark, d, name):
        df = read(spark, d, name).coalesce(1)
        return df.mapInPandas(lambda frames: (f.sample(frac=1, random_state=np.random.default_rng()) for f in frames), df.schema)

    monkeypatch.setattr(queries, "_t", shuffled)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = QUERIES["cooc_multiset"](spark, small).toPandas()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert rows(got) == rows(db.sql(SQL["cooc_multiset"]).df())
