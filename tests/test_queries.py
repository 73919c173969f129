"""Every query with SQL gives the rows of its SQL; none of these is empty."""

from __future__ import annotations

import duckdb
import pytest

from otspark.plans import catalog

SF = "/root/testdata/sf0.01"
#: Queries whose right answer is no row.
EMPTY = {"short_payload_fingerprints"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(tuple(repr(one(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    theirs = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in theirs.description]
    expected = theirs.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert bool(expected) == (name not in EMPTY)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(expected, names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
