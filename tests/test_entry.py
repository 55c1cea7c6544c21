"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from phyllo import queries as core

#: Results that SQL cannot give: a sequential choice, and a hash that only Spark has. split_properties holds what must be true of them.
NO_SQL = {"grouped_split", "split_by_rounds", "split_distribution"}


def norm(v):
    if isinstance(v, float):
        return f"{v:.9f}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, data, sql, name):
    df = core.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    if name in NO_SQL:
        assert name not in core.oracle_sql() and got
        return
    cur = sql.execute(core.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def test_contract(spark):
    assert set(core.oracle_sql()) | NO_SQL == set(core.queries())
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_splits_keep_groups_and_shares(spark, data):
    rows = core.queries()["split_distribution"](spark, data).groupBy("split").sum("n").collect()
    n = {r[0]: r[1] for r in rows}
    assert abs(n["train"] / sum(n.values()) - 0.8) < 0.05
