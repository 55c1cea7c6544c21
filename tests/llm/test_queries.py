import duckdb
import pytest

import __spark_entry__ as entry
from phyllo.llm import queries

from ..test_entry import norm


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    assert len(set(got)) == len(got)
    sql = queries.oracle_sql().get(name)
    if sql:
        import os

        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
        cur = con.execute(sql)
        order = [[d[0] for d in cur.description].index(c) for c in cols]
        assert got == sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def test_columns(spark, data):
    want = {"p1_found": ["item_id_a", "item_id_b"], "p2_found": ["item_id_a", "item_id_b"], "p3_found": ["group_id"], "p4_found": ["item_id", "group_item_id"], "p5_found": ["family_id", "item_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    for name, cols in want.items():
        assert entry.queries()[name](spark, data).columns == cols
