"""The queries with an SQL form equal it on sf0.01; every dealt query is registered once."""

from collections import Counter

import pytest
from samples import SF01

from almacen.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = queries.registry()[name](spark, SF01)
    cur = con.execute(oracle.oracle_sql()[name])
    cols = sorted(df.columns)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(tuple(r[i] for i in at) for r in cur.fetchall())


def test_registered():
    import __spark_entry__ as entry
    assert [n for n in entry.queries() if n.startswith("op")] == [n for n in queries.registry() if n != "pipeline"]
    assert "pipeline" in entry.queries()
