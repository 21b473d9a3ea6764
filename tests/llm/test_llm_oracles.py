"""Text queries with a SQL twin, over whole tables."""

import pytest
from conftest import SF_DIR
from linkledger.llm.queries import ORACLES, QUERIES


def plain(rows, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect(), names) == plain([dict(zip(names, r)) for r in cursor.fetchall()], names)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
