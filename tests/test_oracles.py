"""Every registered query against its SQL twin."""

import decimal
import math

import pytest

from conftest import SF_DIR
from linkledger.plans import load_catalog

QUERIES, ORACLES = load_catalog()
NO_ORACLE = set()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return float(v) if isinstance(v, decimal.Decimal) else v


def rows(columns, records):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=lambda t: tuple((v is None, str(v)) for v in t))


def test_only_listed_queries_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == NO_ORACLE
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = rows(columns, [dict(zip(names, r)) for r in cursor.fetchall()])
    assert rows(columns, [r.asDict() for r in df.collect()]) == expected

