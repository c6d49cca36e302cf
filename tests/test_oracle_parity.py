"""Every registered query equals its DuckDB oracle on the smallest test tables."""

import collections
import datetime as dt
import math

import pytest

import __spark_entry__ as E
from subledger.plans.registry import QUERIES
from tests.conftest import SF_SMALL

KEYS = sorted(QUERIES)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(repr(_norm(r[i])) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(E.queries()) and set(KEYS) <= set(E.oracle_sql())
    assert len(KEYS) == 70


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _bag(df.columns, srows) == _bag(ocols, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["revenue_segment", "num_customers", "total_revenue", "total_purchases"]
    assert df.count() >= 1


SKEW_KEYS = ["l2_invoice", "last_invoice_end_dates", "end_date_by_invoice_order", "churned_equipment_other_types"]


@pytest.mark.parametrize("key", SKEW_KEYS)
def test_hot_group_path_matches_oracle(spark, duck, key):
    """With a tiny hot-group threshold most contracts take the range-partitioned path."""
    from subledger.operators.running import HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, "2")
    try:
        df = E.queries()[key](spark, SF_SMALL)
        srows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    cur = duck.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    assert _bag(df.columns, srows) == _bag(ocols, cur.fetchall())
