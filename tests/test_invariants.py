"""Cross-report invariants and NULL edge cases on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from subledger.plans.registry import QUERIES
from subledger.plans.reports import behavior, buying
from subledger.plans.warehouse import Warehouse
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def w(spark):
    return Warehouse.from_testdata(spark, SF_SMALL)


def _one(df):
    return df.first()[0]


def test_mean_and_single_value_median_agree(w):
    # the "median" of the single quotient is the quotient itself
    a = _one(QUERIES["avg_revenue_per_customer"](w))
    b = _one(QUERIES["median_revenue_single_row"](w))
    assert abs(a - b) < 1e-3


def test_bin_tables_cover_the_same_contracts(w):
    v1 = {r.contract_duration: r.cnt for r in QUERIES["contract_duration_bins_v1"](w).collect()}
    v2 = {r.contract_duration: r.cnt for r in QUERIES["contract_duration_bins"](w).collect()}
    assert sum(v1.values()) == sum(v2.values())
    assert v1.get("Y2") == v2.get("Y1-Y2") and v1.get("Y2+") == v2.get("Y2+")


def test_segments_partition_the_paying_contracts(w):
    seg = QUERIES["revenue_segments"](w).collect()
    paying = w.l2_invoice.where("paid_date is not null").select("contract_id").distinct().count()
    assert sum(r.num_customers for r in seg) == paying
    assert len(seg) <= 4


def test_free_types_are_known_types(w):
    free = {r.product_type for r in QUERIES["free_product_types"](w).collect()}
    known = {r.product_type for r in w.l2_product_purchase.select("product_type").distinct().collect()}
    assert free <= known


def test_churn_counts_bounded_by_contracts(w):
    r = QUERIES["churn_same_day_vs_kept"](w).first()
    o = QUERIES["churn_with_other_products"](w).first()
    assert o.churned_with_other_products_count <= r.churned_on_same_day_count
    assert o.kept_with_other_products_count <= r.kept_subscription_count


def _pp(spark, rows):
    return spark.createDataFrame(rows, "contract_id long, price_wo_vat double, product_purchase_id long")


def _contracts(spark, rows):
    return spark.createDataFrame(rows, "contract_id long, contract_valid_to date")


def test_zero_paying_not_in_null_rules(spark):
    contracts = _contracts(spark, [(1, None), (2, None), (2, None), (3, dt.date(2024, 1, 1))])
    base = [(1, 0.0, 10), (1, 0.0, 11), (2, 0.0, 20), (2, 5.0, 21), (3, 0.0, 30)]
    # contract 1: two zero rows x one open contract row; contract 2 paid once; 3 is closed
    assert _one(behavior.zero_paying_customers(_pp(spark, base), contracts)) == 2
    # a paying row without a contract id makes NOT IN unknown for every row
    assert _one(behavior.zero_paying_customers(_pp(spark, base + [(None, 9.0, 99)]), contracts)) == 0
    # a NULL-id row that is not paying does not matter
    assert _one(behavior.zero_paying_customers(_pp(spark, base + [(None, 0.0, 98)]), contracts)) == 2
    # nobody ever paid: every zero-price contract qualifies (2 open rows for contract 2)
    free = [(1, 0.0, 10), (2, 0.0, 20)]
    assert _one(behavior.zero_paying_customers(_pp(spark, free), contracts)) == 1 + 2


def test_zero_paying_matches_sql_formulation(spark):
    pp = _pp(spark, [(1, 0.0, 1), (1, None, 2), (2, 0.0, 3), (2, 1.0, 4), (4, 0.0, 5), (None, 0.0, 6)])
    contracts = _contracts(spark, [(1, None), (2, None), (4, None), (4, None)])
    pp.createOrReplaceTempView("zp_pp")
    contracts.createOrReplaceTempView("zp_c")
    want = spark.sql(
        """
        with zero_paying as (
          select contract_id from zp_pp
          where contract_id in (select contract_id from zp_pp where price_wo_vat = 0)
            and contract_id not in (select contract_id from zp_pp where price_wo_vat > 0))
        select count(c.contract_id) from zp_c c join zero_paying z on z.contract_id = c.contract_id
        where c.contract_valid_to is null"""
    ).first()[0]
    assert _one(behavior.zero_paying_customers(pp, contracts)) == want


def test_revenue_fanout_rewrite_equals_naive_join(spark):
    inv = spark.createDataFrame(
        [(1, 10.0, dt.date(2024, 1, 1)), (1, 5.0, dt.date(2024, 1, 2)), (2, 7.0, dt.date(2024, 1, 3)),
         (2, None, dt.date(2024, 1, 3)), (3, 1.0, None), (4, 2.5, dt.date(2024, 2, 1))],
        "contract_id long, amount_wo_vat double, paid_date date",
    )
    pp = spark.createDataFrame([(1, 100), (1, 101), (1, None), (2, 200), (None, 300)], "contract_id long, product_purchase_id long")
    got = {r.contract_id: (r.total_revenue, r.total_purchases) for r in buying.revenue_per_paying_contract(inv, pp).collect()}
    naive = (
        inv.where("paid_date is not null").alias("i")
        .join(pp.alias("p"), F.col("i.contract_id") == F.col("p.contract_id"), "left")
        .groupBy("i.contract_id")
        .agg(F.sum("amount_wo_vat").alias("r"), F.count("product_purchase_id").alias("n"))
    )
    want = {r.contract_id: (r.r, r.n) for r in naive.collect()}
    assert got == want


def test_segments_compare_unrounded_revenue(spark):
    """Revenues that differ only beyond the reported digits still fall into four segments."""
    inv = spark.createDataFrame([(i, 10.0 + i / 100_000, dt.date(2024, 1, 1)) for i in range(1, 9)], "contract_id long, amount_wo_vat double, paid_date date")
    pp = spark.createDataFrame([], "contract_id long, product_purchase_id long")
    got = {r.revenue_segment: r.num_customers for r in buying.revenue_segments(inv, pp).collect()}
    assert sorted(got.values()) == [2, 2, 2, 2]


def test_spenders_and_quartiles_rank_unrounded_sums(spark):
    inv = spark.createDataFrame([(i, 1.0 + i * 1e-6, dt.date(2024, 1, 1), i) for i in range(5)], "contract_id long, amount_wo_vat double, paid_date date, invoice_id long")
    assert [r.contract_id for r in behavior.top_spenders(inv, top=2).collect()] == [4, 3]
    q = behavior.revenue_per_customer_quartiles(inv, digits=None).first()
    assert q.q0 == 1.0 and q.q4 == 1.000004


def _l1_invoices(spark, rows):
    cols = ("due_date", "paid_date", "start_date", "end_date", "date_insert", "update_date")
    df = spark.createDataFrame(rows, "contract_id long, invoice_id long, date_issue date, amount_w_vat double")
    df = df.withColumns({c: F.lit(None).cast("date") for c in cols}).withColumn("branch_id", F.lit(1).cast("long"))
    return df.withColumns({"invoice_type": F.lit("invoice"), "flag_invoice_issued": F.lit(True)})


@pytest.mark.parametrize("hot_rows", [10**9, 30, 10])
def test_invoice_order_with_repeated_contracts(spark, hot_rows):
    """8 invoices x 5 contract rows are 40 joined rows of one contract, whatever path numbers them."""
    from subledger.plans import layers

    rows = [(1, 100 + i, dt.date(2024, 1, 1 + i % 3), 12.0) for i in range(8)] + [(2, 200, dt.date(2024, 1, 1), 5.0)]
    rows += [(None, 300 + i, dt.date(2024, 1, 1), 1.0) for i in range(60)] + [(9, 400 + i, dt.date(2024, 1, 1), 1.0) for i in range(60)]
    contracts = spark.createDataFrame([(1,)] * 5 + [(2,), (3,), (None,)], "contract_id long")
    got = layers.l2_invoice(_l1_invoices(spark, rows), contracts, hot_rows=hot_rows)
    by = {}
    for r in got.orderBy("invoice_order").collect():
        by.setdefault(r.contract_id, []).append((r.invoice_order, r.date_issue, r.invoice_id))
    assert set(by) == {1, 2} and [x[0] for x in by[1]] == list(range(1, 41))
    assert [x[1:] for x in by[1]] == sorted(x[1:] for x in by[1])
    assert len({(r.contract_id, r.invoice_order) for r in got.collect()}) == 41


def test_equipment_counts_equal_the_joined_rows(spark):
    from subledger.plans.reports import churn

    d = dt.date
    rows = [(1, p, t, d(2023, 1, 1), d(2023, 1 + p, 1)) for p, t in ((1, "equipment"), (2, "equipment"), (3, "rent"), (4, "service"), (5, None))] * 2
    rows += [(2, 1, "equipment", d(2023, 1, 1), d(2023, 2, 1)), (None, 7, "equipment", d(2023, 1, 1), d(2023, 2, 1))]
    df = spark.createDataFrame(rows, "contract_id long, product_id long, product_type string, product_valid_from date, product_valid_to date")
    got = {(r.contract_id, r.other_product_at_same_time): r.cnt for r in churn.churned_equipment_other_types(df).collect()}
    eq = [r for r in rows if r[2] == "equipment" and r[0]]
    want = {}
    for c, _, _, _, _ in eq:
        for o in {(r[1], r[2]) for r in rows if r[0] == c and any(e[0] == c and e[1] != r[1] and r[3] <= e[4] <= r[4] for e in eq)}:
            want[(c, o[1])] = want.get((c, o[1]), 0) + 1
    assert got == want and got
