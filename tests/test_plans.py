"""Physical-plan properties the design relies on at scale."""

import contextlib
import io
import re

import pytest

from subledger.plans.registry import QUERIES
from subledger.plans.warehouse import Warehouse
from tests.conftest import SF_SMALL

# Queries whose nested-loop joins broadcast a frame of at most a few rows by
# construction (quantile targets, one-row cut points / NOT IN statistics).
ONE_ROW_BROADCASTS = {
    "revenue_segments",
    "invoice_amount_quartiles",
    "revenue_per_customer_quartiles",
    "invoice_count_quartiles",
    "median_contract_duration",
    "zero_paying_customers",
}


def _plan(df, mode="simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def materialized(spark):
    w = Warehouse.from_testdata(spark, SF_SMALL)
    w.materialize()
    return w


@pytest.fixture(scope="module")
def plain(spark):
    """The warehouse as the registered queries use it: nothing written."""
    return Warehouse.from_testdata(spark, SF_SMALL)


@pytest.mark.parametrize("kind", ["plain", "materialized"])
@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cartesian_and_no_single_task_over_rows(request, kind, key):
    plan = _plan(QUERIES[key](request.getfixturevalue(kind)))
    assert "CartesianProduct" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1]
            assert "HashAggregate" in child or "ObjectHashAggregate" in child, (key, child)
        if "BroadcastNestedLoopJoin" in line:
            assert key in ONE_ROW_BROADCASTS, key


def test_filters_and_columns_reach_the_scan(materialized):
    from subledger.plans.reports import behavior

    plan = _plan(behavior.top_spenders(materialized.l2_invoice), "formatted")
    assert re.search(r"PushedFilters: \[IsNotNull\(paid_date\)\]", plan)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(f.split(":")[0] for f in schema.split(",")) == ["amount_wo_vat", "contract_id", "paid_date"]


def test_invoice_order_reuses_join_partitioning(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        w = Warehouse.from_testdata(spark, SF_SMALL)
        plan = _plan(w.l2_invoice)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Window" in plan
    # one exchange per join side; the window adds none
    assert len(re.findall(r"Exchange hashpartitioning\((contract_id|__c_id)", plan)) == 2


def test_status_join_never_shuffles_the_purchases_on_status(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(Warehouse.from_testdata(spark, SF_SMALL).l1_product_purchase)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not re.search(r"Exchange hashpartitioning\(package_status", plan)
    assert re.search(r"Exchange hashpartitioning\((id_package_template|product_id)", plan)


def test_reports_without_numbering_run_no_window(plain):
    for key in ("l3_invoice", "check_counts_invoice", "top_spenders", "avg_invoice_amount", "corr_invoices_revenue"):
        assert "Window" not in _plan(QUERIES[key](plain)), key


def test_global_sorts_break_ties_by_key(plain):
    for key, column in (("customers_churned", "contract_id"), ("check_invoice_old_duplicates", "id_invoice_old"), ("churned_equipment_other_types", "other_product")):
        ranges = re.findall(r"rangepartitioning\(([^)]*)", _plan(QUERIES[key](plain)))
        assert ranges and all(column in r for r in ranges), key


HOT_KEYS = [
    "churned_multi_product_top50", "continued_after_trial", "churn_same_day_vs_kept", "churn_with_other_products",
    "trial_then_other_rows", "trial_then_other_revenue", "contract_duration_bins", "trial_customers",
    "non_trial_customers", "customers_per_year",
]


@pytest.mark.parametrize("key", HOT_KEYS)
def test_a_hot_contract_is_split(spark, key):
    """Two thirds of all purchases in one contract: the join on the contract is split."""
    from pyspark.sql import functions as F

    from subledger.sources import testdata

    t = testdata.read_tables(spark, SF_SMALL)
    hot = F.when(F.col("l_linenumber") > 1, F.lit(1)).otherwise(F.col("l_orderkey"))
    t["lineitem"] = t["lineitem"].crossJoin(spark.range(4)).withColumn("l_orderkey", hot).drop("id").repartition(6)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = QUERIES[key](Warehouse(testdata.l0_from_tables(t)))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan, plan[:3000]


def test_equipment_report_reads_its_joins_once(plain):
    """The probe, both kinds of events, the counts and the final sort start from written rows."""
    plan = _plan(QUERIES["churned_equipment_other_types"](plain))
    assert "Scan parquet" not in plan and "FileScan" not in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("numbered", [False, True])
def test_a_task_holds_a_bounded_share_of_a_large_join(spark, numbered):
    """Some 40 MB of compressed invoices and contracts must not be merged into one task."""
    from pyspark.sql import functions as F

    from subledger.plans import layers
    from subledger.plans.reports import behavior

    n = 2_000_000
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.rand(1) * 1000).cast("int"))
    inv = spark.range(n).select(
        F.col("id").alias("invoice_id"), (F.hash("id") % (n // 4)).cast("long").alias("contract_id"), *[day.alias(c) for c in layers.INVOICE_ORDER_KEYS if c.endswith("_date")],
        day.alias("date_issue"), day.alias("date_insert"), (F.rand(2) * 1000).alias("amount_w_vat"), F.lit(1).cast("long").alias("branch_id"),
        F.lit("invoice").alias("invoice_type"), F.lit(True).alias("flag_invoice_issued"),
    )
    contract = spark.range(-n // 4, n // 4).select(F.col("id").alias("contract_id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if numbered:
            out = layers.l2_invoice(inv, contract, hot_rows=10**9)
        else:
            out = behavior._invoices_per_contract(layers.l2_invoice_rows(inv, contract))
        # every column is read, so none is pruned
        per_task = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("rows"), *[F.max(c) for c in out.columns])
        rows = [r["rows"] for r in per_task.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert max(rows) <= 0.7 * sum(rows), rows
