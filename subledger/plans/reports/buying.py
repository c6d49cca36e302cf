"""Buying behaviour: revenue per contract and revenue segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.constants import RESULT_DIGITS, SEGMENT_LABELS, SEGMENT_PERCENTILES
from subledger.functions import exact_sum, rounded
from subledger.operators.quantiles import quantile_values


def avg_revenue_per_customer(l3_invoice: DataFrame, digits: int | None = RESULT_DIGITS) -> DataFrame:
    """sum(revenue) / count(contracts) over the per-contract revenue table."""
    return l3_invoice.agg(rounded(F.try_divide(exact_sum("rev_per_contract"), F.count("contract_id")), digits).alias("rev_per_cust"))


def median_revenue_single_row(l2_invoice: DataFrame, digits: int | None = RESULT_DIGITS) -> DataFrame:
    """The "median" of a single value: paid revenue / distinct paying contracts.

    The inner query has no GROUP BY, so its median is the value itself.
    """
    paid = l2_invoice.where(F.col("paid_date").isNotNull())
    return paid.agg(
        rounded(F.try_divide(exact_sum("amount_wo_vat"), F.count_distinct("contract_id")), digits).alias("median")
    )


def revenue_per_paying_contract(l2_invoice: DataFrame, l2_product_purchase: DataFrame) -> DataFrame:
    """Per contract: revenue and purchase count of (paid invoices LEFT JOIN purchases).

    The join multiplies each invoice by the contract's purchase rows.
    Instead of building those N x M rows, each side is aggregated per
    contract (partial aggregation, no skew) and the products are formed on
    one row per contract:
    revenue = sum(amount) * max(#purchase rows, 1),
    purchases = #invoices * #non-NULL purchase ids.
    """
    inv = (
        l2_invoice.where(F.col("paid_date").isNotNull())
        .groupBy("contract_id")
        .agg(exact_sum("amount_wo_vat").alias("__s"), F.count(F.lit(1)).alias("__n_inv"))
    )
    pp = l2_product_purchase.groupBy(F.col("contract_id").alias("__pc")).agg(
        F.count(F.lit(1)).alias("__n_pp"), F.count("product_purchase_id").alias("__n_ppid")
    )
    per = inv.join(pp, inv["contract_id"] == pp["__pc"], "left")
    fan = F.greatest(F.coalesce(F.col("__n_pp"), F.lit(0)), F.lit(1))
    return per.select(
        "contract_id",
        (F.col("__s") * fan).alias("total_revenue"),
        (F.col("__n_inv") * F.coalesce(F.col("__n_ppid"), F.lit(0))).alias("total_purchases"),
    )


def revenue_segments(
    l2_invoice: DataFrame,
    l2_product_purchase: DataFrame,
    percentiles: Sequence[float] = SEGMENT_PERCENTILES,
    labels: Sequence[str] = SEGMENT_LABELS,
) -> DataFrame:
    """Contracts in segments cut at global (interpolated) revenue percentiles.

    The cut points are selected exactly by the quantile operator and stand as
    numbers in the plan that tags the contracts.  Contracts are compared unrounded.
    The per-contract table is checkpointed (reliable, shared folder) because both
    the selection's passes and the tagging read it; nothing is sorted.
    """
    if len(labels) != len(percentiles) + 1:
        raise ValueError("need one more label than percentiles")
    # One row per paying contract, read twice below (cut points, tagging):
    # written once to the checkpoint folder so the invoice table is scanned once.
    per = revenue_per_paying_contract(l2_invoice, l2_product_purchase).checkpoint(eager=True)
    cuts = quantile_values(per, "total_revenue", percentiles, method="cont", reread=True)
    seg = None
    for cut, label in zip(cuts, labels[:-1]):
        cond = F.col("total_revenue") <= F.lit(cut)
        seg = F.when(cond, F.lit(label)) if seg is None else seg.when(cond, F.lit(label))
    tagged = per.withColumn("revenue_segment", seg.otherwise(F.lit(labels[-1])))
    # One row per contract already, so count(contract_id) = count(distinct contract_id).
    return (
        tagged.groupBy("revenue_segment")
        .agg(
            F.count("contract_id").alias("num_customers"),
            F.round(exact_sum("total_revenue")).cast("long").alias("total_revenue"),
            F.sum("total_purchases").cast("long").alias("total_purchases"),
        )
        .orderBy("revenue_segment")
    )
