"""Customer behaviour: spend distribution, invoice counts, correlations, types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.constants import EQUIPMENT_TYPE, RESULT_DIGITS, TOP_SPENDERS, TRIAL_TYPE
from subledger.functions import exact_sum, rounded, safe_corr
from subledger.operators.idsets import distinct_ids
from subledger.operators.quantiles import quantiles

QUARTILE_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)
QUARTILE_NAMES = ("q0", "q1", "q2", "q3", "q4")


def _paid(l2_invoice: DataFrame) -> DataFrame:
    return l2_invoice.where(F.col("paid_date").isNotNull())


def top_spenders(l2_invoice: DataFrame, top: int = TOP_SPENDERS, digits: int | None = RESULT_DIGITS) -> DataFrame:
    per = _paid(l2_invoice).groupBy("contract_id").agg(exact_sum("amount_wo_vat").alias("sum"))
    ranked = per.orderBy(F.col("sum").desc_nulls_last(), F.col("contract_id").asc()).limit(top)
    return ranked.select("contract_id", rounded("sum", digits).alias("sum"))


def invoice_amount_quartiles(l2_invoice: DataFrame) -> DataFrame:
    """Min, quartiles and max of paid invoice amounts (exact nearest rank)."""
    return quantiles(_paid(l2_invoice), "amount_wo_vat", QUARTILE_PROBS, QUARTILE_NAMES, method="disc")


def avg_invoice_amount(l2_invoice: DataFrame, digits: int | None = RESULT_DIGITS) -> DataFrame:
    return l2_invoice.agg(rounded(F.try_divide(exact_sum("amount_wo_vat"), F.count("amount_wo_vat")), digits).alias("avg_amount_wo_vat"))


def avg_purchase_price(l2_product_purchase: DataFrame, digits: int | None = RESULT_DIGITS) -> DataFrame:
    return l2_product_purchase.where(F.col("price_wo_vat") > 0).agg(
        rounded(F.try_divide(exact_sum("price_wo_vat"), F.count("price_wo_vat")), digits).alias("avg_price_wo_vat")
    )


def zero_paying_customers(l2_product_purchase: DataFrame, l2_contract: DataFrame) -> DataFrame:
    """Purchase rows x open contract rows, for contracts that only ever paid 0.

    ``contract_id IN (price = 0) AND contract_id NOT IN (price > 0)``, then an
    inner join with open L2 contracts, counted.  Everything is per-contract
    counting: purchase rows and flags per contract, open contract rows per
    contract, and their product summed.  ``NOT IN`` keeps its NULL rule: a
    paying row without a contract id empties the result.
    """
    price = F.col("price_wo_vat")
    per = l2_product_purchase.where(F.col("contract_id").isNotNull()).groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count_if(price == 0).alias("__zero"),
        F.count_if(price > 0).alias("__paid"),
    )
    paid_without_id = l2_product_purchase.agg(
        F.count_if((price > 0) & F.col("contract_id").isNull()).alias("__paid_null")
    )
    only_zero = per.where((F.col("__zero") > 0) & (F.col("__paid") == 0))
    only_zero = only_zero.crossJoin(F.broadcast(paid_without_id)).where(F.col("__paid_null") == 0)
    open_c = (
        l2_contract.where(F.col("contract_valid_to").isNull() & F.col("contract_id").isNotNull())
        .groupBy(F.col("contract_id").alias("__oc"))
        .agg(F.count(F.lit(1)).alias("__open"))
    )
    joined = only_zero.join(open_c, only_zero["contract_id"] == open_c["__oc"], "inner")
    return joined.agg(F.coalesce(F.sum(F.col("__rows") * F.col("__open")), F.lit(0)).cast("long").alias("cnt"))


def _invoices_per_contract(l2_invoice: DataFrame) -> DataFrame:
    return l2_invoice.groupBy("contract_id").agg(
        F.count("invoice_id").alias("num_invoices"),
        exact_sum("amount_wo_vat").alias("total_amount_wo_vat"),
    )


def avg_invoices_per_customer(l2_invoice: DataFrame, digits: int | None = RESULT_DIGITS) -> DataFrame:
    return _invoices_per_contract(l2_invoice).agg(rounded(F.avg("num_invoices"), digits).alias("avg_invoices"))


def revenue_per_customer_quartiles(l2_invoice: DataFrame, digits: int | None = RESULT_DIGITS) -> DataFrame:
    per = _invoices_per_contract(l2_invoice)
    q = quantiles(per, "total_amount_wo_vat", QUARTILE_PROBS, QUARTILE_NAMES, method="disc")
    return q.select(*[rounded(n, digits).alias(n) for n in QUARTILE_NAMES])


def invoice_count_quartiles(l2_invoice: DataFrame) -> DataFrame:
    per = _invoices_per_contract(l2_invoice)
    return quantiles(per, "num_invoices", QUARTILE_PROBS, QUARTILE_NAMES, method="disc")


def corr_invoices_revenue(l2_invoice: DataFrame, digits: int | None = RESULT_DIGITS) -> DataFrame:
    per = _invoices_per_contract(l2_invoice)
    return per.agg(rounded(safe_corr("num_invoices", "total_amount_wo_vat"), digits).alias("correlation"))


def _purchases_per_contract(l2_product_purchase: DataFrame) -> DataFrame:
    return l2_product_purchase.groupBy(F.col("contract_id").alias("__pc")).agg(
        F.count("product_id").alias("num_products"),
        F.count("product_purchase_id").alias("num_pp"),
    )


def _corr_with_purchases(l2_invoice, l2_product_purchase, x: str, y: str, digits) -> DataFrame:
    inv = _invoices_per_contract(l2_invoice)
    pp = _purchases_per_contract(l2_product_purchase)
    both = inv.join(pp, inv["contract_id"] == pp["__pc"], "inner")
    return both.agg(rounded(safe_corr(x, y), digits).alias("correlation"))


def corr_invoices_products(l2_invoice, l2_product_purchase, digits: int | None = RESULT_DIGITS) -> DataFrame:
    return _corr_with_purchases(l2_invoice, l2_product_purchase, "num_invoices", "num_products", digits)


def corr_invoices_purchases(l2_invoice, l2_product_purchase, digits: int | None = RESULT_DIGITS) -> DataFrame:
    return _corr_with_purchases(l2_invoice, l2_product_purchase, "num_invoices", "num_pp", digits)


def corr_revenue_products(l2_invoice, l2_product_purchase, digits: int | None = RESULT_DIGITS) -> DataFrame:
    return _corr_with_purchases(l2_invoice, l2_product_purchase, "total_amount_wo_vat", "num_products", digits)


def free_product_types(l2_product_purchase: DataFrame) -> DataFrame:
    return l2_product_purchase.where(F.col("price_wo_vat") == 0).select("product_type").distinct()


def revenue_per_customer_by_type(l2_product_purchase: DataFrame, digits: int | None = RESULT_DIGITS) -> DataFrame:
    """sum(price) / count(contract ids) per product type; NULL types drop out (inner join)."""
    return (
        l2_product_purchase.where(F.col("product_type").isNotNull())
        .groupBy("product_type")
        .agg(rounded(F.try_divide(exact_sum("price_wo_vat"), F.count("contract_id")), digits).alias("rev_per_customer"))
    )


def avg_trial_duration(l2_product_purchase: DataFrame, trial_type: str = TRIAL_TYPE, digits: int | None = RESULT_DIGITS) -> DataFrame:
    rows = l2_product_purchase.where(F.col("product_type") == trial_type)
    return rows.agg(
        rounded(F.avg(F.datediff("product_valid_to", "product_valid_from")), digits).alias("avg_trial_days")
    )


def avg_days_to_equipment(
    l3_pp_product_contract: DataFrame, equipment_type: str = EQUIPMENT_TYPE, digits: int | None = RESULT_DIGITS
) -> DataFrame:
    rows = l3_pp_product_contract.where(
        (F.col("product_type") == equipment_type)
        & F.col("product_valid_from").isNotNull()
        & F.col("contract_valid_from").isNotNull()
    )
    return rows.agg(
        rounded(F.avg(F.datediff("product_valid_from", "contract_valid_from")), digits).alias("avg_days_after_contract")
    )


def customers_per_year(l3_pp_product_contract: DataFrame) -> DataFrame:
    rows = l3_pp_product_contract.where(F.col("contract_valid_from") < F.col("contract_valid_to"))
    return distinct_ids(rows, "contract_id", "customers", by=F.year("contract_valid_from").alias("year")).orderBy("year")
