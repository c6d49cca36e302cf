"""L1 cleaning views, L2 business tables and the two L3 base tables.

Each function maps DataFrames to a DataFrame and stays lazy; Catalyst sees
the whole chain from the source scan to the report, so filters and column
pruning reach the files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.constants import (
    BUSINESS_TZ,
    ISSUED_STATUS_LIMIT,
    SOLD_CATEGORIES,
    UNLIMITED_END_DATE,
    VAT_RATE,
)
from subledger.functions import (
    business_date,
    business_date_of_text,
    exact_sum,
    flag,
    invoice_type_label,
    net_of_vat,
    with_vat,
)
from subledger.operators.broadcasts import broadcast_if_small
from subledger.operators.running import hot_rows_setting, row_position

# ----------------------------------------------------------------- L1 views


def l1_contract(contract: DataFrame, tz: str = BUSINESS_TZ) -> DataFrame:
    return contract.select(
        F.col("id_contract").alias("contract_id"),
        F.col("id_branch").alias("branch_id"),
        business_date("date_contract_valid_from", tz).alias("contract_valid_from"),
        business_date_of_text("date_contract_valid_to", tz).alias("contract_valid_to"),
        business_date("date_registered", tz).alias("registered_date"),
        business_date("date_signed", tz).alias("signed_date"),
        business_date("activation_process_date", tz).alias("activation_process_date"),
        business_date("prolongation_date", tz).alias("prolongation_date"),
        F.col("registration_end_reason"),
        F.col("flag_prolongation"),
        F.col("flag_send_inv_email").alias("flag_sent_email"),
        F.col("contract_status"),
    )


def l1_product(all_products: DataFrame) -> DataFrame:
    """DISTINCT over all four columns, so a product id can still repeat."""
    return all_products.select(
        F.col("id_product").alias("product_id"),
        F.col("name").alias("product_name"),
        F.col("type").alias("product_type"),
        F.col("category").alias("product_category"),
    ).distinct()


def l1_product_status(status: DataFrame) -> DataFrame:
    return status.select(
        F.col("id_status").alias("product_status_id"),
        F.col("status_name").alias("product_status_name"),
    )


def l1_product_purchase(
    product_purchase: DataFrame,
    product_status: DataFrame,
    product: DataFrame,
    tz: str = BUSINESS_TZ,
) -> DataFrame:
    """Purchases LEFT JOIN status LEFT JOIN product (fan-out on repeated ids kept).

    A status id has a handful of values, so a shuffle of the purchases on it
    would land in a handful of tasks: the status catalog is broadcast after a
    count of its rows, and only a catalog beyond the bound is shuffled.  The
    product catalog is left to the planner and its measured size.
    """
    pp = product_purchase.alias("pp")
    ps = broadcast_if_small(product_status).alias("ps")
    p = product.alias("p")
    return (
        pp.join(ps, F.col("pp.package_status") == F.col("ps.product_status_id"), "left")
        .join(p, F.col("pp.id_package_template") == F.col("p.product_id"), "left")
        .select(
            F.col("pp.id_package").alias("product_purchase_id"),
            F.col("pp.id_contract").alias("contract_id"),
            F.col("pp.id_package_template").alias("product_id"),
            business_date(F.col("pp.date_insert"), tz).alias("create_date"),
            business_date_of_text(F.col("pp.start_date"), tz).alias("product_valid_from"),
            business_date_of_text(F.col("pp.end_date"), tz).alias("product_valid_to"),
            F.col("pp.fee").alias("price_wo_vat"),
            business_date(F.col("pp.date_update"), tz).alias("date_update"),
            F.col("pp.package_status").alias("product_status_id"),
            F.col("ps.product_status_name").alias("product_status"),
            F.col("p.product_name"),
            F.col("p.product_type"),
            F.col("p.product_category"),
        )
    )


def l1_invoice(invoice: DataFrame, tz: str = BUSINESS_TZ, issued_below: int = ISSUED_STATUS_LIMIT) -> DataFrame:
    """Invoice view: not deduplicated (duplicate ids are only reported)."""
    return invoice.select(
        F.col("id_invoice").alias("invoice_id"),
        F.col("id_invoice_old").alias("invoice_previous_id"),
        F.col("invoice_id_contract").alias("contract_id"),
        business_date("date", tz).alias("date_issue"),
        business_date("scadent", tz).alias("due_date"),
        business_date("date_paid", tz).alias("paid_date"),
        business_date("start_date", tz).alias("start_date"),
        business_date("end_date", tz).alias("end_date"),
        F.col("value").alias("amount_w_vat"),
        F.col("invoice_type").alias("invoice_type_id"),
        invoice_type_label("invoice_type").alias("invoice_type"),
        F.col("value_storno").alias("return_w_vat"),
        business_date("date_insert", tz).alias("date_insert"),
        F.col("status").alias("invoice_status_id"),
        flag(F.col("status") < issued_below).alias("flag_invoice_issued"),
        business_date("date_update", tz).alias("update_date"),
        F.col("id_branch").alias("branch_id"),
    )


# --------------------------------------------------------------- L2 tables

L2_CONTRACT_COLUMNS = (
    "contract_id",
    "branch_id",
    "contract_valid_from",
    "contract_valid_to",
    "registered_date",
    "signed_date",
    "activation_process_date",
    "prolongation_date",
    "registration_end_reason",
    "flag_prolongation",
    "flag_sent_email",
    "contract_status",
)


def l2_contract(l1_contract_df: DataFrame) -> DataFrame:
    return l1_contract_df.where(F.col("registered_date").isNotNull()).select(*L2_CONTRACT_COLUMNS)


# Order of an invoice within its contract: issue date, then tie-breaks so
# equal issue dates are numbered the same way on every run.
INVOICE_ORDER_KEYS = (
    "date_issue",
    "invoice_id",
    "due_date",
    "paid_date",
    "start_date",
    "end_date",
    "amount_w_vat",
    "date_insert",
    "update_date",
    "branch_id",
)


def l2_invoice_rows(l1_invoice_df: DataFrame, l2_contract_df: DataFrame, vat_rate: float = VAT_RATE) -> DataFrame:
    """Issued invoices of L2 contracts, net of VAT, not yet numbered.

    Inner join on contract id; repeated contract rows fan out, as in SQL.  Most
    reports read these rows and never pay for the numbering.
    """
    inv = l1_invoice_df.where((F.col("invoice_type") == "invoice") & F.col("flag_invoice_issued"))
    c = l2_contract_df.select(F.col("contract_id").alias("__c_id"))
    return inv.join(c, inv["contract_id"] == c["__c_id"], "inner").select(
        "invoice_id",
        "contract_id",
        "date_issue",
        "due_date",
        "paid_date",
        "start_date",
        "end_date",
        "amount_w_vat",
        net_of_vat("amount_w_vat", vat_rate).alias("amount_wo_vat"),
        "date_insert",
        "update_date",
        "branch_id",
    )


def l2_invoice(l1_invoice_df: DataFrame, l2_contract_df: DataFrame, vat_rate: float = VAT_RATE, hot_rows: int | None = None) -> DataFrame:
    """:func:`l2_invoice_rows` with ``invoice_order``, the invoice's number within its contract.

    The probe counts joined rows (invoices times contract rows) per contract
    from two slim aggregations, so neither repeated contract rows nor invoices
    that the join drops mislead it.  Contracts over ``hot_rows`` rows are
    numbered on the range-partitioned path of :mod:`subledger.operators.running`;
    without any, the numbering is one window that reuses the join's partitioning.
    """
    rows = l2_invoice_rows(l1_invoice_df, l2_contract_df, vat_rate)
    limit = hot_rows_setting(rows) if hot_rows is None else hot_rows
    inv = l1_invoice_df.where((F.col("invoice_type") == "invoice") & F.col("flag_invoice_issued") & F.col("contract_id").isNotNull())
    n_inv = inv.groupBy("contract_id").agg(F.count(F.lit(1)).alias("__n_inv"))
    n_con = l2_contract_df.groupBy(F.col("contract_id").alias("__c_id")).agg(F.count(F.lit(1)).alias("__n_con"))
    hot = n_inv.join(n_con, n_inv["contract_id"] == n_con["__c_id"], "inner")
    hot = hot.where(F.col("__n_inv") * F.col("__n_con") > limit).select("contract_id")
    order = [F.col(c).asc_nulls_first() for c in INVOICE_ORDER_KEYS]
    return row_position(rows, ["contract_id"], order, "invoice_order", hot_keys=None if hot.isEmpty() else hot)


def l2_product(l1_product_df: DataFrame, categories: Sequence[str] = SOLD_CATEGORIES) -> DataFrame:
    return l1_product_df.where(F.col("product_category").isin(*categories)).select(
        "product_id", "product_name", "product_type", "product_category"
    )


def l2_product_purchase(
    l1_product_purchase_df: DataFrame,
    l2_product_df: DataFrame,
    categories: Sequence[str] = SOLD_CATEGORIES,
    vat_rate: float = VAT_RATE,
    unlimited_end: dt.date = UNLIMITED_END_DATE,
) -> DataFrame:
    keep = l2_product_df.select(F.col("product_id").alias("__p_id"))
    pp = l1_product_purchase_df.where(F.col("product_category").isin(*categories))
    pp = pp.join(keep, pp["product_id"] == keep["__p_id"], "left_semi")
    return pp.select(
        "product_purchase_id",
        "contract_id",
        "product_id",
        "create_date",
        "product_valid_from",
        "product_valid_to",
        "price_wo_vat",
        with_vat("price_wo_vat", vat_rate).alias("price_w_vat"),
        "date_update",
        "product_name",
        "product_type",
        flag(F.col("product_valid_to") == F.lit(unlimited_end)).alias("flag_unlimited_product"),
    )


# ------------------------------------------------------------ L3 base tables


def l3_invoice(l2_invoice_df: DataFrame) -> DataFrame:
    """Revenue per contract from paid invoices (stored unrounded)."""
    return (
        l2_invoice_df.where(F.col("paid_date").isNotNull())
        .groupBy("contract_id")
        .agg(exact_sum("amount_wo_vat").alias("rev_per_contract"))
    )


def l3_pp_product_contract(l2_product_purchase_df: DataFrame, l2_contract_df: DataFrame) -> DataFrame:
    """Every L2 purchase with its contract's dates; lifetimes in days."""
    pp = l2_product_purchase_df.alias("pp")
    c = l2_contract_df.alias("c")
    return pp.join(c, F.col("pp.contract_id") == F.col("c.contract_id"), "inner").select(
        F.col("pp.product_purchase_id"),
        F.col("pp.contract_id"),
        F.col("pp.product_id"),
        F.col("pp.product_valid_from"),
        F.col("pp.product_valid_to"),
        F.datediff(F.col("pp.product_valid_to"), F.col("pp.product_valid_from")).alias("product_life"),
        F.col("pp.price_wo_vat"),
        F.col("pp.product_name"),
        F.col("pp.product_type"),
        F.col("c.contract_valid_from"),
        F.col("c.contract_valid_to"),
        F.datediff(F.col("c.contract_valid_to"), F.col("c.contract_valid_from")).alias("contract_duration"),
        F.col("c.prolongation_date"),
        F.col("c.contract_status"),
    )


def l3_pp_contract(l3_pp_product_contract_df: DataFrame) -> DataFrame:
    """The purchase-contract table under the name the churn reports read.

    The reports order by ``product_lifecycle``; it is ``product_life``.
    """
    return l3_pp_product_contract_df.withColumn("product_lifecycle", F.col("product_life"))
