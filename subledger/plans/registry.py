"""Every statement of the warehouse as a named query over a ``Warehouse``.

Keys follow the layers: L0 sources, L1 checks and views, L2 tables and
layer count checks, L3 tables and reports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.operators import quality
from subledger.plans.reports import behavior, buying, churn
from subledger.plans.warehouse import Warehouse

Query = Callable[[Warehouse], DataFrame]

QUERIES: dict[str, Query] = {
    # L0 sources
    "l0_invoice": lambda w: w.l0["invoice"],
    "l0_invoice_load": lambda w: w.l0["invoice_load"],
    "l0_contract": lambda w: w.l0["contract"],
    "l0_product_purchase": lambda w: w.l0["product_purchase"],
    "l0_status": lambda w: w.l0["status"],
    "l0_all_products": lambda w: w.l0["all_products"],
    "l0_branch": lambda w: w.l0["branch"],
    # L1 checks and views
    "check_contract_duplicates": lambda w: quality.duplicate_keys(w.l1_contract, "contract_id"),
    "check_contract_null_key": lambda w: w.check_null_contracts(),
    "l1_contract": lambda w: w.l1_contract,
    "l1_product": lambda w: w.l1_product,
    "l1_product_status": lambda w: w.l1_product_status,
    "l1_product_purchase": lambda w: w.l1_product_purchase,
    "check_invoice_null_key": lambda w: w.check_null_invoices(),
    "check_invoice_duplicates": lambda w: quality.duplicate_keys(w.l0["invoice"], "id_invoice"),
    "invoice_deduplicated": lambda w: quality.dedupe_by_key(w.l0["invoice"], "id_invoice"),
    "check_invoice_old_duplicates": lambda w: quality.duplicate_keys(w.l0["invoice"], "id_invoice_old").orderBy(
        F.col("cnt").desc(), F.col("id_invoice_old").asc()
    ),
    "l1_invoice": lambda w: w.l1_invoice,
    # L2 tables and count checks
    "l2_contract": lambda w: w.l2_contract,
    "check_counts_contract": lambda w: w.check_counts("contract"),
    "l2_invoice": lambda w: w.l2_invoice,
    "check_counts_invoice": lambda w: w.check_counts("invoice"),
    "l2_product": lambda w: w.l2_product,
    "check_counts_product": lambda w: w.check_counts("product"),
    "l2_product_purchase": lambda w: w.l2_product_purchase,
    # L3 tables
    "l3_invoice": lambda w: w.l3_invoice,
    "l3_pp_product_contract": lambda w: w.l3_pp_product_contract,
    "pp_contract_rowcount": lambda w: churn.pp_contract_rowcount(w.l3_pp_product_contract),
    "contract_duration_bins_v1": lambda w: churn.contract_duration_bins_v1(w.l3_pp_product_contract),
    # 1. buying behaviour
    "avg_revenue_per_customer": lambda w: buying.avg_revenue_per_customer(w.l3_invoice),
    "median_revenue_single_row": lambda w: buying.median_revenue_single_row(w.l2_invoice_rows),
    "revenue_segments": lambda w: buying.revenue_segments(w.l2_invoice_rows, w.l2_product_purchase),
    # 2. customer churn
    "customers_churned": lambda w: churn.customers_churned(w.l3_pp_contract),
    "churned_multi_product_top50": lambda w: churn.churned_multi_product_top(w.l3_pp_contract),
    "unique_contracts": lambda w: churn.unique_contracts(w.l1_contract),
    "trial_customers": lambda w: churn.trial_customers(w.l2_product_purchase, w.l2_contract),
    "non_trial_customers": lambda w: churn.non_trial_customers(w.l2_product_purchase, w.l2_contract),
    "continued_after_trial": lambda w: churn.continued_after_trial(w.l3_pp_product_contract),
    "churn_same_day_vs_kept": lambda w: churn.churn_same_day_vs_kept(w.l3_pp_product_contract),
    "churn_with_other_products": lambda w: churn.churn_with_other_products(w.l3_pp_product_contract),
    "churned_equipment_other_types": lambda w: churn.churned_equipment_other_types(w.l3_pp_product_contract),
    "contract_duration_bins": lambda w: churn.contract_duration_bins(w.l3_pp_product_contract),
    "trial_then_other_rows": lambda w: churn.trial_then_other_rows(w.l3_pp_contract),
    "trial_then_other_revenue": lambda w: churn.trial_then_other_revenue(w.l3_pp_contract),
    "trial_revenue": lambda w: churn.trial_revenue(w.l3_pp_contract),
    "top_cancel_dates": lambda w: churn.top_cancel_dates(w.l2_contract),
    "avg_cancellations_per_day": lambda w: churn.avg_cancellations_per_day(w.l2_contract),
    "lost_after_discontinuation": lambda w: churn.lost_after_discontinuation(w.l3_pp_product_contract),
    "products_ended_with_contract": lambda w: churn.products_ended_with_contract(w.l3_pp_product_contract),
    "top_product_end_dates": lambda w: churn.top_product_end_dates(w.l3_pp_product_contract),
    "last_invoice_end_dates": lambda w: churn.last_invoice_end_dates(w.l2_invoice),
    "end_date_by_invoice_order": lambda w: churn.end_date_by_invoice_order(w.l2_invoice),
    "median_contract_duration": lambda w: churn.median_contract_duration(w.l3_pp_contract),
    # 3. customer behaviour
    "top_spenders": lambda w: behavior.top_spenders(w.l2_invoice_rows),
    "invoice_amount_quartiles": lambda w: behavior.invoice_amount_quartiles(w.l2_invoice_rows),
    "avg_invoice_amount": lambda w: behavior.avg_invoice_amount(w.l2_invoice_rows),
    "avg_purchase_price": lambda w: behavior.avg_purchase_price(w.l2_product_purchase),
    "zero_paying_customers": lambda w: behavior.zero_paying_customers(w.l2_product_purchase, w.l2_contract),
    "avg_invoices_per_customer": lambda w: behavior.avg_invoices_per_customer(w.l2_invoice_rows),
    "revenue_per_customer_quartiles": lambda w: behavior.revenue_per_customer_quartiles(w.l2_invoice_rows),
    "invoice_count_quartiles": lambda w: behavior.invoice_count_quartiles(w.l2_invoice_rows),
    "corr_invoices_revenue": lambda w: behavior.corr_invoices_revenue(w.l2_invoice_rows),
    "corr_invoices_products": lambda w: behavior.corr_invoices_products(w.l2_invoice_rows, w.l2_product_purchase),
    "corr_invoices_purchases": lambda w: behavior.corr_invoices_purchases(w.l2_invoice_rows, w.l2_product_purchase),
    "corr_revenue_products": lambda w: behavior.corr_revenue_products(w.l2_invoice_rows, w.l2_product_purchase),
    "free_product_types": lambda w: behavior.free_product_types(w.l2_product_purchase),
    "revenue_per_customer_by_type": lambda w: behavior.revenue_per_customer_by_type(w.l2_product_purchase),
    "avg_trial_duration": lambda w: behavior.avg_trial_duration(w.l2_product_purchase),
    "avg_days_to_equipment": lambda w: behavior.avg_days_to_equipment(w.l3_pp_product_contract),
    "customers_per_year": lambda w: behavior.customers_per_year(w.l3_pp_product_contract),
}
