"""Column-level building blocks: built-in Spark expressions only (no UDFs)."""

from subledger.functions.columns import (
    business_date,
    business_date_of_text,
    duration_bin,
    exact_sum,
    flag,
    invoice_type_label,
    net_of_vat,
    rounded,
    safe_corr,
    utc_ntz_of_text,
    with_vat,
)

__all__ = [
    "business_date",
    "business_date_of_text",
    "duration_bin",
    "exact_sum",
    "flag",
    "invoice_type_label",
    "net_of_vat",
    "rounded",
    "safe_corr",
    "utc_ntz_of_text",
    "with_vat",
]
