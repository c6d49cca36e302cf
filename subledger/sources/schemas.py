"""Explicit L0 schemas: one StructType per source extract.

Timestamps are ``TimestampNTZType`` holding UTC wall-clock time, so turning
them into business dates never depends on the session time zone.  Date-only
fields the source ships as text stay strings and are parsed in L1.
"""

from pyspark.sql import types as T

_TS = T.TimestampNTZType()
_L = T.LongType()
_S = T.StringType()


def _schema(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


INVOICE = _schema(
    ("id_invoice", _L),
    ("id_invoice_old", _L),
    ("invoice_id_contract", _L),
    ("date", _TS),
    ("scadent", _TS),
    ("date_paid", _TS),
    ("start_date", _TS),
    ("end_date", _TS),
    ("value", T.DoubleType()),
    ("invoice_type", T.IntegerType()),
    ("value_storno", T.DoubleType()),
    ("date_insert", _TS),
    ("status", T.IntegerType()),
    ("date_update", _TS),
    ("id_branch", _L),
)

# The load extract has the invoice layout.
INVOICE_LOAD = INVOICE

CONTRACT = _schema(
    ("id_contract", _L),
    ("id_branch", _L),
    ("date_contract_valid_from", _TS),
    ("date_contract_valid_to", _S),
    ("date_registered", _TS),
    ("date_signed", _TS),
    ("activation_process_date", _TS),
    ("prolongation_date", _TS),
    ("registration_end_reason", _S),
    ("flag_prolongation", T.BooleanType()),
    ("flag_send_inv_email", T.BooleanType()),
    ("contract_status", _S),
)

PRODUCT_PURCHASE = _schema(
    ("id_package", _L),
    ("id_contract", _L),
    ("id_package_template", _L),
    ("date_insert", _TS),
    ("start_date", _S),
    ("end_date", _S),
    ("fee", T.DoubleType()),
    ("date_update", _TS),
    ("package_status", T.IntegerType()),
)

STATUS = _schema(("id_status", T.IntegerType()), ("status_name", _S))

ALL_PRODUCTS = _schema(("id_product", _L), ("name", _S), ("type", _S), ("category", _S))

BRANCH = _schema(("id_branch", _L), ("branch_name", _S))

# Source name -> schema, in L0 order.
L0_SCHEMAS = {
    "invoice": INVOICE,
    "invoice_load": INVOICE_LOAD,
    "contract": CONTRACT,
    "product_purchase": PRODUCT_PURCHASE,
    "status": STATUS,
    "all_products": ALL_PRODUCTS,
    "branch": BRANCH,
}
