"""L0 extracts derived from the provided TPC-H-style test tables.

The raw CRM / accounting extracts are not available, so every L0 source is a
deterministic, integer-only function of ``orders``, ``lineitem``, ``part``,
``nation`` (see FIXTURES.md section 3).  The same mapping is written as SQL in
:mod:`subledger.oracle` so an independent engine can build identical rows.

Grain: contract = order; purchase = line item; invoice = line item;
product = part; branch = nation.  No row of a table is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values of the mapping --------------------------------------------
# Days added to every test date (24 years) so they land around the report cut-offs.
DATE_SHIFT_DAYS = 8766
# UTC clock time of every generated timestamp; in summer it is the next day in Prague.
CLOCK_TIME = "INTERVAL '22:30' HOUR TO MINUTE"
# part.p_type first word -> product type; anything else is "product".
PART_TYPE_TO_PRODUCT_TYPE = {
    "ECONOMY": "product_trial",
    "STANDARD": "equipment",
    "SMALL": "rent",
    "PROMO": "service",
}
# line status -> (package / product status id, status name)
LINE_STATUS = {"O": (1, "active"), "F": (2, "closed")}
# any other line status
OTHER_STATUS = (3, "other")
# -----------------------------------------------------------------------------

TABLES = ("orders", "lineitem", "part", "nation")


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES}


def _at_clock(day: Column) -> Column:
    """UTC wall-clock timestamp of ``day`` at the fixed clock time."""
    return day.cast("timestamp_ntz") + F.expr(CLOCK_TIME)


def _shifted(ts_col: str) -> Column:
    return F.date_add(F.to_date(F.col(ts_col)), DATE_SHIFT_DAYS)


def _iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _contract_valid_to(k: Column, d0: Column) -> Column:
    """Contract end as text: open (NULL), the discontinuation day, or a spread date."""
    return (
        F.when(k % 3 == 0, F.lit(None).cast("string"))
        .when(k % 15 == 10, F.lit("2023-07-31"))
        .otherwise(_iso(F.date_add(d0, ((k * 53) % 1500).cast("int"))))
    )


def contract(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    d0 = _shifted("o_orderdate")
    return orders.select(
        k.alias("id_contract"),
        (F.col("o_custkey") % 25).alias("id_branch"),
        F.when(k % 50 == 49, F.lit(None)).otherwise(_at_clock(d0)).alias("date_contract_valid_from"),
        _contract_valid_to(k, d0).alias("date_contract_valid_to"),
        F.when(k % 20 == 7, F.lit(None)).otherwise(_at_clock(d0)).alias("date_registered"),
        _at_clock(d0).alias("date_signed"),
        _at_clock(F.date_add(d0, 1)).alias("activation_process_date"),
        F.when(k % 6 == 0, _at_clock(F.date_add(d0, 365))).alias("prolongation_date"),
        F.col("o_orderpriority").alias("registration_end_reason"),
        (k % 6 == 0).alias("flag_prolongation"),
        (k % 2 == 0).alias("flag_send_inv_email"),
        F.col("o_orderstatus").alias("contract_status"),
    )


def product_purchase(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    o = orders.select(
        F.col("o_orderkey"),
        _shifted("o_orderdate").alias("d0"),
    )
    li = lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_orderkey")
    ln = F.col("l_linenumber")
    st = F.date_add(F.col("d0"), (F.col("l_partkey") % 400).cast("int"))
    end = (
        F.when(ln == 6, F.lit(None).cast("string"))
        .when(ln == 5, F.lit("2035-12-31"))
        .when(ln.isin(1, 2), _contract_valid_to(k, F.col("d0")))
        .otherwise(_iso(F.date_add(st, F.floor(F.col("l_quantity") * 10).cast("int"))))
    )
    fee = (
        F.when((k % 30 == 3) | (ln == 7), F.lit(0.0))
        .when(F.col("l_returnflag") == "A", F.col("l_extendedprice") * F.lit(0.5))
        .when(F.col("l_partkey") % 101 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("l_extendedprice"))
    )
    return li.select(
        (k * 10 + ln).alias("id_package"),
        k.alias("id_contract"),
        F.col("l_partkey").alias("id_package_template"),
        _at_clock(st).alias("date_insert"),
        _iso(st).alias("start_date"),
        end.alias("end_date"),
        fee.alias("fee"),
        _at_clock(F.date_add(st, 1)).alias("date_update"),
        _status_id(F.col("l_linestatus")).alias("package_status"),
    )


def invoice(lineitem: DataFrame) -> DataFrame:
    k = F.col("l_orderkey")
    ln = F.col("l_linenumber")
    pk = F.col("l_partkey")
    iss = _shifted("l_shipdate")
    value = (
        F.when(pk % 25 == 0, F.lit(0.0))
        .when(pk % 40 == 1, -F.col("l_extendedprice"))
        .otherwise(F.col("l_extendedprice"))
    )
    inv_type = F.when((ln == 7) | ((F.col("l_returnflag") == "R") & (ln % 2 == 0)), 2).when(ln == 6, 3).when(ln == 5, 4).otherwise(1)
    status = (
        F.when(pk % 97 == 0, F.lit(None).cast("int"))
        .when((F.col("l_linestatus") == "O") & (pk % 4 == 0), 100)
        .otherwise(50)
    )
    return lineitem.select(
        (k * 10 + ln).alias("id_invoice"),
        F.when(k % 10 == 0, F.lit(None).cast("long")).otherwise(k).alias("id_invoice_old"),
        k.alias("invoice_id_contract"),
        _at_clock(iss).alias("date"),
        _at_clock(F.date_add(iss, 14)).alias("scadent"),
        F.when(k % 8 == 0, F.lit(None)).otherwise(_at_clock(F.date_add(iss, (pk % 30).cast("int")))).alias("date_paid"),
        _at_clock(iss).alias("start_date"),
        F.when(pk % 41 == 0, F.lit(None)).otherwise(_at_clock(F.date_add(iss, 30))).alias("end_date"),
        value.alias("value"),
        inv_type.alias("invoice_type"),
        F.col("l_discount").alias("value_storno"),
        _at_clock(iss).alias("date_insert"),
        status.alias("status"),
        _at_clock(F.date_add(iss, 1)).alias("date_update"),
        (F.col("l_suppkey") % 25).alias("id_branch"),
    )


def all_products(part: DataFrame) -> DataFrame:
    first_word = F.split(F.col("p_type"), " ").getItem(0)
    ptype = F.lit("product")
    for word, label in reversed(list(PART_TYPE_TO_PRODUCT_TYPE.items())):
        ptype = F.when(first_word == word, label).otherwise(ptype)
    category = (
        F.when(F.col("p_partkey") % 7 == 6, "other").when(first_word == "SMALL", "rent").otherwise("product")
    )
    return part.select(
        F.col("p_partkey").alias("id_product"),
        F.col("p_name").alias("name"),
        ptype.alias("type"),
        category.alias("category"),
    )


def _status_id(code: Column) -> Column:
    sid = F.lit(OTHER_STATUS[0])
    for c, (i, _) in LINE_STATUS.items():
        sid = F.when(code == c, F.lit(i)).otherwise(sid)
    return sid


def status(lineitem: DataFrame) -> DataFrame:
    """Status dimension: one row per line status present in the data."""
    name = F.lit(OTHER_STATUS[1])
    for c, (_, label) in LINE_STATUS.items():
        name = F.when(F.col("l_linestatus") == c, F.lit(label)).otherwise(name)
    return lineitem.select(_status_id(F.col("l_linestatus")).alias("id_status"), name.alias("status_name")).distinct()


def branch(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("long").alias("id_branch"),
        F.col("n_name").alias("branch_name"),
    )


def l0_from_tables(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All seven L0 sources from the test tables (lazy)."""
    inv = invoice(t["lineitem"])
    return {
        "invoice": inv,
        "invoice_load": inv,
        "contract": contract(t["orders"]),
        "product_purchase": product_purchase(t["lineitem"], t["orders"]),
        "status": status(t["lineitem"]),
        "all_products": all_products(t["part"]),
        "branch": branch(t["nation"]),
    }


def l0_from_testdata(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return l0_from_tables(read_tables(spark, sf_dir))
