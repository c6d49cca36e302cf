"""Oracle SQL for every registered query, runnable by DuckDB.

Each statement is stated directly in SQL over the same L0 mapping of the
test tables (``orders lineitem part nation`` views) -- plain joins,
``EXISTS`` / ``NOT EXISTS``, ``IN`` subqueries, window ranks -- and never
uses the Spark side's rewrites (per-contract flags, sweeps, range-partitioned
ranks), so agreement checks those rewrites.  Dialect notes: single-quoted
strings, explicit ``NULLS FIRST`` where Spark sorts NULLs first, doubles for
the VAT factor, explicit tie-breaks for every ordered limit.  Doubles are
summed as decimals and rounded in the last select only.  Bins, labels, cut
points, order keys and mappings are written out here, not imported.
"""

from __future__ import annotations

import re

# Written out here, not imported, so that a wrong constant of the library cannot agree with itself.
DURATION_BIN_BOUNDS = (30, 61, 91, 122, 152, 183, 365, 1230)
DURATION_BIN_LABELS_V1 = ("M1", "M2", "M3", "M4", "M5", "M6", "M6-M12", "Y2", "Y2+")
DURATION_BIN_LABELS = ("M1", "M2", "M3", "M4", "M5", "M6", "M6-M12", "Y1-Y2", "Y2+")
SEGMENT_PERCENTILES = (0.25, 0.50, 0.75)
SEGMENT_LABELS = (
    "Light spenders (bottom quartile)",
    "Moderate spenders (3rd quartile)",
    "Heavy spenders (2nd quartile)",
    "Superstars (top quartile)",
)
PART_TYPE_TO_PRODUCT_TYPE = {"ECONOMY": "product_trial", "STANDARD": "equipment", "SMALL": "rent", "PROMO": "service"}

D = 4  # digits of reported doubles, rounded in the last select only


def _total(x: str) -> str:
    """A sum of doubles that does not depend on the order of its terms."""
    return f"CAST(sum(CAST({x} AS DECIMAL(28, 8))) AS DOUBLE)"


def _at(day: str) -> str:
    return f"(CAST({day} AS TIMESTAMP) + INTERVAL '22 hours 30 minutes')"


def _iso(day: str) -> str:
    return f"strftime({day}, '%Y-%m-%d')"


def _valid_to(k: str, d0: str) -> str:
    return (
        f"CASE WHEN {k} % 3 = 0 THEN NULL WHEN {k} % 15 = 10 THEN '2023-07-31' "
        f"ELSE {_iso(f'({d0} + CAST(({k} * 53) % 1500 AS INTEGER))')} END"
    )


def _prague(ts: str) -> str:
    return f"CAST(timezone('Europe/Prague', timezone('UTC', {ts})) AS DATE)"


def _prague_text(s: str) -> str:
    return _prague(f"CAST({s} AS TIMESTAMP)")


def _bins(labels) -> str:
    parts = [f"WHEN contract_duration <= {b} THEN '{lab}'" for b, lab in zip(DURATION_BIN_BOUNDS, labels[:-1])]
    return "CASE " + " ".join(parts) + f" ELSE '{labels[-1]}' END"


_PTYPE = (
    "CASE "
    + " ".join(f"WHEN split_part(p_type, ' ', 1) = '{w}' THEN '{t}'" for w, t in PART_TYPE_TO_PRODUCT_TYPE.items())
    + " ELSE 'product' END"
)
_STATUS_ID = "CASE l_linestatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END"
_STATUS_NAME = "CASE l_linestatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'closed' ELSE 'other' END"
_D0 = "(CAST(o_orderdate AS DATE) + 8766)"
_ISS = "(CAST(l_shipdate AS DATE) + 8766)"
_ST = "(d0 + CAST(l_partkey % 400 AS INTEGER))"

# Named building blocks, in dependency order.  A query pulls in the ones it
# (transitively) mentions.
CTES: dict[str, str] = {}

CTES["l0_contract"] = f"""
SELECT o_orderkey AS id_contract,
       o_custkey % 25 AS id_branch,
       CASE WHEN o_orderkey % 50 = 49 THEN NULL ELSE {_at(_D0)} END AS date_contract_valid_from,
       {_valid_to('o_orderkey', _D0)} AS date_contract_valid_to,
       CASE WHEN o_orderkey % 20 = 7 THEN NULL ELSE {_at(_D0)} END AS date_registered,
       {_at(_D0)} AS date_signed,
       {_at(f'({_D0} + 1)')} AS activation_process_date,
       CASE WHEN o_orderkey % 6 = 0 THEN {_at(f'({_D0} + 365)')} END AS prolongation_date,
       o_orderpriority AS registration_end_reason,
       (o_orderkey % 6 = 0) AS flag_prolongation,
       (o_orderkey % 2 = 0) AS flag_send_inv_email,
       o_orderstatus AS contract_status
FROM orders"""

CTES["l0_product_purchase"] = f"""
SELECT l_orderkey * 10 + l_linenumber AS id_package,
       l_orderkey AS id_contract,
       l_partkey AS id_package_template,
       {_at(_ST)} AS date_insert,
       {_iso(_ST)} AS start_date,
       CASE WHEN l_linenumber = 6 THEN NULL
            WHEN l_linenumber = 5 THEN '2035-12-31'
            WHEN l_linenumber IN (1, 2) THEN {_valid_to('l_orderkey', 'd0')}
            ELSE {_iso(f'({_ST} + CAST(floor(l_quantity * 10) AS INTEGER))')} END AS end_date,
       CASE WHEN l_orderkey % 30 = 3 OR l_linenumber = 7 THEN CAST(0 AS DOUBLE)
            WHEN l_returnflag = 'A' THEN l_extendedprice * CAST(0.5 AS DOUBLE)
            WHEN l_partkey % 101 = 0 THEN NULL
            ELSE l_extendedprice END AS fee,
       {_at(f'({_ST} + 1)')} AS date_update,
       {_STATUS_ID} AS package_status
FROM lineitem JOIN (SELECT o_orderkey, {_D0} AS d0 FROM orders) o ON l_orderkey = o.o_orderkey"""

CTES["l0_invoice"] = f"""
SELECT l_orderkey * 10 + l_linenumber AS id_invoice,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_orderkey END AS id_invoice_old,
       l_orderkey AS invoice_id_contract,
       {_at(_ISS)} AS date,
       {_at(f'({_ISS} + 14)')} AS scadent,
       CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE {_at(f'({_ISS} + CAST(l_partkey % 30 AS INTEGER))')} END AS date_paid,
       {_at(_ISS)} AS start_date,
       CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE {_at(f'({_ISS} + 30)')} END AS end_date,
       CASE WHEN l_partkey % 25 = 0 THEN CAST(0 AS DOUBLE)
            WHEN l_partkey % 40 = 1 THEN -l_extendedprice
            ELSE l_extendedprice END AS value,
       CASE WHEN l_linenumber = 7 OR (l_returnflag = 'R' AND l_linenumber % 2 = 0) THEN 2
            WHEN l_linenumber = 6 THEN 3 WHEN l_linenumber = 5 THEN 4 ELSE 1 END AS invoice_type,
       l_discount AS value_storno,
       {_at(_ISS)} AS date_insert,
       CASE WHEN l_partkey % 97 = 0 THEN NULL
            WHEN l_linestatus = 'O' AND l_partkey % 4 = 0 THEN 100
            ELSE 50 END AS status,
       {_at(f'({_ISS} + 1)')} AS date_update,
       l_suppkey % 25 AS id_branch
FROM lineitem"""

CTES["l0_invoice_load"] = "SELECT * FROM l0_invoice"

CTES["l0_all_products"] = f"""
SELECT p_partkey AS id_product,
       p_name AS name,
       {_PTYPE} AS type,
       CASE WHEN p_partkey % 7 = 6 THEN 'other'
            WHEN split_part(p_type, ' ', 1) = 'SMALL' THEN 'rent'
            ELSE 'product' END AS category
FROM part"""

CTES["l0_status"] = f"""
SELECT DISTINCT {_STATUS_ID} AS id_status, {_STATUS_NAME} AS status_name
FROM lineitem"""

CTES["l0_branch"] = "SELECT CAST(n_nationkey AS BIGINT) AS id_branch, n_name AS branch_name FROM nation"

# ---------------------------------------------------------------- L1
CTES["l1_contract"] = f"""
SELECT id_contract AS contract_id,
       id_branch AS branch_id,
       {_prague('date_contract_valid_from')} AS contract_valid_from,
       {_prague_text('date_contract_valid_to')} AS contract_valid_to,
       {_prague('date_registered')} AS registered_date,
       {_prague('date_signed')} AS signed_date,
       {_prague('activation_process_date')} AS activation_process_date,
       {_prague('prolongation_date')} AS prolongation_date,
       registration_end_reason,
       flag_prolongation,
       flag_send_inv_email AS flag_sent_email,
       contract_status
FROM l0_contract"""

CTES["l1_product"] = """
SELECT DISTINCT id_product AS product_id, name AS product_name, type AS product_type, category AS product_category
FROM l0_all_products"""

CTES["l1_product_status"] = """
SELECT id_status AS product_status_id, status_name AS product_status_name FROM l0_status"""

CTES["l1_product_purchase"] = f"""
SELECT pp.id_package AS product_purchase_id,
       pp.id_contract AS contract_id,
       pp.id_package_template AS product_id,
       {_prague('pp.date_insert')} AS create_date,
       {_prague_text('pp.start_date')} AS product_valid_from,
       {_prague_text('pp.end_date')} AS product_valid_to,
       pp.fee AS price_wo_vat,
       {_prague('pp.date_update')} AS date_update,
       pp.package_status AS product_status_id,
       ps.product_status_name AS product_status,
       p.product_name,
       p.product_type,
       p.product_category
FROM l0_product_purchase pp
LEFT JOIN l1_product_status ps ON pp.package_status = ps.product_status_id
LEFT JOIN l1_product p ON pp.id_package_template = p.product_id"""

CTES["l1_invoice"] = f"""
SELECT id_invoice AS invoice_id,
       id_invoice_old AS invoice_previous_id,
       invoice_id_contract AS contract_id,
       {_prague('date')} AS date_issue,
       {_prague('scadent')} AS due_date,
       {_prague('date_paid')} AS paid_date,
       {_prague('start_date')} AS start_date,
       {_prague('end_date')} AS end_date,
       value AS amount_w_vat,
       invoice_type AS invoice_type_id,
       CASE WHEN invoice_type = 1 THEN 'invoice'
            WHEN invoice_type = 2 THEN 'return'
            WHEN invoice_type = 3 THEN 'credit_note'
            WHEN invoice_type = 4 THEN 'other' END AS invoice_type,
       value_storno AS return_w_vat,
       {_prague('date_insert')} AS date_insert,
       status AS invoice_status_id,
       CASE WHEN status < 100 THEN true ELSE false END AS flag_invoice_issued,
       {_prague('date_update')} AS update_date,
       id_branch AS branch_id
FROM l0_invoice"""

# ---------------------------------------------------------------- L2
CTES["l2_contract"] = """
SELECT contract_id, branch_id, contract_valid_from, contract_valid_to, registered_date, signed_date,
       activation_process_date, prolongation_date, registration_end_reason, flag_prolongation,
       flag_sent_email, contract_status
FROM l1_contract
WHERE registered_date IS NOT NULL"""

_ORDER = ", ".join(
    f"i.{c} ASC NULLS FIRST"
    for c in (
        "date_issue", "invoice_id", "due_date", "paid_date", "start_date", "end_date", "amount_w_vat", "date_insert",
        "update_date", "branch_id",
    )
)
CTES["l2_invoice"] = f"""
SELECT i.invoice_id, i.contract_id, i.date_issue, i.due_date, i.paid_date, i.start_date, i.end_date,
       i.amount_w_vat,
       CASE WHEN i.amount_w_vat <= 0 THEN CAST(0 AS DOUBLE)
            WHEN i.amount_w_vat > 0 THEN i.amount_w_vat / CAST(1.2 AS DOUBLE) END AS amount_wo_vat,
       i.date_insert, i.update_date, i.branch_id,
       row_number() OVER (PARTITION BY i.contract_id ORDER BY {_ORDER}) AS invoice_order
FROM l1_invoice i
JOIN l2_contract c ON i.contract_id = c.contract_id
WHERE i.invoice_type = 'invoice' AND i.flag_invoice_issued"""

CTES["l2_product"] = """
SELECT product_id, product_name, product_type, product_category
FROM l1_product
WHERE product_category IN ('product', 'rent')"""

CTES["l2_product_purchase"] = """
SELECT product_purchase_id, contract_id, product_id, create_date, product_valid_from, product_valid_to,
       price_wo_vat, price_wo_vat * CAST(1.2 AS DOUBLE) AS price_w_vat, date_update, product_name, product_type,
       CASE WHEN product_valid_to = DATE '2035-12-31' THEN true ELSE false END AS flag_unlimited_product
FROM l1_product_purchase u
WHERE u.product_category IN ('product', 'rent')
  AND EXISTS (SELECT 1 FROM l2_product q WHERE q.product_id = u.product_id)"""

# ---------------------------------------------------------------- L3 tables
CTES["l3_invoice"] = f"""
SELECT contract_id, {_total('amount_wo_vat')} AS rev_per_contract
FROM l2_invoice
WHERE paid_date IS NOT NULL
GROUP BY contract_id"""

CTES["l3_pp_product_contract"] = """
SELECT pp.product_purchase_id, pp.contract_id, pp.product_id, pp.product_valid_from, pp.product_valid_to,
       CAST(date_diff('day', pp.product_valid_from, pp.product_valid_to) AS INTEGER) AS product_life,
       pp.price_wo_vat, pp.product_name, pp.product_type, c.contract_valid_from, c.contract_valid_to,
       CAST(date_diff('day', c.contract_valid_from, c.contract_valid_to) AS INTEGER) AS contract_duration,
       c.prolongation_date, c.contract_status
FROM l2_product_purchase pp
JOIN l2_contract c ON pp.contract_id = c.contract_id"""

CTES["l3_pp_contract"] = "SELECT *, product_life AS product_lifecycle FROM l3_pp_product_contract"

# ------------------------------------------------------- per-query helpers
CTES["q7_per_contract"] = f"""
SELECT i.contract_id,
       {_total('i.amount_wo_vat')} AS total_revenue,
       count(p.product_purchase_id) AS total_purchases
FROM l2_invoice i
LEFT JOIN l2_product_purchase p ON p.contract_id = i.contract_id
WHERE i.paid_date IS NOT NULL
GROUP BY i.contract_id"""

CTES["q7_ranked"] = """
SELECT total_revenue AS v, row_number() OVER (ORDER BY total_revenue) AS rn, count(*) OVER () AS n
FROM q7_per_contract WHERE total_revenue IS NOT NULL"""


def _cont_cut(p: float) -> str:
    n = "(SELECT max(n) FROM q7_ranked)"
    pos = f"(CAST({p!r} AS DOUBLE) * ({n} - 1))"
    lo = f"(SELECT v FROM q7_ranked WHERE rn = floor({pos}) + 1)"
    hi = f"(SELECT v FROM q7_ranked WHERE rn = ceil({pos}) + 1)"
    return f"({lo} + ({hi} - {lo}) * ({pos} - floor({pos})))"


CTES["q7_tagged"] = (
    "SELECT *, CASE "
    + " ".join(
        f"WHEN total_revenue <= {_cont_cut(p)} THEN '{lab}'" for p, lab in zip(SEGMENT_PERCENTILES, SEGMENT_LABELS[:-1])
    )
    + f" ELSE '{SEGMENT_LABELS[-1]}' END AS revenue_segment FROM q7_per_contract"
)

_CHURN_ROWS = "contract_valid_to = product_valid_to AND contract_valid_to < DATE '2024-09-01'"

# Purchase rows with an end date (the product was cancelled at some point).
CTES["q_ended"] = """
SELECT contract_id, product_id, product_type, product_valid_from, product_valid_to, contract_valid_to
FROM l3_pp_product_contract WHERE product_valid_to IS NOT NULL"""

# Contracts with an ended row that outlived its start and an ended row of another product.
CTES["q_with_other_product"] = """
SELECT DISTINCT x.contract_id FROM q_ended x
WHERE x.product_valid_to > x.product_valid_from
  AND EXISTS (SELECT 1 FROM q_ended y WHERE y.contract_id = x.contract_id AND y.product_id <> x.product_id)"""

# Contracts with a started trial: their other purchase rows and what those cost.
CTES["q_trial_contracts"] = f"""
SELECT contract_id, count(*) FILTER (product_type <> 'product_trial') AS n_other,
       {_total("CASE WHEN product_type <> 'product_trial' THEN price_wo_vat END")} AS p_other
FROM l3_pp_contract WHERE contract_id IS NOT NULL GROUP BY contract_id
HAVING count(*) FILTER (product_type = 'product_trial' AND product_valid_from IS NOT NULL) > 0"""

CTES["q16_equipment"] = """
SELECT contract_id, product_id, product_type, product_valid_to FROM q_ended WHERE product_type = 'equipment'"""

# Products of the contract active on a day some other equipment of the contract ended.
CTES["q16_active_then"] = """
SELECT DISTINCT o.contract_id, o.product_id, o.product_type FROM q_ended o
WHERE EXISTS (SELECT 1 FROM q16_equipment e
              WHERE e.contract_id = o.contract_id AND e.product_id <> o.product_id
                AND e.product_valid_to BETWEEN o.product_valid_from AND o.product_valid_to)"""

CTES["q_per_contract_inv"] = f"""
SELECT contract_id, count(invoice_id) AS num_invoices, {_total('amount_wo_vat')} AS total_amount_wo_vat
FROM l2_invoice GROUP BY contract_id"""
CTES["q_per_contract_pp"] = """
SELECT contract_id, count(product_id) AS num_products, count(product_purchase_id) AS num_pp
FROM l2_product_purchase GROUP BY contract_id"""


def _disc_quantiles(
    source: str, col: str, probs=(0.0, 0.25, 0.5, 0.75, 1.0), names=("q0", "q1", "q2", "q3", "q4"), digits: int | None = None
) -> str:
    """Nearest-rank quantiles as one row (value at 1-based rank max(1, ceil(p*n)))."""
    ranked = (
        f"(SELECT {col} AS v, row_number() OVER (ORDER BY {col}) AS rn, count(*) OVER () AS n "
        f"FROM ({source}) WHERE {col} IS NOT NULL)"
    )
    shown = "v" if digits is None else f"round(v, {digits})"
    cols = ", ".join(
        f"(SELECT {shown} FROM {ranked} WHERE rn = greatest(1, ceil(CAST({p!r} AS DOUBLE) * n))) AS {nm}"
        for p, nm in zip(probs, names)
    )
    return f"SELECT {cols}"


def _count_compare(l2: str, l1: str) -> str:
    return f"SELECT 'L2' AS layer, count(*) AS cnt FROM {l2} UNION ALL SELECT 'L1' AS layer, count(*) AS cnt FROM {l1}"


_INV_COLS = [
    "id_invoice_old", "invoice_id_contract", "date", "scadent", "date_paid", "start_date", "end_date", "value",
    "invoice_type", "value_storno", "date_insert", "status", "date_update", "id_branch",
]

FINAL: dict[str, str] = {
    "l0_invoice": "SELECT * FROM l0_invoice",
    "l0_invoice_load": "SELECT * FROM l0_invoice_load",
    "l0_contract": "SELECT * FROM l0_contract",
    "l0_product_purchase": "SELECT * FROM l0_product_purchase",
    "l0_status": "SELECT * FROM l0_status",
    "l0_all_products": "SELECT * FROM l0_all_products",
    "l0_branch": "SELECT * FROM l0_branch",
    "check_contract_duplicates": "SELECT contract_id, count(*) AS cnt FROM l1_contract GROUP BY contract_id HAVING count(*) > 1",
    "check_contract_null_key": "SELECT * FROM l1_contract WHERE contract_id IS NULL",
    "l1_contract": "SELECT * FROM l1_contract",
    "l1_product": "SELECT * FROM l1_product",
    "l1_product_status": "SELECT * FROM l1_product_status",
    "l1_product_purchase": "SELECT * FROM l1_product_purchase",
    "check_invoice_null_key": "SELECT count(*) AS cnt FROM l0_invoice WHERE id_invoice IS NULL",
    "check_invoice_duplicates": "SELECT id_invoice, count(*) AS cnt FROM l0_invoice GROUP BY id_invoice HAVING count(*) > 1",
    "invoice_deduplicated": (
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id_invoice ORDER BY "
        + ", ".join(f"{c} ASC NULLS FIRST" for c in _INV_COLS)
        + ") AS rn FROM l0_invoice) WHERE rn = 1"
    ),
    "check_invoice_old_duplicates": (
        "SELECT id_invoice_old, count(*) AS cnt FROM l0_invoice GROUP BY id_invoice_old HAVING count(*) > 1 ORDER BY cnt DESC"
    ),
    "l1_invoice": "SELECT * FROM l1_invoice",
    "l2_contract": "SELECT * FROM l2_contract",
    "check_counts_contract": _count_compare("l2_contract", "l1_contract"),
    "l2_invoice": "SELECT * FROM l2_invoice",
    "check_counts_invoice": _count_compare("l2_invoice", "l1_invoice"),
    "l2_product": "SELECT * FROM l2_product",
    "check_counts_product": _count_compare("l2_product", "l1_product"),
    "l2_product_purchase": "SELECT * FROM l2_product_purchase",
    "l3_invoice": "SELECT * FROM l3_invoice",
    "l3_pp_product_contract": "SELECT * FROM l3_pp_product_contract",
    "pp_contract_rowcount": "SELECT count(contract_id) AS cnt FROM l3_pp_product_contract",
    "contract_duration_bins_v1": (
        f"SELECT contract_duration, count(DISTINCT contract_id) AS cnt FROM (SELECT contract_id, "
        f"{_bins(DURATION_BIN_LABELS_V1)} AS contract_duration FROM l3_pp_product_contract "
        f"WHERE contract_valid_to IS NOT NULL) GROUP BY contract_duration ORDER BY contract_duration"
    ),
    "avg_revenue_per_customer": f"SELECT round({_total('rev_per_contract')} / count(contract_id), {D}) AS rev_per_cust FROM l3_invoice",
    "median_revenue_single_row": (
        f"SELECT round({_total('amount_wo_vat')} / count(DISTINCT contract_id), {D}) AS median "
        "FROM l2_invoice WHERE paid_date IS NOT NULL"
    ),
    "revenue_segments": (
        "SELECT revenue_segment, count(DISTINCT contract_id) AS num_customers, "
        f"CAST(round({_total('total_revenue')}) AS BIGINT) AS total_revenue, "
        "CAST(sum(total_purchases) AS BIGINT) AS total_purchases "
        "FROM q7_tagged GROUP BY revenue_segment ORDER BY revenue_segment"
    ),
    "customers_churned": f"SELECT * FROM l3_pp_contract WHERE {_CHURN_ROWS} ORDER BY product_lifecycle DESC",
    "churned_multi_product_top50": (
        "SELECT contract_id, n * n_churn AS cnt FROM (SELECT contract_id, count(*) AS n, "
        f"count(*) FILTER ({_CHURN_ROWS}) AS n_churn FROM l3_pp_contract WHERE contract_id IS NOT NULL GROUP BY contract_id) "
        "WHERE n * n_churn > 1 ORDER BY cnt DESC, contract_id LIMIT 50"
    ),
    "unique_contracts": "SELECT count(DISTINCT contract_id) AS unique_contracts FROM l1_contract WHERE contract_valid_from IS NOT NULL",
    "trial_customers": (
        "SELECT count(DISTINCT u.contract_id) AS trial_customers FROM l2_product_purchase u "
        "WHERE u.product_type = 'product_trial' AND u.product_valid_from IS NOT NULL AND EXISTS "
        "(SELECT 1 FROM l2_contract k WHERE k.contract_id = u.contract_id AND k.contract_valid_from IS NOT NULL)"
    ),
    "non_trial_customers": (
        "SELECT count(DISTINCT u.contract_id) AS non_trial_customers FROM l2_product_purchase u "
        "WHERE u.product_type <> 'product_trial' AND u.product_valid_from IS NOT NULL AND EXISTS "
        "(SELECT 1 FROM l2_contract k WHERE k.contract_id = u.contract_id AND k.contract_valid_from IS NOT NULL)"
    ),
    "continued_after_trial": (
        "SELECT count(DISTINCT a.contract_id) AS continued_customers FROM l3_pp_product_contract a "
        "WHERE a.product_type <> 'product_trial' AND EXISTS (SELECT 1 FROM l3_pp_product_contract t "
        "WHERE t.contract_id = a.contract_id AND t.product_type = 'product_trial' "
        "AND t.product_valid_from IS NOT NULL "
        "AND (a.product_valid_to IS NULL OR a.product_valid_to > t.product_valid_to))"
    ),
    "churn_same_day_vs_kept": (
        "SELECT count(DISTINCT CASE WHEN product_valid_to = contract_valid_to THEN contract_id END) "
        "AS churned_on_same_day_count, "
        "count(DISTINCT CASE WHEN product_valid_to < contract_valid_to THEN contract_id END) "
        "AS kept_subscription_count FROM q_ended"
    ),
    "churn_with_other_products": (
        "SELECT count(DISTINCT CASE WHEN product_valid_to = contract_valid_to THEN contract_id END) "
        "AS churned_with_other_products_count, "
        "count(DISTINCT CASE WHEN product_valid_to < contract_valid_to THEN contract_id END) "
        "AS kept_with_other_products_count "
        "FROM q_ended WHERE contract_id IN (SELECT contract_id FROM q_with_other_product)"
    ),
    "churned_equipment_other_types": (
        "SELECT e.contract_id, e.product_type AS discontinued_product, a.product_type AS other_product_at_same_time, count(*) AS cnt "
        "FROM q16_equipment e JOIN q16_active_then a ON a.contract_id = e.contract_id GROUP BY ALL ORDER BY ALL"
    ),
    "contract_duration_bins": (
        f"SELECT contract_duration, count(DISTINCT contract_id) AS cnt FROM (SELECT contract_id, "
        f"{_bins(DURATION_BIN_LABELS)} AS contract_duration FROM l3_pp_product_contract "
        f"WHERE contract_valid_to IS NOT NULL) GROUP BY contract_duration ORDER BY contract_duration"
    ),
    "trial_then_other_rows": "SELECT coalesce(sum(n_other), 0)::BIGINT AS cnt FROM q_trial_contracts",
    "trial_then_other_revenue": f"SELECT round({_total('p_other')}, {D}) AS revenue FROM q_trial_contracts",
    "trial_revenue": (
        f"SELECT round({_total('price_wo_vat')}, {D}) AS revenue FROM l3_pp_contract "
        "WHERE product_type = 'product_trial' AND product_valid_from IS NOT NULL"
    ),
    "top_cancel_dates": (
        "SELECT contract_valid_to, count(DISTINCT contract_id) AS cnt FROM l2_contract "
        "WHERE contract_valid_to IS NOT NULL GROUP BY contract_valid_to "
        "ORDER BY cnt DESC, contract_valid_to ASC LIMIT 50"
    ),
    "avg_cancellations_per_day": (
        f"SELECT round(avg(cnt), {D}) AS avg_cancellations_per_day FROM (SELECT contract_valid_to, count(*) AS cnt "
        "FROM l2_contract WHERE contract_valid_to BETWEEN DATE '2021-01-01' AND DATE '2024-09-30' "
        "GROUP BY contract_valid_to)"
    ),
    "lost_after_discontinuation": (
        "SELECT count(DISTINCT s.contract_id) AS customer_count FROM l3_pp_product_contract s "
        "WHERE s.product_id IN (SELECT product_id FROM l3_pp_product_contract WHERE product_valid_to = DATE '2023-07-31') "
        "AND NOT EXISTS (SELECT 1 FROM l3_pp_product_contract k WHERE k.contract_id = s.contract_id "
        "AND (k.contract_valid_to IS NULL OR k.contract_valid_to > DATE '2023-07-31'))"
    ),
    "products_ended_with_contract": (
        "SELECT count(DISTINCT product_id) AS product_count FROM l3_pp_product_contract "
        "WHERE contract_valid_to = product_valid_to AND product_valid_to = DATE '2023-07-31'"
    ),
    "top_product_end_dates": (
        "SELECT product_valid_to, count(product_id) AS cnt FROM l3_pp_product_contract "
        "WHERE product_valid_to IS NOT NULL GROUP BY product_valid_to "
        "ORDER BY cnt DESC, product_valid_to ASC LIMIT 20"
    ),
    "last_invoice_end_dates": (
        "SELECT end_date, count(*) AS end_date_count FROM l2_invoice i WHERE i.contract_id IS NOT NULL "
        "AND NOT EXISTS (SELECT 1 FROM l2_invoice j WHERE j.contract_id = i.contract_id "
        "AND j.invoice_order > i.invoice_order) GROUP BY end_date ORDER BY end_date_count DESC"
    ),
    "end_date_by_invoice_order": (
        "SELECT end_date, invoice_order, count(*) AS end_date_count FROM l2_invoice "
        "GROUP BY end_date, invoice_order ORDER BY end_date, end_date_count DESC"
    ),
    "median_contract_duration": _disc_quantiles("SELECT contract_duration FROM l3_pp_contract", "contract_duration", (0.5,), ("median",)),
    "top_spenders": (
        f"SELECT contract_id, round(spent, {D}) AS sum FROM (SELECT contract_id, {_total('amount_wo_vat')} AS spent "
        "FROM l2_invoice WHERE paid_date IS NOT NULL GROUP BY contract_id) ORDER BY spent DESC NULLS LAST, contract_id LIMIT 50"
    ),
    "invoice_amount_quartiles": _disc_quantiles(
        "SELECT amount_wo_vat FROM l2_invoice WHERE paid_date IS NOT NULL", "amount_wo_vat"
    ),
    "avg_invoice_amount": f"SELECT round({_total('amount_wo_vat')} / count(amount_wo_vat), {D}) AS avg_amount_wo_vat FROM l2_invoice",
    "avg_purchase_price": f"SELECT round({_total('price_wo_vat')} / count(price_wo_vat), {D}) AS avg_price_wo_vat FROM l2_product_purchase WHERE price_wo_vat > 0",
    "zero_paying_customers": (
        # NOT IN as NOT EXISTS: a paying row of the contract, or a paying row without id, excludes it
        "SELECT count(*) AS cnt FROM l2_contract c JOIN l2_product_purchase z ON z.contract_id = c.contract_id "
        "WHERE c.contract_valid_to IS NULL "
        "AND EXISTS (SELECT 1 FROM l2_product_purchase a WHERE a.contract_id = z.contract_id AND a.price_wo_vat = 0) "
        "AND NOT EXISTS (SELECT 1 FROM l2_product_purchase b WHERE b.price_wo_vat > 0 "
        "AND (b.contract_id = z.contract_id OR b.contract_id IS NULL))"
    ),
    "avg_invoices_per_customer": (
        f"SELECT round(avg(cnt), {D}) AS avg_invoices FROM (SELECT contract_id, count(invoice_id) AS cnt "
        "FROM l2_invoice GROUP BY contract_id)"
    ),
    "revenue_per_customer_quartiles": _disc_quantiles(
        f"SELECT contract_id, {_total('amount_wo_vat')} AS total FROM l2_invoice GROUP BY contract_id", "total", digits=D
    ),
    "invoice_count_quartiles": _disc_quantiles(
        "SELECT contract_id, count(invoice_id) AS cnt FROM l2_invoice GROUP BY contract_id", "cnt"
    ),
    "corr_invoices_revenue": f"SELECT round(corr(num_invoices, total_amount_wo_vat), {D}) AS correlation FROM q_per_contract_inv",
    "corr_invoices_products": (
        f"SELECT round(corr(ci.num_invoices, cp.num_products), {D}) AS correlation "
        "FROM q_per_contract_inv ci JOIN q_per_contract_pp cp ON ci.contract_id = cp.contract_id"
    ),
    "corr_invoices_purchases": (
        f"SELECT round(corr(ci.num_invoices, cp.num_pp), {D}) AS correlation "
        "FROM q_per_contract_inv ci JOIN q_per_contract_pp cp ON ci.contract_id = cp.contract_id"
    ),
    "corr_revenue_products": (
        f"SELECT round(corr(ci.total_amount_wo_vat, cp.num_products), {D}) AS correlation "
        "FROM q_per_contract_inv ci JOIN q_per_contract_pp cp ON ci.contract_id = cp.contract_id"
    ),
    "free_product_types": "SELECT DISTINCT product_type FROM l2_product_purchase WHERE price_wo_vat = 0",
    "revenue_per_customer_by_type": (
        f"SELECT product_type, round({_total('price_wo_vat')} / count(contract_id), {D}) AS rev_per_customer "
        "FROM l2_product_purchase WHERE product_type IS NOT NULL GROUP BY product_type"
    ),
    "avg_trial_duration": (
        f"SELECT round(avg(date_diff('day', product_valid_from, product_valid_to)), {D}) AS avg_trial_days "
        "FROM l2_product_purchase WHERE product_type = 'product_trial'"
    ),
    "avg_days_to_equipment": (
        f"SELECT round(avg(date_diff('day', contract_valid_from, product_valid_from)), {D}) AS avg_days_after_contract "
        "FROM l3_pp_product_contract WHERE product_type = 'equipment' "
        "AND product_valid_from IS NOT NULL AND contract_valid_from IS NOT NULL"
    ),
    "customers_per_year": (
        "SELECT CAST(extract(year FROM contract_valid_from) AS INTEGER) AS year, count(DISTINCT contract_id) AS customers "
        "FROM l3_pp_product_contract WHERE contract_valid_from < contract_valid_to GROUP BY 1 ORDER BY 1"
    ),
}


def _deps(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return [n for n in CTES if n in words]


def build(final: str) -> str:
    """``WITH <needed building blocks> <final>``."""
    need: set[str] = set()
    stack = _deps(final)
    while stack:
        n = stack.pop()
        if n not in need:
            need.add(n)
            stack.extend(_deps(CTES[n]))
    ordered = [n for n in CTES if n in need]
    if not ordered:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + final


def oracle_sql() -> dict[str, str]:
    return {k: build(v) for k, v in FINAL.items()}
