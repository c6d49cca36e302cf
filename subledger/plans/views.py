"""The L0 sources and L1 views as named SQL views over the source files.

A catalog view is a text that is resolved whenever it is read: it lists the files
again and finds the columns by the header of that moment, in whatever session
reads it.  So a replaced extract shows in every session without any call here.
The texts below say in SQL what :mod:`subledger.sources.csv` and
:mod:`subledger.plans.layers` say with columns; tests hold the two together.

A source of several files with unequal headers cannot be read by one such text;
it is an error when the view is made, and when it is read if such a file comes
later.  Quoted line breaks and doubled quotes are read as by the sources.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from subledger.constants import BUSINESS_TZ, INVOICE_TYPE_LABELS, ISSUED_STATUS_LIMIT
from subledger.sources import csv as csv_source
from subledger.sources.schemas import L0_SCHEMAS

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def day(column: str, tz: str = BUSINESS_TZ) -> str:
    """The calendar date in ``tz`` of a TIMESTAMP_NTZ in UTC."""
    seconds = f"cast(cast({column} - {_EPOCH} as interval second) as bigint)"
    return f"date_from_unix_date(cast(floor(unix_seconds(from_utc_timestamp(timestamp_seconds({seconds}), {text_literal(tz)})) / 86400) as int))"


def instant(text: str, cast: str) -> str:
    """The instant of a date/time text; without a zone it is UTC, without a time midnight."""
    t = f"trim({text})"
    t = f"CASE WHEN {t} RLIKE '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$' THEN concat({t}, ' 00:00:00') ELSE {t} END"
    zone = "(?i)(?<=[0-9])\\\\s*(Z|UTC|GMT|[+-][0-9]{1,2}(:?[0-9]{2})?)$"
    zoned = f"({t}) RLIKE '[0-9]{{1,2}}-[0-9]{{1,2}}[T ].*' AND ({t}) RLIKE '{zone}'"
    spelled = f"regexp_replace({t}, '(?<=[0-9])\\\\s*([+-][0-9]{{2}})([0-9]{{2}})$', '$1:$2')"
    return f"{cast}(CASE WHEN {zoned} THEN {spelled} ELSE concat({spelled}, ' UTC') END AS timestamp)"


def wall_clock(text: str, cast: str = "cast") -> str:
    """The UTC wall clock (TIMESTAMP_NTZ) of a date/time text."""
    micros = f"cast(unix_micros({instant(text, cast)}) as decimal(20,0)) / cast(1000000 as decimal(7,0))"
    return f"{_EPOCH} + make_dt_interval(0, 0, 0, cast({micros} as decimal(18,6)))"


def _typed(source: str, field: T.StructField, column: str) -> str:
    name = quoted(field.name)
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return f"{column} AS {name}"
    if isinstance(kind, T.TimestampNTZType):
        parsed = wall_clock(column, "try_cast")
    elif isinstance(kind, T.BooleanType):
        low = f"lower(trim({column}))"
        words = [", ".join(map(text_literal, w)) for w in (csv_source.TRUE, csv_source.FALSE)]
        parsed = f"CASE WHEN {low} IN ({words[0]}) THEN true WHEN {low} IN ({words[1]}) THEN false END"
    else:
        parsed = f"try_cast(trim({column}) AS {kind.simpleString()})"
    say = text_literal(f"{source}.{field.name}: cannot read as {kind.simpleString()}: ")
    error = f"cast(raise_error(concat({say}, {column})) as {kind.simpleString()})"
    return f"CASE WHEN {column} IS NOT NULL AND ({parsed}) IS NULL THEN {error} ELSE {parsed} END AS {name}"


def source_select(spark: SparkSession, name: str, path: str, multi_line: bool | None = None) -> str:
    """The typed columns of an extract, found by name in the files at ``path``."""
    found = csv_source.headers(spark, name, path, multi_line)
    if len(found) != 1:
        raise ValueError(f"{name}: the files at {path} have {len(found)} headers; a view needs one")
    # a column whose header is spelled otherwise is named as it is spelled today
    named = csv_source.header_map(name, path, next(iter(found)))
    options = ", ".join(f"{text_literal(k)} = {text_literal(v)}" for k, v in {**csv_source.csv_options(name, multi_line), "mode": "FAILFAST"}.items())
    columns = ", ".join(_typed(name, f, quoted(named[f.name])) for f in L0_SCHEMAS[name])
    return f"SELECT {columns} FROM csv.{quoted(path)} WITH ({options})"


def l1_selects(db: str, tz: str = BUSINESS_TZ) -> dict[str, str]:
    """The L1 views over the views ``l0_*`` of the database, in the order in which they build on each other."""
    at = lambda name: f"{quoted(db)}.{quoted(name)}"
    text_day = lambda c: day(f"({wall_clock(c)})", tz)
    labels = " ".join(f"WHEN {code} THEN {text_literal(label)}" for code, label in INVOICE_TYPE_LABELS.items())
    return {
        "l1_contract": f"""
            SELECT id_contract AS contract_id, id_branch AS branch_id, {day('date_contract_valid_from', tz)} AS contract_valid_from,
                   {text_day('date_contract_valid_to')} AS contract_valid_to, {day('date_registered', tz)} AS registered_date,
                   {day('date_signed', tz)} AS signed_date, {day('activation_process_date', tz)} AS activation_process_date,
                   {day('prolongation_date', tz)} AS prolongation_date, registration_end_reason, flag_prolongation,
                   flag_send_inv_email AS flag_sent_email, contract_status
            FROM {at('l0_contract')}""",
        "l1_product": f"""
            SELECT DISTINCT id_product AS product_id, name AS product_name, type AS product_type, category AS product_category
            FROM {at('l0_all_products')}""",
        "l1_product_status": f"SELECT id_status AS product_status_id, status_name AS product_status_name FROM {at('l0_status')}",
        "l1_product_purchase": f"""
            SELECT pp.id_package AS product_purchase_id, pp.id_contract AS contract_id, pp.id_package_template AS product_id,
                   {day('pp.date_insert', tz)} AS create_date, {text_day('pp.start_date')} AS product_valid_from,
                   {text_day('pp.end_date')} AS product_valid_to, pp.fee AS price_wo_vat, {day('pp.date_update', tz)} AS date_update,
                   pp.package_status AS product_status_id, ps.product_status_name AS product_status,
                   p.product_name, p.product_type, p.product_category
            FROM {at('l0_product_purchase')} pp
            LEFT JOIN {at('l1_product_status')} ps ON pp.package_status = ps.product_status_id
            LEFT JOIN {at('l1_product')} p ON pp.id_package_template = p.product_id""",
        "l1_invoice": f"""
            SELECT id_invoice AS invoice_id, id_invoice_old AS invoice_previous_id, invoice_id_contract AS contract_id,
                   {day('date', tz)} AS date_issue, {day('scadent', tz)} AS due_date, {day('date_paid', tz)} AS paid_date,
                   {day('start_date', tz)} AS start_date, {day('end_date', tz)} AS end_date, value AS amount_w_vat,
                   invoice_type AS invoice_type_id, CASE invoice_type {labels} END AS invoice_type, value_storno AS return_w_vat,
                   {day('date_insert', tz)} AS date_insert, status AS invoice_status_id,
                   coalesce(status < {ISSUED_STATUS_LIMIT}, false) AS flag_invoice_issued,
                   {day('date_update', tz)} AS update_date, id_branch AS branch_id
            FROM {at('l0_invoice')}""",
    }


def create_views(spark: SparkSession, sources: csv_source.CsvSources, db: str) -> list[str]:
    """Create or replace the views ``l0_*`` and ``l1_*`` of the database; returns their names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(db)}")
    texts = {f"l0_{name}": source_select(spark, name, path, sources.multi_line.get(name)) for name, path in sources.paths.items()}
    texts |= l1_selects(db)
    for name, select in texts.items():
        spark.sql(f"CREATE OR REPLACE VIEW {quoted(db)}.{quoted(name)} AS {select}")
    return [f"{db}.{name}" for name in texts]


def point_table(spark: SparkSession, db: str, name: str, path: str) -> None:
    """Make ``db.name`` stand for the Parquet table at ``path``: one change of the catalog, seen by every session."""
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(db)}.{quoted(name)} AS SELECT * FROM parquet.{quoted(path)}")


def pointed_at(spark: SparkSession, db: str) -> dict[str, str]:
    """The path of each table of the database that :func:`point_table` made."""
    out = {}
    for t in spark.catalog.listTables(db):
        if t.tableType != "VIEW" or not t.namespace:
            continue
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(db)}.{quoted(t.name)}").collect()
        text = next((r["data_type"] for r in rows if r["col_name"] == "View Text"), "")
        if " FROM parquet.`" in text:
            out[t.name] = text.split(" FROM parquet.`", 1)[1].removesuffix("`").replace("``", "`")
    return out
