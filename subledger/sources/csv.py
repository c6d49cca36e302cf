"""CSV sources (L0) and table sinks.

The warehouse's raw extracts are CSV files with one header row; spreadsheet
sources are read from their CSV export.  Columns are taken by header name, never
by position, and each text is cast to the type of
:mod:`subledger.sources.schemas`.  A text that cannot be read as its type is an
error that names source, column and value, or sends its row to a reject table;
it never becomes a silent NULL.

Fields may be quoted; a quote inside is doubled, as spreadsheets and warehouses
write it.  Quoted line breaks need ``multi_line``, which reads a file in one
task: it is on for the spreadsheet exports (:data:`SHEETS`), which are small, and
off for the extracts, where a broken line is an error or a rejected row.

An extract may be a folder of files whose headers differ in order or in columns
that are not needed; files are grouped by header and joined by name.
"""

from __future__ import annotations

from collections.abc import MutableMapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subledger.functions import utc_ntz_of_text
from subledger.sources.schemas import L0_SCHEMAS

WRITE_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# Default file name of each source inside its folder.
L0_FILES = {
    "invoice": "invoice.csv",
    "invoice_load": "invoices_load.csv",
    "contract": "contracts.csv",
    "product_purchase": "product_purchases.csv",
    "status": "status.csv",
    "all_products": "all_products.csv",
    "branch": "branch.csv",
}

TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def _parsed(text: Column, kind: T.DataType) -> Column:
    """``text`` as ``kind``, NULL where it cannot be read."""
    if isinstance(kind, T.StringType):
        return text
    t = F.trim(text)
    if isinstance(kind, T.TimestampNTZType):
        return utc_ntz_of_text(t, strict=False)
    if isinstance(kind, T.BooleanType):
        low = F.lower(t)
        return F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False))
    return t.try_cast(kind)


#: Sources that come from spreadsheets; their fields may hold line breaks.
SHEETS = ("status", "all_products", "branch")
#: How every CSV file is read; a doubled quote stands for a quote.
OPTIONS = {"header": "true", "quote": '"', "escape": '"', "enforceSchema": "false"}
_CORRUPT = "__corrupt_row"
_HEADERS_AT_ONCE = 16


def csv_options(name: str, multi_line: bool | None = None) -> dict[str, str]:
    """The reader's options for a source; ``multi_line`` None: on for spreadsheets only."""
    multi_line = name in SHEETS if multi_line is None else multi_line
    return OPTIONS | {"multiLine": str(bool(multi_line)).lower()}


def headers(spark: SparkSession, name: str, path: str, multi_line: bool | None = None) -> dict[tuple[str, ...], list[str]]:
    """The files of an extract by their header; one small read per file if there are several.  Empty files have none."""
    reader = lambda: spark.read.options(**csv_options(name, multi_line))
    files = sorted(spark.read.text(path).inputFiles())
    if len(files) <= 1:
        return {tuple(reader().csv(path).columns): [path]}
    with ThreadPoolExecutor(_HEADERS_AT_ONCE) as pool:
        found = list(pool.map(lambda f: tuple(reader().csv(f).columns), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for f, header in zip(files, found, strict=True):
        if header:
            out.setdefault(header, []).append(f)
    return {next(iter(out)): [path]} if len(out) == 1 and len(next(iter(out.values()))) == len(files) else out


def header_map(name: str, path: str, header: tuple[str, ...]) -> dict[str, str]:
    """Schema column -> the header's spelling of it; a missing column is an error."""
    found = {c.strip().lstrip("\ufeff").lower(): c for c in header}
    missing = [f.name for f in L0_SCHEMAS[name] if f.name not in found]
    if missing:
        raise ValueError(f"{name}: {path} has no column {', '.join(missing)}; its header is {', '.join(header)}")
    return {f.name: found[f.name] for f in L0_SCHEMAS[name]}


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def read_text(spark: SparkSession, name: str, path: str, multi_line: bool | None = None, keep_corrupt: bool = False) -> DataFrame:
    """The extract's columns as texts, found by header name in the order of the schema.

    Other columns are ignored; a missing one is an error.  Malformed rows (too
    few or many fields, an open quote) are an error, or with ``keep_corrupt`` keep
    their whole text in an additional column.
    """
    out = None
    for header, files in headers(spark, name, path, multi_line).items():
        named = header_map(name, files[0], header)
        reader = spark.read.options(**csv_options(name, multi_line))
        if keep_corrupt:
            schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, _CORRUPT)])
            raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).schema(schema).csv(files)
        else:
            raw = reader.option("mode", "FAILFAST").csv(files)
        rows = raw.select(*[_named(named[f.name]).alias(f.name) for f in L0_SCHEMAS[name]], *([_CORRUPT] if keep_corrupt else []))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"{name}: {path} has no file with a header")
    return out


def read_source(spark: SparkSession, name: str, path: str, multi_line: bool | None = None) -> DataFrame:
    """One L0 extract with its schema; a value that cannot be read stops the job with an error."""
    text = read_text(spark, name, path, multi_line)

    def strict(f: T.StructField) -> Column:
        parsed = _parsed(F.col(f.name), f.dataType)
        if isinstance(f.dataType, T.StringType):
            return parsed.alias(f.name)
        say = F.concat(F.lit(f"{name}.{f.name}: cannot read as {f.dataType.simpleString()}: "), F.col(f.name))
        bad = F.col(f.name).isNotNull() & parsed.isNull()
        return F.when(bad, F.raise_error(say).cast(f.dataType)).otherwise(parsed).alias(f.name)

    return text.select(*[strict(f) for f in L0_SCHEMAS[name]])


def read_source_with_rejects(spark: SparkSession, name: str, path: str, multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(readable rows, rejected rows as texts with ``reject_columns`` and ``reject_row``); every row is in one of them.

    ``reject_row`` is the whole text of a malformed row, whose ``reject_columns`` are empty; its columns hold
    what could be told apart.
    """
    text = read_text(spark, name, path, multi_line, keep_corrupt=True).withColumnRenamed(_CORRUPT, "reject_row")
    fields = L0_SCHEMAS[name].fields
    bad = [F.when(F.col(f.name).isNotNull() & _parsed(F.col(f.name), f.dataType).isNull(), F.lit(f.name)) for f in fields]
    marked = text.withColumn("reject_columns", F.array_compact(F.array(*bad)))
    marked = marked.withColumn("reject_columns", F.when(F.col("reject_row").isNull(), F.col("reject_columns")).otherwise(F.array().cast("array<string>")))
    fine = (F.size("reject_columns") == 0) & F.col("reject_row").isNull()
    return marked.where(fine).select(*[_parsed(F.col(f.name), f.dataType).alias(f.name) for f in fields]), marked.where(~fine)


class CsvSources(MutableMapping):
    """The L0 sources of a folder, each read anew whenever it is asked for.

    A frame keeps the list of files it was made with; asking again lists them
    again, so a replaced or added file shows in whatever is built next.
    """

    def __init__(self, spark: SparkSession, folder: str, files: dict[str, str] | None = None, multi_line: dict[str, bool] | None = None):
        self.spark, self.multi_line = spark, multi_line or {}
        self.paths = {name: f"{folder.rstrip('/')}/{(files or L0_FILES)[name]}" for name in L0_SCHEMAS}
        self._given: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._given:
            return self._given[name]
        return read_source(self.spark, name, self.paths[name], self.multi_line.get(name))

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self._given[name] = df

    def __delitem__(self, name: str) -> None:
        del self._given[name]

    def __iter__(self):
        return iter(L0_SCHEMAS)

    def __len__(self) -> int:
        return len(L0_SCHEMAS)


def read_l0(spark: SparkSession, folder: str, files: dict[str, str] | None = None, multi_line: dict[str, bool] | None = None) -> CsvSources:
    """All seven L0 sources from one folder (or explicit per-source paths)."""
    return CsvSources(spark, folder, files, multi_line)


def write_source(df: DataFrame, path: str) -> None:
    """Write a frame as an L0-style CSV extract (header + UTC wall-clock text)."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", OPTIONS["escape"])
        .option("timestampNTZFormat", WRITE_TS_FORMAT)
        .csv(path)
    )
