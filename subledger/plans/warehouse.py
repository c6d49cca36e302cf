"""The layered warehouse: L0 sources in, lazily built L1/L2/L3 frames out.

``Warehouse`` only wires layer functions together; nothing runs until a
report is collected or written.  L0 sources and L1 views are built whenever they
are asked for, so they list the source files of that moment.  ``materialize``
writes the tables that the source warehouse keeps as tables (L2, the L3 base
tables and the two L3 report tables) as a new version in a folder of shared
storage and reads them back.  Reports built afterwards start from those files,
which cuts the lineage and makes a lost executor cost a file re-read instead of a
re-join.

``publish`` gives sources, views and tables names in a catalog database.  A name
of a table always stands for one complete version: it moves to the next one in a
single change of the catalog after all tables of that version are written, and a
build that fails moves none.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import MutableMapping

from pyspark.sql import DataFrame, Observation, SparkSession

from subledger.operators import quality
from subledger.plans import layers, views
from subledger.session import checkpoint_folder, configure
from subledger.sources import csv as csv_source
from subledger.sources import testdata

# Views of the source warehouse.
VIEWS = ("l1_contract", "l1_product", "l1_product_status", "l1_product_purchase", "l1_invoice")
# Tables the source warehouse creates as tables (snapshots), in build order.
MATERIALIZED = (
    "l2_contract",
    "l2_invoice",
    "l2_product",
    "l2_product_purchase",
    "l3_invoice",
    "l3_pp_product_contract",
    "l3_contract_duration_bins",
    "l3_invoice_pp",
)
# Marks a version whose tables have all been written; holds the metrics gathered meanwhile.
COMPLETE = "_complete"
# Table -> view whose rows the stage that writes the table also sees, each once.  Metrics are only
# observed there: Spark counts a finished task of a job's last stage once, but adds a shuffle's tasks again when a lost
# executor makes them run again.
OBSERVED = {"l2_contract": "l1_contract", "l2_product": "l1_product"}


class Warehouse:
    def __init__(self, l0: MutableMapping[str, DataFrame], spark: SparkSession | None = None):
        self.l0 = l0
        self.spark = spark or l0["invoice"].sparkSession
        self._tables: dict[str, DataFrame] = {}
        self._written = False
        self._metrics: dict[str, dict[str, int]] = {}
        self._observing: dict[str, Observation] = {}
        configure(self.spark)
        checkpoint_folder(self.spark)

    # ---------------------------------------------------------------- builders
    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> Warehouse:
        return cls(testdata.l0_from_testdata(spark, sf_dir))

    @classmethod
    def from_csv(
        cls, spark: SparkSession, folder: str, files: dict[str, str] | None = None, multi_line: dict[str, bool] | None = None
    ) -> Warehouse:
        return cls(csv_source.read_l0(spark, folder, files, multi_line), spark)

    # ---------------------------------------------------------------- L1 views
    @property
    def l1_contract(self) -> DataFrame:
        return self._observed("l1_contract", layers.l1_contract(self.l0["contract"]), "contract_id")

    @property
    def l1_product(self) -> DataFrame:
        return self._observed("l1_product", layers.l1_product(self.l0["all_products"]))

    @property
    def l1_product_status(self) -> DataFrame:
        return layers.l1_product_status(self.l0["status"])

    @property
    def l1_product_purchase(self) -> DataFrame:
        return layers.l1_product_purchase(self.l0["product_purchase"], self.l1_product_status, self.l1_product)

    @property
    def l1_invoice(self) -> DataFrame:
        return layers.l1_invoice(self.l0["invoice"])

    def _observed(self, name: str, frame: DataFrame, key: str | None = None) -> DataFrame:
        """``frame``, counted on its way if a table that reads it is being written."""
        if name not in self._observing:
            return frame
        return frame.observe(self._observing[name], *quality.row_metrics(key))

    # ------------------------------------------------------------------ checks
    def metrics(self) -> dict[str, dict[str, int]]:
        """Rows (and NULL keys) of views and tables as the version in use was written; empty without one."""
        return {k: dict(v) for k, v in self._metrics.items()}

    def _metric(self, name: str, metric: str = "rows") -> int | None:
        return self._metrics.get(name, {}).get(metric)

    def check_null_contracts(self) -> DataFrame:
        """Rows of ``l1_contract`` without a key; not searched for if the build met none."""
        rows = quality.null_key_rows(self.l1_contract, "contract_id")
        return rows.where("false") if self._metric("l1_contract", "null_keys") == 0 else rows

    def check_null_invoices(self) -> DataFrame:
        """How many rows of the invoice source have no key."""
        n = self._metric("l1_invoice", "null_keys")
        invoice = self.l0["invoice"]
        return quality.null_key_count(invoice, "id_invoice") if n is None else quality.constant_row(invoice, n, "cnt")

    def check_counts(self, subject: str) -> DataFrame:
        """(layer, cnt) of the L2 table and L1 view of ``contract``, ``invoice`` or ``product``."""
        l2 = self.l2_invoice_rows if subject == "invoice" else getattr(self, f"l2_{subject}")
        known = {layer: self._metric(f"{layer.lower()}_{subject}") for layer in ("L2", "L1")}
        return quality.count_compare({"L2": l2, "L1": getattr(self, f"l1_{subject}")}, known=known)

    # --------------------------------------------------------------- L2 tables
    def _table(self, name: str, build) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = build()
        return self._tables[name]

    @property
    def l2_contract(self) -> DataFrame:
        return self._table("l2_contract", lambda: layers.l2_contract(self.l1_contract))

    @property
    def l2_invoice(self) -> DataFrame:
        return self._table("l2_invoice", lambda: layers.l2_invoice(self.l1_invoice, self.l2_contract))

    @property
    def l2_invoice_rows(self) -> DataFrame:
        """The rows of ``l2_invoice`` for reports that need no numbering: from the table once it is written."""
        if "l2_invoice" in self._tables and self._written:
            return self._tables["l2_invoice"]
        return self._table("l2_invoice_rows", lambda: layers.l2_invoice_rows(self.l1_invoice, self.l2_contract))

    @property
    def l2_product(self) -> DataFrame:
        return self._table("l2_product", lambda: layers.l2_product(self.l1_product))

    @property
    def l2_product_purchase(self) -> DataFrame:
        return self._table(
            "l2_product_purchase", lambda: layers.l2_product_purchase(self.l1_product_purchase, self.l2_product)
        )

    # ---------------------------------------------------------- L3 base tables
    @property
    def l3_invoice(self) -> DataFrame:
        return self._table("l3_invoice", lambda: layers.l3_invoice(self.l2_invoice_rows))

    @property
    def l3_pp_product_contract(self) -> DataFrame:
        return self._table(
            "l3_pp_product_contract",
            lambda: layers.l3_pp_product_contract(self.l2_product_purchase, self.l2_contract),
        )

    @property
    def l3_pp_contract(self) -> DataFrame:
        return layers.l3_pp_contract(self.l3_pp_product_contract)

    # ----------------------------------------------------- L3 report tables
    @property
    def l3_contract_duration_bins(self) -> DataFrame:
        """Distinct contracts per duration bin (the final labels)."""
        from subledger.plans.reports import churn

        return self._table("l3_contract_duration_bins", lambda: churn.contract_duration_bins(self.l3_pp_product_contract))

    @property
    def l3_invoice_pp(self) -> DataFrame:
        """Paying contracts in revenue segments."""
        from subledger.plans.reports import buying

        return self._table("l3_invoice_pp", lambda: buying.revenue_segments(self.l2_invoice_rows, self.l2_product_purchase))

    # ------------------------------------------------------------ persistence
    def materialize(self, folder: str | None = None, tables=MATERIALIZED) -> str:
        """Write the tables as a new version below ``folder`` and switch to reading it.

        Every call builds from L0 again, so it picks up changed inputs, and
        never reads or overwrites an earlier version.  The version counts once
        all its tables are written (see :meth:`use`); a run that dies before
        leaves the earlier one in place.  Returns the version's folder.

        Rows and NULL keys that the checks ask for are counted meanwhile
        (:meth:`metrics`): the checks then tell of this version, L1 views as they
        were when it was built, and read nothing.  Contracts and products are
        observed by the jobs that write them; invoices of L1 pass a shuffle on
        their way, so one more pass over their key counts them.
        """
        folder = (folder or f"{checkpoint_folder(self.spark)}/warehouse-{uuid.uuid4().hex[:12]}").rstrip("/")
        version = f"{folder}/v{time.time_ns():020d}"
        before = self._tables, self._written, self._metrics
        self._tables, self._written, self._metrics = {}, False, {}
        try:
            found = {}
            for name in tables:
                found |= self._write(name, f"{version}/{name}")
                self._tables[name] = self.spark.read.parquet(f"{version}/{name}")
                self._written = True
            if "l2_invoice" in tables:
                found["l1_invoice"] = self.l1_invoice.agg(*quality.row_metrics("invoice_id")).first().asDict()
            fs, path = _hadoop(self.spark, f"{version}/{COMPLETE}")
            mark = fs.create(path, False)
            mark.write(json.dumps(found).encode())
            mark.close()
            self._metrics = found
        except BaseException:
            # reports go on with what they had, not with a mixture
            self._tables, self._written, self._metrics = before
            raise
        return version

    def _write(self, name: str, path: str) -> dict[str, dict[str, int]]:
        """Write one table; returns the metrics of the view it reads and of itself, where checks ask for them."""
        if name not in OBSERVED and name != "l2_invoice":
            getattr(self, name).write.parquet(path)
            return {}
        rows = Observation()
        self._observing = {OBSERVED[name]: Observation()} if name in OBSERVED else {}
        try:
            getattr(self, name).observe(rows, *quality.row_metrics()).write.parquet(path)
            # an observation that its job did not reach (no such case is known) leaves the check to a scan
            return {k: o.get for k, o in {**self._observing, name: rows}.items() if o.get}
        finally:
            self._observing = {}

    def publish(self, db: str, folder: str | None = None, tables=MATERIALIZED) -> str:
        """Build a new version and let the names of database ``db`` stand for it; returns the version's folder.

        Tables become ``db.l2_invoice`` and so on; with CSV sources the views
        ``db.l0_*`` and ``db.l1_*`` are made too, over the files themselves.  Any
        session of the catalog reads them.  Each name moves by itself, so a driver
        that dies while they move leaves complete tables of two versions;
        :meth:`published` tells, and publishing again (or :meth:`point`) mends it.
        """
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {views.quoted(db)}")
        if isinstance(self.l0, csv_source.CsvSources):
            views.create_views(self.spark, self.l0, db)
        version = self.materialize(folder, tables)
        self.point(db, version)
        return version

    def point(self, db: str, version: str) -> list[str]:
        """Let the table names of ``db`` stand for a complete version, an earlier one too; returns the names."""
        fs, mark = _hadoop(self.spark, f"{version}/{COMPLETE}")
        if not fs.exists(mark):
            raise FileNotFoundError(f"{version} is not a complete version")
        names = [s.getPath().getName() for s in fs.listStatus(mark.getParent()) if s.isDirectory()]
        for name in names:
            views.point_table(self.spark, db, name, f"{version}/{name}")
        return names

    def published(self, db: str) -> dict[str, str]:
        """The version that each table name of ``db`` stands for."""
        return {name: path.rsplit("/", 1)[0] for name, path in views.pointed_at(self.spark, db).items()}

    def use(self, folder: str) -> str:
        """Read the tables of the latest complete version below ``folder``; returns its folder."""
        done = self._versions(folder)
        if not done:
            raise FileNotFoundError(f"no complete version below {folder}")
        fs, at = _hadoop(self.spark, done[-1])
        names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        mark = fs.open(_hadoop(self.spark, f"{done[-1]}/{COMPLETE}")[1])
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(mark, "UTF-8")
        finally:
            mark.close()
        self._tables, self._written = {n: self.spark.read.parquet(f"{done[-1]}/{n}") for n in names}, True
        # marks of versions written before metrics were kept are empty
        self._metrics = json.loads(text) if text else {}
        return done[-1]

    def _versions(self, folder: str) -> list[str]:
        folder = folder.rstrip("/")
        fs, pattern = _hadoop(self.spark, f"{folder}/v*/{COMPLETE}")
        return sorted(f"{folder}/{s.getPath().getParent().getName()}" for s in fs.globStatus(pattern) or [])

    def drop_versions(self, folder: str, keep: int = 1, db: str | None = None) -> list[str]:
        """Delete old versions below ``folder``; returns them.

        Kept are the last ``keep`` complete ones, those that a name of ``db`` stands
        for, and unfinished ones younger than the last complete one, which may
        still be being written.
        """
        done = self._versions(folder)
        in_use = {_plain(v) for v in self.published(db).values()} if db else set()
        fs, pattern = _hadoop(self.spark, f"{folder.rstrip('/')}/v*")
        every = sorted(f"{folder.rstrip('/')}/{s.getPath().getName()}" for s in fs.globStatus(pattern) or [])
        kept = set(done[-max(1, keep) :])
        old = [v for v in every if done and v < done[-1] and v not in kept and _plain(v) not in in_use]
        for v in old:
            fs, path = _hadoop(self.spark, v)
            fs.delete(path, True)
        return old

    def register(self, prefix: str = "") -> list[str]:
        """Name every view and table in the session (temporary views), for use in SQL; returns the names."""
        names = [*VIEWS, *MATERIALIZED, "l3_pp_contract"]
        for name in names:
            getattr(self, name).createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{n}" for n in names]


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "/", path).rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of ``path`` in whatever storage it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
