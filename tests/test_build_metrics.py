"""Checks answered from metrics gathered while a version is written."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from subledger.plans.registry import QUERIES
from subledger.plans.warehouse import COMPLETE, Warehouse, _hadoop
from subledger.sources import testdata
from tests.conftest import SF_SMALL

CHECKS = ["check_contract_null_key", "check_invoice_null_key", "check_counts_contract", "check_counts_invoice", "check_counts_product"]


def _sources(spark, copies=1, null_keys=False):
    """The test extracts, repeated and with some NULL keys on demand."""
    l0 = dict(testdata.l0_from_testdata(spark, SF_SMALL))
    for name, key in (("invoice", "id_invoice"), ("contract", "id_contract")):
        frame = l0[name]
        for _ in range(copies - 1):
            frame = frame.unionAll(l0[name])
        if null_keys:
            frame = frame.withColumn(key, F.when(F.col(key) % 7 == 0, F.lit(None)).otherwise(F.col(key)).cast("long"))
        l0[name] = frame
    return l0


def _rows(w, key):
    df = QUERIES[key](w)
    return df.columns, sorted(repr(tuple(r)) for r in df.collect())


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("null_keys", [False, True])
def test_metrics_equal_the_scans(spark, null_keys, tmp_path):
    plain = Warehouse(_sources(spark, null_keys=null_keys), spark)
    built = Warehouse(_sources(spark, null_keys=null_keys), spark)
    built.materialize(str(tmp_path), tables=("l2_contract", "l2_product", "l2_invoice"))
    for key in CHECKS:
        assert _rows(built, key) == _rows(plain, key), key
    m = built.metrics()
    assert (m["l1_contract"]["null_keys"] > 0) == null_keys and m["l1_contract"]["rows"] >= m["l2_contract"]["rows"]
    # a new object finds them with the version
    later = Warehouse(_sources(spark), spark)
    later.use(str(tmp_path))
    assert later.metrics() == m


def test_checks_of_a_version_scan_nothing(spark, tmp_path):
    w = Warehouse.from_testdata(spark, SF_SMALL)
    assert all("FileScan" in _plan(QUERIES[k](w)) for k in CHECKS)
    w.materialize(str(tmp_path), tables=("l2_contract", "l2_product", "l2_invoice"))
    for key in CHECKS:
        assert "FileScan" not in _plan(QUERIES[key](w)), key


def test_metrics_are_those_of_the_version_in_use(spark, tmp_path):
    w = Warehouse(_sources(spark), spark)
    first = w.materialize(str(tmp_path), tables=("l2_contract",))
    n = w.metrics()["l1_contract"]["rows"]
    w.l0["contract"] = _sources(spark, copies=2)["contract"]
    w.materialize(str(tmp_path), tables=("l2_contract",))
    assert w.metrics()["l1_contract"]["rows"] == 2 * n
    # a build that fails changes nothing
    w.l0["contract"] = w.l0["contract"].withColumn("id_contract", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        w.materialize(str(tmp_path), tables=("l2_contract",))
    assert w.metrics()["l1_contract"]["rows"] == 2 * n
    # a version whose mark is empty has none, and its checks scan
    other = Warehouse(_sources(spark), spark)
    fs, mark = _hadoop(spark, f"{first}/{COMPLETE}")
    fs.create(mark, True).close()
    other.use(str(tmp_path))
    assert other.metrics()["l1_contract"]["rows"] == 2 * n
    fs.delete(_hadoop(spark, f"{w._versions(str(tmp_path))[-1]}/{COMPLETE}")[1], False)
    assert other.use(str(tmp_path)) == first
    assert other.metrics() == {}


def test_empty_sources(spark, tmp_path):
    l0 = {k: v.limit(0) for k, v in testdata.l0_from_testdata(spark, SF_SMALL).items()}
    w = Warehouse(l0, spark)
    w.materialize(str(tmp_path), tables=("l2_contract", "l2_product", "l2_invoice"))
    for subject in ("contract", "invoice", "product"):
        assert sorted(tuple(r) for r in w.check_counts(subject).collect()) == [("L1", 0), ("L2", 0)]
    assert w.check_null_contracts().count() == 0 and w.check_null_invoices().first().cnt == 0
