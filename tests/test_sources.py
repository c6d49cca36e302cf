"""L0 sources as CSV files; versions of the written tables."""

import collections
import tempfile

import pytest
from pyspark.sql import functions as F

from subledger.oracle import oracle_sql
from subledger.plans import layers
from subledger.plans.registry import QUERIES
from subledger.plans.warehouse import MATERIALIZED, VIEWS, Warehouse
from subledger.sources import csv as csv_source
from subledger.sources import testdata
from tests.conftest import SF_SMALL


def _bag(df):
    return collections.Counter(repr(tuple(r)) for r in df.collect())


def test_csv_round_trip_all_sources(spark):
    l0 = testdata.l0_from_testdata(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="subledger-csv-")
    for name, df in l0.items():
        csv_source.write_source(df, f"{folder}/{csv_source.L0_FILES[name]}")
    back = csv_source.read_l0(spark, folder)
    for name, df in l0.items():
        # the fixture mapping yields exactly the declared L0 types
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in back[name].schema], name
        assert _bag(back[name].select(*df.columns)) == _bag(df), name


def test_warehouse_from_csv_equals_from_tables(spark):
    l0 = testdata.l0_from_testdata(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="subledger-csv-")
    for name, df in l0.items():
        csv_source.write_source(df, f"{folder}/{csv_source.L0_FILES[name]}")
    a = Warehouse.from_csv(spark, folder)
    b = Warehouse(l0)
    assert _bag(a.l2_invoice) == _bag(b.l2_invoice)
    assert _bag(a.l3_pp_product_contract) == _bag(b.l3_pp_product_contract)


def test_registered_l0_keys_through_csv(spark, duck):
    """The L0 keys read from CSV files equal the oracle's tables."""
    l0 = testdata.l0_from_testdata(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="subledger-csv-")
    for name, df in l0.items():
        csv_source.write_source(df, f"{folder}/{csv_source.L0_FILES[name]}")
    w = Warehouse.from_csv(spark, folder)
    for key in [k for k in QUERIES if k.startswith("l0_")]:
        df = QUERIES[key](w)
        cur = duck.execute(oracle_sql()[key])
        cols = [d[0] for d in cur.description]
        want = collections.Counter(repr(tuple(r[cols.index(c)] for c in df.columns)) for r in cur.fetchall())
        assert _bag(df) == want, key


def _file(name, *lines):
    folder = tempfile.mkdtemp(prefix="subledger-csv-")
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")
    return f"{folder}/{name}"


def test_columns_are_found_by_name(spark):
    path = _file("status.csv", "note,status_name, ID_STATUS ", "x,active,1", "y,closed,2")
    assert sorted(map(tuple, csv_source.read_source(spark, "status", path).collect())) == [(1, "active"), (2, "closed")]
    path = _file("p.csv", "id_product,name,category,type", "5,n,product,equipment")
    assert tuple(csv_source.read_source(spark, "all_products", path).first()) == (5, "n", "equipment", "product")


def test_a_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="type"):
        csv_source.read_source(spark, "all_products", _file("p.csv", "id_product,name,category", "5,n,product"))


def test_files_of_other_column_order_are_joined_by_name(spark):
    path = _file("a.csv", "id_status,status_name", "1,active")
    folder = path.rsplit("/", 1)[0]
    for name, text in (("b.csv", "status_name,note,id_status\nclosed,x,2\n"), ("c.csv", "id_status,status_name\n3,new\n"), ("d.csv", "")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    assert sorted(map(tuple, csv_source.read_source(spark, "status", folder).collect())) == [(1, "active"), (2, "closed"), (3, "new")]
    with open(f"{folder}/e.csv", "w") as f:
        f.write("status_name,id\nclosed,2\n")
    with pytest.raises(ValueError, match="e.csv has no column id_status"):
        csv_source.read_source(spark, "status", folder)


QUOTED = ('id_status,"status_name"', '1,"a ""b"", c"', '2,"line one', 'line ""two"""', "3,plain", '4,""', '5,"back\\slash"')


def test_quoted_fields(spark):
    rows = sorted(map(tuple, csv_source.read_source(spark, "status", _file("status.csv", *QUOTED)).collect()))
    assert [r[1] for r in rows][:3] == ['a "b", c', 'line one\nline "two"', "plain"] and rows[4] == (5, "back\\slash")
    lines = [QUOTED[0], QUOTED[1], *QUOTED[4:]]
    one_line = csv_source.read_source(spark, "status", _file("status.csv", *lines), multi_line=False).collect()
    assert sorted(r[0] for r in one_line) == [1, 3, 4, 5]


def test_malformed_rows_stop_the_job_or_go_to_the_rejects(spark):
    path = _file("status.csv", "id_status,status_name", "1,a", "2,b,c", "3", 'x,"d"', "4,e")
    with pytest.raises(Exception, match="(?i)malformed"):
        csv_source.read_source(spark, "status", path).collect()
    good, bad = csv_source.read_source_with_rejects(spark, "status", path)
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (4, "e")]
    assert sorted((r.reject_row or "", r.reject_columns) for r in bad.collect()) == [("", ["id_status"]), ("2,b,c", []), ("3", [])]
    # reading fewer columns must not change which rows are malformed
    assert good.select("status_name").count() == 2 and bad.count() == 3


def test_registered_l0_keys_through_files_with_quotes(spark):
    """The L0 keys through extracts whose texts hold commas, doubled quotes and line breaks."""
    w = Warehouse.from_testdata(spark, SF_SMALL)
    odd = {"all_products": "name", "status": "status_name", "branch": "branch_name", "contract": "registration_end_reason"}
    folder = tempfile.mkdtemp(prefix="subledger-csv-")
    l0 = {}
    for name, df in w.l0.items():
        if name in odd:
            df = df.withColumn(odd[name], F.concat(F.lit('say "'), odd[name], F.lit('", or\n"not" \\ so')))
        l0[name] = df
        csv_source.write_source(df, f"{folder}/{csv_source.L0_FILES[name]}")
    back = Warehouse.from_csv(spark, folder, multi_line={"contract": True})
    for key in [k for k in QUERIES if k.startswith("l0_")]:
        assert _bag(QUERIES[key](back)) == _bag(QUERIES[key](Warehouse(l0))), key


CONTRACT = "id_contract,id_branch,date_contract_valid_from,date_contract_valid_to,date_registered,date_signed,activation_process_date,prolongation_date,registration_end_reason,flag_prolongation,flag_send_inv_email,contract_status"


def test_timestamp_forms_reach_l2(spark):
    path = _file(
        "contracts.csv",
        CONTRACT,
        "1,2,2023-01-31T22:30:00Z,2023-07-31 23:30:00+05:00,2023-01-31 22:30:00+02:00,,,,,true,0,A",
        "2,2,2023-01-31 22:30:00.5 UTC,,2023-01-31 22:30:00,,,,,F,yes,A",
    )
    got = layers.l2_contract(layers.l1_contract(csv_source.read_source(spark, "contract", path))).orderBy("contract_id").collect()
    assert [str(r.contract_valid_from) for r in got] == ["2023-01-31", "2023-01-31"]
    assert [str(r.registered_date) for r in got] == ["2023-01-31", "2023-01-31"]
    assert [str(r.contract_valid_to) for r in got] == ["2023-07-31", "None"]
    assert [(r.flag_prolongation, r.flag_sent_email) for r in got] == [(True, False), (False, True)]


def test_bad_values_stop_the_job_or_go_to_the_rejects(spark):
    path = _file("contracts.csv", CONTRACT, "1,2,yesterday,,2023-01-31 22:30:00,,,,,true,0,A", "x1,2,,,,,,,,maybe,0,B", "3,2,,,,,,,,,0,C")
    with pytest.raises(Exception, match="cannot read as"):
        csv_source.read_source(spark, "contract", path).collect()
    good, bad = csv_source.read_source_with_rejects(spark, "contract", path)
    assert [r.id_contract for r in good.collect()] == [3]
    assert {r.id_contract: r.reject_columns for r in bad.collect()} == {"1": ["date_contract_valid_from"], "x1": ["id_contract", "flag_prolongation"]}


def test_materialize_twice_and_after_an_input_change(spark):
    l0 = testdata.l0_from_testdata(spark, SF_SMALL)
    w = Warehouse(l0)
    before = {n: _bag(getattr(w, n)) for n in ("l2_invoice", "l3_invoice", "l3_contract_duration_bins")}
    folder = tempfile.mkdtemp(prefix="subledger-wh-") + "/wh"
    first = w.materialize(folder)
    second = w.materialize(folder)
    assert first != second and w.use(folder) == second
    for name, want in before.items():
        assert _bag(getattr(w, name)) == want, name
    assert sorted(w.l3_invoice_pp.columns) == ["num_customers", "revenue_segment", "total_purchases", "total_revenue"]
    assert w.l2_invoice_rows is w.l2_invoice  # reports read the table once it is written
    # fewer invoices: the next version follows, the earlier one still reads as it was
    w.l0["invoice"] = l0["invoice"].where("id_invoice % 3 = 0")
    w2 = Warehouse(w.l0)
    third = w2.materialize(folder, tables=("l2_contract", "l2_invoice"))
    assert w2.l2_invoice.count() < sum(before["l2_invoice"].values())
    assert _bag(spark.read.parquet(f"{first}/l2_invoice")) == before["l2_invoice"]
    # a version without its mark does not count
    spark.range(1).write.parquet(f"{folder}/v{10**20 - 1}/l2_contract")
    assert Warehouse(l0).use(folder) == third
    assert w2.drop_versions(folder) == [first, second] and w2.use(folder) == third


def test_views_and_tables_by_name(spark):
    w = Warehouse.from_testdata(spark, SF_SMALL)
    names = w.register("wh_")
    assert len(names) == 14 and "wh_l3_invoice_pp" in names
    n = spark.sql("select count(*) from wh_l2_invoice i join wh_l2_contract c on i.contract_id = c.contract_id").first()[0]
    assert n == w.l2_invoice.count()


def _extracts(spark):
    l0 = testdata.l0_from_testdata(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="subledger-csv-")
    for name, df in l0.items():
        csv_source.write_source(df, f"{folder}/{csv_source.L0_FILES[name]}")
    return folder, l0


def test_sources_and_views_follow_a_replaced_extract(spark):
    folder, l0 = _extracts(spark)
    w = Warehouse.from_csv(spark, folder)
    before = w.l1_contract.count()
    csv_source.write_source(l0["contract"].limit(7).coalesce(1), f"{folder}/contracts.csv")
    assert before > 7 and w.l0["contract"].count() == w.l1_contract.count() == 7
    w.l0["contract"] = l0["contract"].limit(3)
    assert w.l1_contract.count() == 3
    del w.l0["contract"]
    assert w.l1_contract.count() == 7


def test_published_names_in_a_second_session(spark):
    folder, l0 = _extracts(spark)
    db = "wh_" + folder.rsplit("-", 1)[1].lower()
    out = tempfile.mkdtemp(prefix="subledger-wh-") + "/wh"
    w = Warehouse.from_csv(spark, folder)
    first = w.publish(db, out)
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    for name in ("contract", "all_products", "status", "product_purchase", "invoice", "invoice_load", "branch"):
        got = other.sql(f"SELECT * FROM {db}.l0_{name}")
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in w.l0[name].schema]
        assert _bag(got) == _bag(l0[name].select(*got.columns)), name
    for name in VIEWS:
        got = other.sql(f"SELECT * FROM {db}.{name}")
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in getattr(w, name).schema], name
        assert _bag(got) == _bag(getattr(w, name)), name
    count = lambda s, name: s.sql(f"SELECT count(*) FROM {db}.{name}").first()[0]
    whole = count(other, "l2_invoice")
    assert set(w.published(db).values()) == {first} and set(w.published(db)) == set(MATERIALIZED)

    # the view shows a replaced extract at once, the table after the next build
    csv_source.write_source(l0["invoice"].where("id_invoice % 3 = 0"), f"{folder}/invoice.csv")
    assert count(other, "l1_invoice") == w.l1_invoice.count() < l0["invoice"].count()
    assert count(other, "l2_invoice") == whole
    second = w.publish(db, out)
    assert 0 < count(other, "l2_invoice") < whole and set(w.published(db).values()) == {second}

    # a build that fails moves no name and leaves the object on what it had
    with open(f"{folder}/broken.csv", "w") as f:
        f.write(f"{CONTRACT}\n1,2,2023-01-31 22:30:00,,2023-01-31 22:30:00,,,,,maybe,0,A\n")
    bad = Warehouse.from_csv(spark, folder, {**csv_source.L0_FILES, "contract": "broken.csv"})
    bad.point(db, second)
    now = count(other, "l2_invoice")
    with pytest.raises(Exception, match="cannot read as"):
        bad.materialize(out)
    w.l0["contract"] = bad.l0["contract"]
    with pytest.raises(Exception, match="cannot read as"):
        w.materialize(out)
    assert count(other, "l2_invoice") == now == w.l2_invoice.count() and set(w.published(db).values()) == {second}
    with pytest.raises(FileNotFoundError):
        w.point(db, f"{out}/v0")

    # an earlier version by name again; what names stand for is never dropped
    w.point(db, first)
    assert count(other, "l2_invoice") == whole
    assert first not in w.drop_versions(out, db=db) and count(other, "l2_invoice") == whole
    w.point(db, second)
    assert w.drop_versions(out, db=db) == [first]
    spark.sql(f"DROP DATABASE {db} CASCADE")
