"""Sets of ids as bitmaps against sets of Python, and what their plans shuffle."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from subledger.operators.idsets import count_ids, distinct_ids, id_sets, merge_id_sets
from subledger.plans.registry import QUERIES
from subledger.plans.warehouse import Warehouse
from tests.conftest import SF_SMALL

EDGES = [0, 1, 63, 64, 65, -1, -64, -65, 2**63 - 1, -(2**63), 2**40 + 7]


def _rows(seed=3, n=3000):
    rnd = random.Random(seed)
    ids = [*EDGES, *range(500), *(rnd.randint(-(2**62), 2**62) for _ in range(200))]
    rows = []
    for _ in range(n):
        # id 5 holds a third of the rows
        k = 5 if rnd.random() < 0.33 else rnd.choice([*ids, None])
        rows.append((k, rnd.choice(["a", "b", None]), rnd.choice([True, False, None]), rnd.random() < 0.5))
    rows += [(k, "edge", True, True) for k in EDGES] + [(None, "none", True, True)]
    return rows


def test_distinct_ids_equal_python_sets(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k long, g string, x boolean, y boolean").repartition(7)
    assert distinct_ids(df, "k", "n").collect() == [(len({r[0] for r in rows} - {None}),)]
    got = {r.grp: r.n for r in distinct_ids(df, "k", "n", by=F.col("g").alias("grp")).collect()}
    assert got == {g: len({r[0] for r in rows if r[1] == g} - {None}) for g in ("a", "b", None, "edge", "none")}
    assert got["edge"] == len(EDGES) and got["none"] == 0


def test_sets_combine_within_a_word(spark):
    rows = _rows(seed=4)
    df = spark.createDataFrame(rows, "k long, g string, x boolean, y boolean")
    sets = id_sets(df, "k", {"x": F.col("x"), "y": F.col("y"), "all": None})
    x, y = ({r[0] for r in rows if r[i]} - {None} for i in (2, 3))
    row = count_ids(
        sets,
        {
            "x": "x",
            "both": F.col("x").bitwiseAND(F.col("y")),
            "only": F.col("x").bitwiseAND(F.bitwise_not("y")),
            "all": "all",
        },
    ).first()
    assert row.asDict() == {"x": len(x), "both": len(x & y), "only": len(x - y), "all": len({r[0] for r in rows} - {None})}


def test_sets_of_extracts_merge_without_their_rows(spark):
    rows = _rows(seed=5)
    df = spark.createDataFrame(rows, "k long, g string, x boolean, y boolean")
    parts = [id_sets(df.where(c), "k", {"ids": None, "x": F.col("x")}, by=[F.col("g")]) for c in ("y", "not y")]
    merged = merge_id_sets(*parts, names=["ids", "x"])
    got = {r.g: (r.n, r.nx) for r in count_ids(merged, {"n": "ids", "nx": "x"}, by=["g"]).collect()}
    want = {}
    for g in ("a", "b", None, "edge"):
        want[g] = tuple(len({r[0] for r in rows if r[1] == g and (w is None or r[w])} - {None}) for w in (None, 2))
    assert got == want


@pytest.mark.parametrize("kind", ["byte", "short", "int", "long"])
def test_every_integer_type(spark, kind):
    df = spark.createDataFrame([(-1,), (0,), (63,), (64,), (64,), (None,)], f"k {kind}")
    assert distinct_ids(df, "k", "n").first().n == 4


def test_empty_input_and_other_types(spark):
    empty = spark.createDataFrame([], "k long, g string")
    assert distinct_ids(empty, "k", "n").collect() == [(0,)]
    assert distinct_ids(empty, "k", "n", by=F.col("g")).collect() == []
    with pytest.raises(TypeError, match="string"):
        distinct_ids(empty, "g", "n")


@pytest.mark.parametrize(
    "key",
    [
        "unique_contracts",
        "trial_customers",
        "non_trial_customers",
        "churn_same_day_vs_kept",
        "lost_after_discontinuation",
        "products_ended_with_contract",
        "contract_duration_bins",
        "customers_per_year",
    ],
)
def test_reports_count_words_not_ids(spark, key):
    w = Warehouse.from_testdata(spark, SF_SMALL)
    w.materialize(tables=("l2_contract", "l2_product_purchase", "l3_pp_product_contract"))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[key](w).explain()
    aggregates = [line for line in buf.getvalue().splitlines() if "Aggregate(" in line]
    assert any("bit_or" in line for line in aggregates)
    assert not any("distinct" in line or "keys=[contract_id" in line or "keys=[product_id" in line for line in aggregates)
