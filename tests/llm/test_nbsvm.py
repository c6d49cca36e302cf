"""The quality classifier: held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest

from subledger.llm.common import table
from subledger.llm.nbsvm import dual_descent, keep_good, logistic_curve, score_documents


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.01"
    got = score_documents(table(spark, d, "documents"), table(spark, d, "labels")).toPandas()
    return got, table(spark, d, "labels").toPandas()


def test_held_out_accuracy(scored):
    got, labels = scored
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    m = got[got["held_out"]].merge(labels, on="doc_id")
    good, bad = m[m["quality"] == 1]["score"].to_numpy(), m[m["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert ((m["score"] >= 0.7) == (m["quality"] == 1)).mean() > 0.93


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark, scored):
    got, labels = scored
    d = "/root/testdata/sf0.01"
    flipped = labels.copy()
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in flipped["doc_id"]])
    flipped.loc[held, "quality"] = 1 - flipped.loc[held, "quality"]
    docs = table(spark, d, "documents").selectExpr("doc_id", "text", "'zz' AS lang", "0 AS label", "1 AS score", "'q' AS part")
    again = score_documents(docs, spark.createDataFrame(flipped)).toPandas()
    a, b = (x.sort_values("doc_id")["score"].to_numpy() for x in (got, again))
    assert np.allclose(a, b, atol=1e-9)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x y"), (4, "z" * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = score_documents(docs, none).collect()
    assert len(got) == 5 and all(r["score"] == 0.5 and r["predicted"] == 0 for r in got)
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)] + [(None, 0), (4, None)], "doc_id long, quality int")
    assert all(0.5 < r["score"] < 1 for r in score_documents(docs, one).collect())
    assert score_documents(docs.limit(0), one).collect() == []
    kept = keep_good(docs.selectExpr("*", "'en' AS lang", "7 AS row"), one, threshold=0.0)
    assert kept.columns == ["doc_id", "text", "lang", "row"] and kept.count() == 5


def test_descent_and_curve_reach_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(200)]
    truth = rng.normal(size=20)
    y = np.array([1.0 if truth[r].sum() > 0 else -1.0 for r in rows])
    w, b = dual_descent(rows, y, np.ones(20), np.full(200, 10.0), epochs=300)
    margin = np.array([w[r].sum() / np.sqrt(5) + b for r in rows])
    assert ((margin > 0) == (y > 0)).mean() > 0.97
    slope, offset = logistic_curve(margin, (y > 0).astype(int))
    assert slope > 0 and abs(offset) < 5
