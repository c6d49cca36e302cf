"""Decontamination against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from subledger.llm.decontam import is_contaminated, keep_uncontaminated, match_documents, remove_spans

from .brute import contamination


def fixture():
    rng = random.Random(8)
    text = lambda n, v=30: " ".join(f"v{rng.randrange(v)}" for _ in range(n))
    items = [(1, text(40)), (2, text(13)), (3, text(20)), (3, text(15)), (4, "solo"), (5, "v1 v2"), (6, None), (7, " . "), (None, text(14)), (8, text(5)), (9, text(300, 400))]
    items += [(10, items[0][1]), (11, " ".join(items[0][1].split()[5:25]))]
    docs = [None, "", "...", "SOLO", "V1, v2!", text(2000), text(500, 3)]
    for _, t in items:
        if t:
            docs += [f"{text(6, 900)} {t.upper()} {text(5, 900)}", t.replace(" ", " -- "), f"{text(400, 900)} {t}", t[: len(t) // 2], t[len(t) // 3 :]]
    long = items[10][1].split()
    docs += [" ".join(long[a : a + rng.randrange(10, 30)]) for a in range(0, 280, 13)]
    return list(enumerate(docs)), items


@pytest.mark.parametrize(("block", "piece"), [(200_000, 20_000), (80, 40)])
def test_matches_brute_force(spark, block, piece):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"items": F.lit(1), "row": F.lit("r"), "n_hit": F.lit(2)}).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    m = match_documents(d, b, block_words=block, piece_words=piece)
    got = m.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join(F.array_sort("items"), ","), 256), is_contaminated())
    assert sorted(tuple(r) for r in got.collect()) == sorted(contamination(docs, items))


def test_spans_are_cut_and_columns_pass(spark):
    words = " ".join(f"q{i}" for i in range(13))
    rows = [(1, f"Keep this. {words}! And this " + "pad " * 300, "en"), (2, words, "de"), (3, "clean", None), (None, None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    b = spark.createDataFrame([("a", words)], "item_id string, text string")
    got = {r["doc_id"]: r["text"] for r in remove_spans(match_documents(d, b)).collect()}
    assert got == {1: "Keep this. ! And this " + "pad " * 300, 3: "clean", None: None}
    for blocks in ({}, {"length": "n_chars"}):
        kept = keep_uncontaminated(d.withColumn("n_chars", F.length("text")), b, **blocks)
        assert kept.columns == [*d.columns, "n_chars"]
        n = len(got[1]) if blocks else len(rows[0][1])
        want = [(1, got[1], "en", n), (3, "clean", None, 5), (None, None, "x", None)]
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_cut_spans_keep_other_bytes(spark):
    item = " ".join(f"ü{i}" for i in range(14))
    text = f"é {item} \U0001f600 {'x ' * 600}{item}"
    d = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    b = spark.createDataFrame([("a", item)], "item_id string, text string")
    want = f"é  \U0001f600 {'x ' * 600}"
    for block in (200_000, 5):
        m = match_documents(d, b, block_words=block)
        assert [r["text"] for r in remove_spans(m).collect()] == [want] * 2


def test_one_worker_a_task_whatever_the_blocks(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = match_documents(d, spark.createDataFrame(items, "item_id long, text string"), block_words=80, piece_words=40)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    r = match_documents(d, b).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (2, 0, [])
    assert match_documents(d.limit(0), b).collect() == []
