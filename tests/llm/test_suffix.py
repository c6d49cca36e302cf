"""Repeated byte strings against brute force."""

import random

import numpy as np
import pytest

from subledger.llm.suffix import multikey_order, remove_repeats

from .brute import repeats


def fixture(length: int) -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared, inner = text(3 * length), text(length - 2)
    docs: list[str | None] = [None, "", "x", text(length - 1), "a" * (4 * length), "ab" * length, "abc" * length + "Q" + "abc" * length]
    docs += [text(rng.randrange(40)) + shared + text(rng.randrange(40)) for _ in range(12)]
    docs += [shared[rng.randrange(length) :] + text(30) for _ in range(6)]
    # overlapping cuts of one text, and repeats inside a single document
    docs += [text(10) + shared[a : a + length + rng.randrange(5)] + text(10) for a in range(0, 2 * length, 7)]
    docs += [text(9) + inner + text(9) + inner + text(9), (t := text(length + 1)) + "zz" + t, "\U0001f600é" * length]
    docs += [text(500)] * 4 + [text(2000) for _ in range(10)] + [text(60_000)]
    return list(enumerate(docs))


@pytest.mark.parametrize("length", [20, 50])
def test_matches_brute_force(spark, length):
    docs = fixture(length)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    df = df.selectExpr("*", "1 AS t0", "'x' AS s0", "2 AS segments", "3 AS th")
    got = sorted(tuple(r) for r in remove_repeats(df, length).collect())
    want = sorted(repeats(docs, length))
    assert sum(r[2] > 0 for r in want) > 30
    assert got == want


def test_many_buckets_compare_edges(spark, monkeypatch):
    from subledger.llm import suffix

    monkeypatch.setattr(suffix, "BUCKET_BYTES", 500)
    monkeypatch.setattr(suffix, "BUCKET_ROWS", 40)
    docs = fixture(30)[:-1]
    got = sorted(tuple(r) for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 30).collect())
    assert got == sorted(repeats(docs, 30))


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "x" * 10 + "abcdefghij" * 3), (7, "abcdefghij" * 3), (7, "abcdefghij" * 3), (7, "other text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(key, (tuple(r) for r in remove_repeats(df, 20).collect()))) == sorted(map(key, repeats(rows, 20)))
    assert remove_repeats(df.limit(0), 20).collect() == []


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "start " + "0123456789" * 3), (2, "0123456789" * 3 + " end"), (3, "alone")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in remove_repeats(df, 30, with_text=True).collect()}
    assert got == {1: "start ", 2: " end", 3: None}


def test_multikey_order_sorts_by_all_tokens():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 4, 500), rng.integers(0, 5, 500), rng.integers(0, 6, 500)]
    order = multikey_order(keys)
    rows = list(zip(*[k[order] for k in keys]))
    assert rows == sorted(rows) and sorted(order) == list(range(500))
