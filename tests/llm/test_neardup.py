"""Near-duplicates against all-pairs brute force."""

import random

import pytest
from pyspark.sql import functions as F

from subledger.llm.components import components
from subledger.llm import neardup
from subledger.llm.neardup import link_documents, sure_share

from .brute import components as brute


def _text(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def _edit(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def fixture() -> list[tuple[int, str | None]]:
    rng = random.Random(3)
    docs: list[str | None] = [None, "", " \t\n", "one", "ONE", "two words", "Two\twords\n", "a b c d e", "A B C D E f"]
    base = _text(rng, 300)
    docs += [base] * 5 + [base.upper()] + [_edit(rng, base, k) for k in (1, 2, 3, 4, 5, 6, 8, 12, 40)]
    # a chain: neighbours are linked, its ends are not
    link = _text(rng, 200)
    for _ in range(12):
        docs.append(link)
        link = _edit(rng, link, 2)
    # many variants of one text, and many texts around one passage
    hot, passage = _text(rng, 120), _text(rng, 60)
    docs += [_edit(rng, hot, rng.randrange(4)) for _ in range(60)]
    docs += [f"{_text(rng, 20 + i % 40)} {passage} {_text(rng, 10)}" for i in range(60)]
    docs += [f"{passage} {_text(rng, rng.randrange(8))}" for _ in range(30)]
    docs += [_text(rng, rng.randrange(1, 30)) for _ in range(40)]
    docs.append(_text(rng, 60_000))
    docs.append(docs[-1] + " tail")
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("rounds", [0, 1])
def test_components_match_brute_force(spark, rounds):
    docs = fixture()
    want = {i: (n, c, i == c) for i, (n, c) in brute(docs).items()}
    assert len({c for _, c, _ in want.values()}) < len(docs) - 50
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("component", F.lit(1)).repartition(5)
    got = {r[0]: (r[1], r[2], r[3]) for r in link_documents(df, rounds=rounds).collect()}
    assert got == want


def _template(n, own):
    """Documents of one text and words of their own, as pages of one template are."""
    rng = random.Random(n)
    shared = _text(rng, 200)
    return [(i, f"{shared} " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(own(i)))) for i in range(n)]


def _met(spark, docs, monkeypatch):
    """Rows that the lists of differences join with one another, the hubs aside, and the result."""
    rows = []
    lists = neardup._difference_lists

    def counted(*args):
        out = lists(*args)
        rows.append(out.groupBy("hub", "value").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0)
        return out

    monkeypatch.setattr(neardup, "_difference_lists", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sum(rows), {r[0]: r[2] for r in link_documents(df).collect()}


def test_unlinked_variants_of_one_text_are_not_compared_in_pairs(spark, monkeypatch):
    for n in (100, 200, 400):
        pairs, got = _met(spark, _template(n, lambda i: 25), monkeypatch)
        monkeypatch.undo()
        assert pairs <= n
        assert got == {i: i for i in range(n)}


def test_variants_on_both_sides_of_the_threshold(spark):
    docs = _template(150, lambda i: 8 + i % 25)
    want = {i: c for i, (_, c) in brute(docs).items()}
    assert len(set(want.values())) > 20
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r[0]: r[2] for r in link_documents(df).collect()} == want


def test_share_follows_sketch_size_and_threshold():
    assert sure_share(64, 85) == 37 / 64
    assert sure_share(64, 60) < 20 / 64 and sure_share(16, 85) < 6 / 16


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (4, "A b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in link_documents(df).collect())
    assert got == sorted(
        [("1", 2, "1", True), ("1", 2, "1", True), ("None", 2, "None", True), ("2", 0, "2", True), ("3", 0, "3", True), ("4", 2, "1", False)]
    )
    assert link_documents(df.limit(0)).collect() == []


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_of_paths_stars_and_cycles(spark, small):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (5, 5), (7, 6)]
    ids = {x: y for x, y in zip(range(300), rng.sample(range(10**6), 300))}
    edges = [(ids[a], ids[b]) for a, b in edges]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
    groups = [[ids[i] for i in range(41)], [ids[i] for i in range(100, 150)], [ids[i] for i in (200, 201, 202)]]
    assert got == {x: min(g) for g in groups for x in g}
