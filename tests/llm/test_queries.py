"""Registered queries against their SQL, and the pipeline against a brute-force version."""

import duckdb
import pytest

import corpus_pipeline
from subledger.llm.common import stage, table
from subledger.llm.nbsvm import score_documents
from subledger.llm.registry import ORACLE_SQL, QUERIES

from .brute import components, contamination, repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted([tuple(cell(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_parity(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, want.fetchall())


def _docs(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def test_near_duplicates(spark, con):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op1_bottomk_neardup"](spark, SF).collect()}
    assert got == components(_docs(con))


def test_repeats(spark, con):
    got = sorted(tuple(r) for r in QUERIES["op7_sparse_suffix_dedup"](spark, SF).collect())
    assert got == sorted(repeats(_docs(con), 200))


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark, con):
    """Each stage on its own input; the last must place every document left exactly once."""
    docs = table(spark, SF, "documents")
    fields = docs.columns
    inputs = []
    for name, apply in corpus_pipeline.STAGES:
        inputs.append(docs.collect())
        docs = stage(apply(spark, docs, SF), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == fields
    kept = [{r["doc_id"] for r in rows} for rows in inputs]
    assert all(len(rows) == len(ids) for rows, ids in zip(inputs, kept))
    scores = {r["doc_id"]: r["predicted"] for r in score_documents(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert kept[1] == {i for i, p in scores.items() if p}
    comp = components([(r["doc_id"], r["text"]) for r in inputs[1]])
    assert kept[2] == {i for i, (_, c) in comp.items() if i == c}
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert kept[3] == {r[0] for r in contamination([(r["doc_id"], r["text"]) for r in inputs[2]], items) if not r[-1]}
    assert kept[4] < kept[3] and len(kept[4]) > len(kept[3]) / 4
    last = docs.collect()
    assert {r["doc_id"] for r in last} == kept[4] and len({(r["shard"], r["slot"]) for r in last}) == len(kept[4])
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, last))


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF), "test-empty")
        assert docs.count() == 0


def test_pipeline_with_odd_column_names(spark):
    """Extra columns of any name, also those that the operators use, pass every stage but the last unchanged."""
    docs = table(spark, SF, "documents")
    odd = ["my col", "a-b", "a.b", "_id", "row", "kept", "_words", "ids", "b`c", "score"]
    for i, name in enumerate(odd):
        docs = docs.withColumn(name, docs["doc_id"] * 10 + i)
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF), "test-odd")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == [*table(spark, SF, "documents").columns, *odd], name
            for r in docs.collect():
                assert [r[len(r) - len(odd) + i] for i in range(len(odd))] == [r["doc_id"] * 10 + i for i in range(len(odd))]
        assert docs.count() > 0
