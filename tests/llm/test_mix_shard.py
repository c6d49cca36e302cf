"""Raked mixtures and stratified shards."""

import tempfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from subledger.llm.mix import DIMENSIONS, mix_documents, rake, sample_documents
from subledger.llm.shard import assign_shards, write_shards


def test_raking_meets_all_marginals(spark):
    cells = [(f"={s}", f"={v}", f"={t}", 10 + 37 * i % 101) for i, (s, v, t) in enumerate((s, v, t) for s in "abc" for v in "xy" for t in "pq")]
    targets = {"source": {"a": 1, "b": 2, "c": 1}, "lang": {"x": 0.3, "y": 0.7}, "topic": 0.5}
    got = rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), targets, rounds=30).toPandas()
    assert got["weight"].sum() == pytest.approx(1)
    for d in ("source", "lang"):
        whole = sum(targets[d].values())
        for v, w in got.groupby(d)["weight"].sum().items():
            assert w == pytest.approx(targets[d][v[1:]] / whole, abs=1e-6)
    share = got.groupby("topic")["tokens"].sum() ** 0.5
    assert got.groupby("topic")["weight"].sum().to_dict() == pytest.approx((share / share.sum()).to_dict(), abs=1e-6)


@pytest.mark.parametrize("keep", [None, 0.65])
def test_sample_follows_probabilities(spark, keep):
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', int(20 + id % 90))").alias("text"),
        F.expr("if(id % 3 = 0, 'hot', concat('s', id % 7))").alias("source"), F.expr("if(id % 5 = 0, null, 'en')").alias("lang"), F.lit(1).alias("weight"),
    )
    got = mix_documents(df, keep=keep).toPandas()
    assert len(got) == 20_000 and got["probability"].between(0, 1).all()
    if keep is None:
        assert got["probability"].max() == 1
    else:
        assert (got["probability"] * got["tokens"]).sum() == pytest.approx(keep * got["tokens"].sum(), rel=1e-4)
    for _, g in got.groupby(["source", "topic"]):
        assert abs(g["kept"].mean() - g["probability"].mean()) < 5 * (0.25 / len(g)) ** 0.5 + 1e-9
    raised = got[got["lang"].isna()]["probability"].mean() > got[got["lang"].notna()]["probability"].mean()
    assert raised  # the smaller language is kept more often


def test_a_stray_cell_does_not_scale_the_others(spark):
    import corpus_pipeline

    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', int(60 + id % 90))").alias("text"),
        F.expr("concat('s', int(sqrt(id % 16)))").alias("source"), F.expr("element_at(array('en', 'en', 'fr', 'de'), int(id % 4) + 1)").alias("lang"),
    )
    stray = spark.createDataFrame([(-1, "w " * 59, "s0", "zz"), (-2, "w " * 59, "new", "yy")], docs.schema)
    clean, got = (mix_documents(d, keep=0.65).toPandas() for d in (docs, docs.union(stray)))
    for x in (clean, got):
        assert (x["probability"] * x["tokens"]).sum() == pytest.approx(0.65 * x["tokens"].sum(), rel=1e-4)
    assert (got[got["doc_id"] < 0]["probability"] == 1).all()
    both = clean.merge(got, on="doc_id")
    assert (both["probability_x"] - both["probability_y"]).abs().max() < 0.01
    # the stage: most documents stay whatever single rows come in
    assert corpus_pipeline.mixing(spark, docs.union(stray), "").count() > 0.6 * 6000
    # all that the targets name is less than the share: it is kept whole, the rest dropped
    named = mix_documents(docs, {"source": {"s3": 1}, "lang": 1, "topic": 1}, keep=0.65).toPandas()
    assert set(named[named["source"] == "s3"]["probability"]) == {1.0} and set(named[named["source"] != "s3"]["probability"]) == {0.0}
    assert mix_documents(docs.limit(0), keep=0.65).collect() == []


def test_sampled_rows_are_those_kept_and_draw_by_row(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.expr("concat('t', id, repeat(' w', int(id % 90)))").alias("text"),
        F.expr("concat('s', id % 5)").alias("source"), F.lit("en").alias("lang"), F.col("id").alias("a.b"), F.lit(1).alias("draw"), F.lit(2).alias("topic"),
    )
    mixed = mix_documents(df, keep=0.5).toPandas()
    got = sample_documents(df, keep=0.5)
    assert got.columns == df.columns
    rows = got.toPandas()
    assert len(rows) == mixed["kept"].sum() and set(rows["doc_id"].dropna()) == set(mixed[mixed["kept"]]["doc_id"].dropna())
    # rows without an id are drawn one by one
    assert 0.4 < mixed[mixed["doc_id"].isna()]["kept"].mean() < 0.6
    assert sample_documents(df.limit(0)).collect() == []


def test_mix_edge_cases(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "s", "en"), (3, "a b", "null", "en"), (4, "x " * 5000, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mix_documents(df).collect()
    assert len(got) == 5 and sorted(r["tokens"] for r in got) == [1, 1, 1, 3, 5001]
    assert len({r["kept"] for r in got if r["doc_id"] == 1}) == 1
    assert mix_documents(df.limit(0)).collect() == []
    assert set(DIMENSIONS) == {"source", "lang", "topic"}


def _docs(spark):
    return spark.range(5003).select(
        F.col("id").alias("doc_id"), F.expr("if(id % 50 = 0, null, concat('té', id))").alias("text"),
        F.expr("case when id % 3 = 0 then 'hot' when id % 100 = 1 then null when id % 100 = 2 then 'null' else concat('s', id % 11) end").alias("source"),
        F.lit("x").alias("slice"), F.lit(1).alias("u"), F.lit(2).alias("rank"),
    )


@pytest.mark.parametrize("buckets", [1, 64, 4096])
def test_shards_are_even_gapless_and_mixed(spark, buckets):
    got = assign_shards(_docs(spark).repartition(7), buckets=buckets).toPandas()
    assert sorted(got["doc_id"]) == list(range(5003)) and set(got["law"]) == {"rows"}
    sizes = Counter(got["shard"])
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(sizes[s]))
    sources = got.assign(source=got["source"].fillna("\0")).groupby("source")
    for _, g in sources:
        # at a cut the ranks of the other sources are off by under one row each
        per = g.groupby("shard").size().reindex(range(16), fill_value=0)
        assert (per - len(g) / 16).abs().max() <= 1 + sources.ngroups * len(g) / 5003
    text = {i: "" if i % 50 == 0 else f"té{i}" for i in range(5003)}
    for i, size, crc in got[["doc_id", "size", "text_crc32"]].itertuples(index=False):
        assert (size, crc) == (len(text[i].encode()) + 1, zlib.crc32(text[i].encode()))


def test_shards_do_not_depend_on_partitions(spark):
    a, b = (assign_shards(_docs(spark).repartition(n)).select("doc_id", "shard", "slot") for n in (1, 9))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_shard_edge_cases_and_files(spark):
    rows = [(None, None, None)] * 3 + [(7, "a", "s")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = assign_shards(df, n_shards=4).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, t) for s in range(4) for t in range(2)]
    assert assign_shards(df.limit(0)).collect() == []
    folder = tempfile.mkdtemp(prefix="shards-")
    docs = _docs(spark).limit(300)
    write_shards(docs, f"{folder}/out", n_shards=3, rows_per_file=40)
    back = spark.read.parquet(f"{folder}/out").toPandas()
    want = assign_shards(docs, n_shards=3).toPandas().set_index("doc_id")
    assert len(back) == 300 and (back.set_index("doc_id")["shard"].sort_index() == want["shard"].sort_index()).all()


def test_staged_tables_can_be_cleared(spark):
    from subledger.llm.common import clear_staged, drop_staged, stage

    a, b = stage(spark.range(3), "test-a"), stage(spark.range(4), "test-b")
    drop_staged(a)
    assert b.count() == 4
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        spark.read.parquet(a.inputFiles()[0].rsplit("/", 1)[0]).count()
    clear_staged(spark)
    assert stage(spark.range(2), "test-c").count() == 2
