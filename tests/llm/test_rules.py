"""Risk-controlled cutoffs: exact tails, the guarantee, edge cases."""

import math

from pyspark.sql import functions as F

from subledger.llm.rules import CUTOFFS, RULES, binomial_tail, features, judge

WORDS = "the of and to in that was it for on with as his they at be this from had".split()


def _text(n, step=1):
    return " ".join(f"{WORDS[(i * step) % 19]}{i}" for i in range(n))


def test_binomial_tail_is_exact(spark):
    cases = [(1, 0), (50, 0), (50, 1), (2000, 5), (2000, 9), (30_000, 120), (400_000, 1900)]
    df = spark.createDataFrame(cases, "n long, k long")
    for n, k, p in df.select("n", "k", binomial_tail(F.col("n"), F.col("k"), 0.005)).collect():
        log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.005) + (n - i) * math.log(0.995) for i in range(k + 1)]
        assert math.isclose(p, math.fsum(map(math.exp, log)), rel_tol=1e-6)


def test_cutoffs_bound_false_rejection(spark):
    # 3000 good documents in one language, none in the other; 5 of them have symbols
    good = [(i, _text(60) + (" ###" if i < 5 else ""), "en") for i in range(3000)]
    bad = [(10_000 + i, _text(60) + " $$$ %%%" * 20, "en") for i in range(50)] + [(20_000, _text(60) + " $$$ %%%" * 20, "xx"), (20_001, None, None)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string").withColumn("n_words", F.lit("clash")).repartition(4)
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad] + [(None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in judge(docs, labels).collect()}
    assert len(got) == 3052
    assert all(got[i]["kept"] for i, _, _ in good[5:])
    cut = got[0]["cut_symbols"]
    lost = sum(not got[i]["kept"] for i, _, _ in good)
    assert cut in CUTOFFS["symbols"] and lost <= 0.02 * 3000
    assert not any(got[10_000 + i]["kept"] for i in range(50))
    # no holdout in that language: the rules stay off
    assert got[20_000]["kept"] and got[20_000]["cut_symbols"] is None
    assert got[20_001]["base_failed"] and not got[20_001]["kept"] and got[20_001]["n_words"] == 0


def test_few_labels_give_cutoffs_in_every_stratum(spark):
    langs = ("en", "fr", "de", "es")
    good = [(i, _text(60) + (" ###" if i < 4 else ""), langs[i % 4]) for i in range(4 * 300)]
    bad = [(10_000 + i, _text(60) + " $$$ %%%" * 20, langs[i % 4]) for i in range(40)]
    few = [(20_000 + i, _text(60), "xx") for i in range(100)] + [(21_000, _text(60) + " $$$ %%%" * 20, "xx")]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good + few[:100]] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in judge(docs, labels).collect()}
    assert not any(got[i]["kept"] for i, *_ in bad)
    for lang in langs:
        mine = [got[i] for i, _, v in good if v == lang]
        assert sum(not r["kept"] for r in mine) <= 0.02 * len(mine)
        assert all(r["cut_symbols"] is not None for r in mine)
    # too few labels for any step: the rules stay off
    assert got[21_000]["kept"] and got[21_000]["cut_symbols"] is None


def test_counts_and_empty_tables(spark):
    t = "a b c a b c x\n\na b c a b c x\n \n#%é|<"
    docs = spark.createDataFrame([(1, t, "en"), (1, t, "en"), (2, "", "en"), (3, " \t", None)], "doc_id long, text string, lang string")
    f = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in features(docs).collect())
    # "c x a", between the two lines, occurs once
    assert f == [(1, 15, 19, 4, 1, 14), (1, 15, 19, 4, 1, 14), (2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["kept"] for r in judge(docs, none).collect()] == [False] * 4
    assert judge(docs.limit(0), none).collect() == []
    assert len(RULES) == len(CUTOFFS)
