"""Quality rules with risk-controlled cutoffs (native DataFrame operations).

Each rule rejects a document whose feature exceeds a cutoff.  Cutoffs are not
set by hand: labelled holdout documents of label 1 show how often a cutoff
would reject a good document, per stratum (language).  A cutoff is admissible
if the exact binomial test rejects "the false rejection rate is above
``alpha / rules``" at level ``delta / (strata * rules * cutoffs)`` (Bonferroni
over every test made).  The strictest admissible cutoff of each stratum and rule
is used; a stratum without one leaves the rule off.  So with probability
``1 - delta`` at most ``alpha`` of the good documents of every stratum are lost.

With labels shared among many tests these levels need some 1,600 good labels a
stratum, so few strata have a rule.  :func:`judge` therefore tests one ladder per
stratum: its step ``i`` has the i-th cutoff of every rule, a test takes the joint
rejection of all rules at the full ``alpha`` and level ``delta / strata``, from
the loosest step on, and the last step before the first failure is used (fixed
sequence, same guarantee).  217 good labels then do for four strata.  The query
does the same; ``ladder=False`` gives every rule a cutoff of its own instead.

Features (integers, per document):

* ``symbols``: symbol characters per 1000 words
* ``dup_lines``: repeated lines per 1000 lines with a word
* ``repeats``: words in repeated 3-word windows per 1000 words
* ``word_len``: code points per 100 words

The fixed base rule (under 50 words, or more than half of the words repeated)
is outside the guarantee and never relaxed; documents that it fails are not
used to set cutoffs.

Defined results: null and empty texts have no words and fail the base rule; a
null language is a stratum of its own; of several labels for one id the lowest
counts; without labels no cutoff is admissible and only the base rule rejects;
an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD_GAP, stage, table

RULES = ("symbols", "dup_lines", "repeats", "word_len")
#: Candidate cutoffs, strictest first.
CUTOFFS = {
    "symbols": (0, 5, 10, 20, 50, 100, 200, 400, 800, 1600),
    "dup_lines": (0, 20, 50, 100, 150, 200, 300, 400, 600, 800),
    "repeats": (0, 20, 50, 100, 150, 200, 300, 400, 450, 490),
    "word_len": (520, 540, 560, 580, 600, 620, 650, 700, 800, 1000),
}
ALPHA, DELTA = 0.02, 0.05


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the same text.

    Windows are packed as (hash bits, position) into longs, so one primitive sort
    brings equal windows together; neighbours are then compared by their words.
    """
    bits = F.ceil(F.log2(n + 1)).cast("int")
    at = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    packed = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), (n - 3).cast("int")),
            lambda i: F.call_function("shiftleft", F.xxhash64(*at(i)), F.col("_bits")).bitwiseOR(i.cast("long")),
        )
    )
    place = lambda p: p.bitwiseAND(F.col("_mask")).cast("int")
    return bits, packed, place, at


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", text.alias("_t")).withColumn("_w", _words(F.col("_t")))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    n, w = F.col("n_words"), F.col("_w")
    bits, packed, place, at = _repeat_words(w, n)
    d = d.withColumn("_bits", bits).withColumn("_mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    d = d.withColumn("_p", F.when(n >= 3, packed))
    p = F.col("_p")
    top = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    words_of = lambda x: F.struct(*at(place(x)))
    same = lambda x, y: (top(x) == top(y)) & (words_of(x) == words_of(y))
    twice = F.filter(p, lambda x, i: ((i > 0) & same(x, F.get(p, i - 1))) | same(x, F.get(p, i + 1)))
    d = d.withColumn("_r", F.sort_array(F.transform(twice, place)))
    r = F.col("_r")
    # each repeated window covers its 3 words, or as many as lie before the next one
    cover = F.aggregate(
        F.transform(r, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(r, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_l", lines)
    d = d.select(
        "doc_id",
        "lang",
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    ratio = lambda x, per, of: F.when(F.col(of) > 0, F.expr(f"{x} * {per} div {of}")).otherwise(F.lit(0)).cast("long")
    return d.select(
        "*",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        ratio("n_symbols", 1000, "n_words").alias("symbols"),
        ratio("n_dup_lines", 1000, "n_lines").alias("dup_lines"),
        ratio("n_repeat_words", 1000, "n_words").alias("repeats"),
        ratio("word_chars", 100, "n_words").alias("word_len"),
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("null")).alias("stratum"),
    )


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k) for k < n * rate, summed from its largest term down."""
    log_choose = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.lit(0.0),
        lambda a, i: a + F.ln((n - i + 1).cast("double") / i),
    )
    log_last = log_choose + k * math.log(rate) + (n - k) * math.log(1 - rate)
    odds = (1 - rate) / rate
    down = F.aggregate(
        F.when(k >= 1, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct(
            (a["t"] * i / (n - i + 1) * odds).alias("t"), (a["s"] + a["t"] * i / (n - i + 1) * odds).alias("s")
        ),
        lambda a: a["s"],
    )
    return F.exp(log_last) * down


def choose_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and one column per rule: its strictest admissible cutoff, or null.

    ``labelled``: features and ``quality`` of holdout documents.
    """
    good = labelled.filter((F.col("quality") == 1) & ~F.col("base_failed"))
    grid = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).cast("long").alias("cutoff"), F.col(r).alias("value"))
            for r in RULES
            for i, c in enumerate(CUTOFFS[r])
        ]
    )
    tests = good.select("stratum", F.inline(grid)).groupBy("stratum", "rule", "step", "cutoff").agg(
        F.count("*").alias("n"), F.sum((F.col("value") > F.col("cutoff")).cast("long")).alias("k")
    )
    # every test made counts: strata x rules x cutoffs
    made = F.count("*").over(W.partitionBy())
    rate = alpha / len(RULES)
    passed = tests.withColumn("made", made).filter(
        (F.col("k") < F.col("n") * F.lit(rate)) & (binomial_tail(F.col("n"), F.col("k"), rate) <= F.lit(delta) / F.col("made"))
    )
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def choose_ladder(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """As :func:`choose_cutoffs`, with one step of the ladder for all rules of a stratum."""
    good = labelled.filter((F.col("quality") == 1) & ~F.col("base_failed"))
    n_steps = min(len(c) for c in CUTOFFS.values())
    lost = [F.greatest(*[F.col(r) > CUTOFFS[r][i] for r in RULES]).cast("long") for i in range(n_steps)]
    tests = good.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in lost]).alias("_k"))
    tests = tests.withColumn("strata", F.count("*").over(W.partitionBy())).select("stratum", "n", "strata", F.posexplode("_k").alias("step", "k"))
    # a stricter step loses every document that a looser one loses, so the steps that pass have no gap
    passed = tests.filter(
        (F.col("k") < F.col("n") * F.lit(alpha)) & (binomial_tail(F.col("n"), F.col("k"), alpha) <= F.lit(delta) / F.col("strata"))
    )
    step = passed.groupBy("stratum").agg(F.min("step").alias("step"))
    return step.select("stratum", *[F.get(F.array(*[F.lit(c).cast("long") for c in CUTOFFS[r]]), F.col("step")).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, ladder: bool = True) -> DataFrame:
    """One row per document: counts, base_failed, kept, rejected_by and the cutoffs used."""
    f = stage(features(docs), "rules-features")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cutoffs = stage((choose_ladder if ladder else choose_cutoffs)(f.join(marks, "doc_id"), alpha, delta), "rules-cutoffs")
    out = f.join(cutoffs, "stratum", "left")
    broken = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    return out.withColumn("rejected_by", broken).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"),
        F.array_join("rejected_by", ",").alias("rejected_by"),
        *[f"cut_{r}" for r in RULES],
    )


def op3_risk_controlled_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop(*[f"cut_{r}" for r in RULES])


def _oracle() -> str:
    steps = range(min(len(c) for c in CUTOFFS.values()))
    ladder = ", ".join("(" + ", ".join(map(str, [i, *[CUTOFFS[r][i] for r in RULES]])) + ")" for i in steps)
    names = ", ".join(f"cut_{r}" for r in RULES)
    lost = " OR ".join(f"f.{r} > g.cut_{r}" for r in RULES)
    broken = ", ".join(f"CASE WHEN {r} > cut_{r} THEN '{r}' END" for r in RULES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n
  FROM (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d, unnest(range(1, len(w) - 1)) AS u(i))
), rep AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM win, unnest([0, 1, 2]) AS v(o) WHERE n > 1 GROUP BY rid
), f0 AS (
  SELECT d.doc_id, d.lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, l.n_lines, l.n_lines - l.n_kinds AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid) JOIN (
    SELECT rid, len(ls)::BIGINT AS n_lines, len(list_distinct(ls))::BIGINT AS n_kinds
    FROM (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)) l USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(n_symbols * 1000 // nullif(n_words, 0), 0) AS symbols, coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS dup_lines,
         coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeats, coalesce(word_chars * 100 // nullif(n_words, 0), 0) AS word_len,
         coalesce('=' || lang, 'null') AS stratum
  FROM f0
), marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), ladder AS (SELECT * FROM (VALUES {ladder}) AS g(step, {names})
), tests AS (
  SELECT stratum, step, count(*) AS n, count(*) FILTER ({lost}) AS k
  FROM f JOIN marks USING (doc_id), ladder AS g WHERE quality = 1 AND NOT base_failed GROUP BY ALL
), steps AS (
  SELECT stratum, min(step) AS step FROM (
    SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))
               FROM unnest(range(0, k + 1)) AS u(i)) AS p FROM tests)
  WHERE k < n * {ALPHA} AND p <= {DELTA} / (SELECT count(DISTINCT stratum) FROM tests) GROUP BY stratum
), cuts AS (SELECT stratum, {names} FROM steps JOIN ladder USING (step)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(list_filter([{broken}], lambda x: x IS NOT NULL)) = 0 AS kept,
       array_to_string(list_filter([{broken}], lambda x: x IS NOT NULL), ',') AS rejected_by
FROM f LEFT JOIN cuts USING (stratum)
"""


ORACLE = {"op3_risk_controlled_rules": _oracle()}
