"""Mixing sources to target weights by iterative proportional fitting (native).

Tokens are summed into cells (source, language, topic).  Raking multiplies the
cell weights in turn so that the source, the language and the topic totals meet
their targets; repeated passes converge to the weights nearest to the corpus
that meet all three.  Every document of a cell is then kept with probability
``scale * target weight / present weight``, where ``scale`` makes the largest
probability 1, so expected token totals are exactly proportional to the targets
and no row is ever repeated or forced in.

With that scale the cell of largest ratio alone sets the rate of the corpus, so
one stray row of a value of its own drops most documents.  ``keep`` (a share of
the tokens) sets the rate instead: a cell whose probability would exceed 1 is
kept whole and the others are raked to what is left of the targets, so that the
expected tokens are ``keep`` of all.  The query and the pipeline use it with
``KEEP``; None gives the scale above.

Only the cell table is raked.  Its rows are (sources x languages x topics) at
most, far below the documents, and come from a partial aggregation.

Targets: a dict value -> share per dimension (values not named share nothing
and are dropped), or a power ``alpha``: the target share of a value is its
present token share to that power, normalised.  1 keeps the corpus, 0 makes all
values equal.

The documents table has no topic column.  The query derives one natively from
the form of the text: ``empty``, ``short`` (under 50 words), ``lines`` (under 12
words a line on average) or ``prose``.  Pass ``topic`` to use another column.

Defined results: a document's tokens are its words plus one (the end mark), so
null and empty texts have one token; null source or language is a value of its
own; the draw hashes the id and the text, so rows of one id (or of none) with
different texts are drawn apart and equal rows share a draw; very long texts are
read whole; probabilities have no ties to break; an empty table gives an empty
result; other input columns are ignored (:func:`sample_documents` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import named, stage, table, unit_hash, word_count

DIMENSIONS = ("source", "lang", "topic")
ALPHA = {"source": 0.9, "lang": 0.9, "topic": 0.95}
ROUNDS = 12
#: Share of the tokens that the query and the pipeline keep.
KEEP = 0.65
SEED = "mix-1"


def form_topic(text: Column, words: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(words == 0, "empty").when(words < 50, "short").when(words < 12 * lines, "lines").otherwise("prose")
    )


def _value(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def rake(cells: DataFrame, targets: dict, rounds: int = ROUNDS, keep: float | None = None) -> DataFrame:
    """Add ``weight`` to the cells (columns DIMENSIONS and ``tokens``); weights sum to 1.

    With ``keep``, no weight exceeds the cell's tokens over ``keep`` of all tokens.
    """
    # one partition: the windows below then need no exchange; the cells are few (see above)
    out = cells.coalesce(1)
    total = F.sum("tokens").over(W.partitionBy())
    out = out.withColumn("weight", F.col("tokens").cast("double") / total)
    for d in DIMENSIONS:
        share = F.sum("tokens").over(W.partitionBy(d)).cast("double") / total
        t = targets[d]
        if isinstance(t, dict):
            whole = float(sum(t.values()))
            named = F.lit(0.0)
            for value, part in t.items():
                named = F.when(F.col(d) == ("null" if value is None else f"={value}"), F.lit(part / whole)).otherwise(named)
            out = out.withColumn(f"t_{d}", named)
        else:
            first = (F.row_number().over(W.partitionBy(d).orderBy(*[x for x in DIMENSIONS if x != d])) == 1).cast("int")
            out = out.withColumn(f"t_{d}", F.pow(share, F.lit(float(t)))).withColumn("_first", first)
            out = out.withColumn(f"t_{d}", F.col(f"t_{d}") / F.sum(F.col("_first") * F.col(f"t_{d}")).over(W.partitionBy())).drop("_first")
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = F.sum("weight").over(W.partitionBy(d))
            weight = F.when(now > 0, F.col("weight") * F.col(f"t_{d}") / now).otherwise(0.0)
            out = out.withColumn("weight", weight if keep is None else F.least(weight, F.col("tokens") / (total * F.lit(float(keep)))))
    return out


def fill(raked: DataFrame, keep: float) -> DataFrame:
    """Add ``probability`` = least(1, scale * ratio), its scale such that ``keep`` of all tokens are expected."""
    # from the least ratio up: a cell is whole if the scale that is left once all above it are whole makes it so
    up = W.partitionBy().orderBy("ratio", *DIMENSIONS).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy()
    left = F.lit(float(keep)) * F.sum("tokens").over(whole) - F.sum("tokens").over(whole) + F.sum("tokens").over(up)
    out = raked.withColumn("_whole", (F.col("weight") > 0) & (left * F.col("ratio") >= F.sum("weight").over(up)))
    left = F.lit(float(keep)) * F.sum("tokens").over(whole) - F.sum(F.when(F.col("_whole"), F.col("tokens")).otherwise(0)).over(whole)
    rest = F.sum(F.when(F.col("_whole"), 0.0).otherwise(F.col("weight"))).over(whole)
    scaled = F.when(rest > 0, F.least(F.lit(1.0), left * F.col("ratio") / rest)).otherwise(0.0)
    return out.withColumn("probability", F.when(F.col("_whole"), 1.0).otherwise(scaled))


def _described(docs: DataFrame, topic: str | None, seed: str) -> dict[str, Column]:
    """The topic, tokens and draw of a row, from its own columns."""
    form = F.col(topic) if topic else form_topic(F.col("text"), word_count(F.col("text")))
    return {"topic": form, "tokens": word_count(F.col("text")) + 1, "draw": unit_hash(seed, F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))))}


def cell_probabilities(rows: DataFrame, targets: dict | None = None, rounds: int = ROUNDS, keep: float | None = KEEP) -> DataFrame:
    """k_source, k_lang, k_topic and the probability of each cell; ``rows`` has the dimensions and ``tokens``."""
    keyed = rows.select("tokens", *[_value(F.col(d)).alias(d) for d in DIMENSIONS])
    # summed by all tasks first, so that the one task that rakes reads a row per cell and no partial sums
    cells = stage(keyed.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-sums")
    raked = rake(cells, targets or ALPHA, rounds, keep).withColumn("ratio", F.col("weight") / F.col("tokens"))
    if keep is None:
        raked = raked.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") / F.max("ratio").over(W.partitionBy())))
    else:
        raked = fill(raked, keep)
    return stage(raked.select(*[F.col(d).alias(f"k_{d}") for d in DIMENSIONS], "probability"), "mix-cells")


def mix_documents(docs: DataFrame, targets: dict | None = None, rounds: int = ROUNDS, seed: str = SEED, topic: str | None = None, keep: float | None = KEEP) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, probability (6 digits), kept (by the probability itself)."""
    d = _described(docs, topic, seed)
    slim = stage(docs.select("doc_id", "source", "lang", *[c.alias(n) for n, c in d.items()]), "mix-rows")
    keyed = slim.select("*", *[_value(F.col(x)).alias(f"k_{x}") for x in DIMENSIONS])
    out = keyed.join(cell_probabilities(slim, targets, rounds, keep), [f"k_{x}" for x in DIMENSIONS])
    return out.select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), (F.col("draw") < F.col("probability")).alias("kept")
    )


def sample_documents(docs: DataFrame, targets: dict | None = None, rounds: int = ROUNDS, seed: str = SEED, topic: str | None = None, keep: float | None = KEEP) -> DataFrame:
    """The documents that :func:`mix_documents` keeps, with all their columns, decided where they are read.

    Only the cell table is joined; texts are not shuffled while the planner's
    measured size of the cells lets them be broadcast.
    """
    d = _described(docs, topic, seed)
    cells = cell_probabilities(docs.select("source", "lang", d["topic"].alias("topic"), d["tokens"].alias("tokens")), targets, rounds, keep)
    at = {"source": F.col("source"), "lang": F.col("lang"), "topic": d["topic"]}
    rows = docs.select(F.struct(*named(docs)).alias("row"), d["draw"].alias("draw"), *[_value(c).alias(f"k_{x}") for x, c in at.items()])
    kept = rows.join(cells, [f"k_{x}" for x in DIMENSIONS]).filter("draw < probability")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op9_raked_mixture(spark, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    steps = []
    for i in range(ROUNDS):
        for d in DIMENSIONS:
            prev = f"w{len(steps)}"
            steps.append(f"w{len(steps) + 1} AS (SELECT * EXCLUDE (weight), least(weight * t_{d} / sum(weight) OVER (PARTITION BY {d}), tokens / ((SELECT sum(tokens) FROM cells)::DOUBLE * {KEEP})) AS weight FROM {prev})")
    tgt = []
    for d in DIMENSIONS:
        tgt.append(
            f"m_{d} AS (SELECT {d}, p / sum(p) OVER () AS t_{d} FROM (SELECT {d}, pow(sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM cells), {ALPHA[d]}) AS p FROM cells GROUP BY {d}))"
        )
    joins = " ".join(f"JOIN m_{d} USING ({d})" for d in DIMENSIONS)
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, 'null') AS source, coalesce('=' || lang, 'null') AS lang,
         source AS source0, lang AS lang0,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM documents
), d AS (
  SELECT *, words + 1 AS tokens,
         CASE WHEN words = 0 THEN '=empty' WHEN words < 50 THEN '=short'
              WHEN words < 12 * (length(text) - length(replace(text, chr(10), '')) + 1) THEN '=lines' ELSE '=prose' END AS topic
  FROM docs
), cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL),
{", ".join(tgt)},
w0 AS (SELECT *, tokens::DOUBLE / (SELECT sum(tokens) FROM cells) AS weight FROM cells {joins}),
{", ".join(steps)},
r AS (SELECT *, weight / tokens AS ratio, (SELECT sum(tokens) FROM cells)::DOUBLE AS total FROM w{len(steps)}),
u AS (SELECT *, weight > 0 AND ({KEEP} * total - total + sum(tokens) OVER up) * ratio >= sum(weight) OVER up AS whole FROM r
      WINDOW up AS (ORDER BY ratio, source, lang, topic ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, {KEEP} * total - coalesce(sum(tokens) FILTER (whole) OVER (), 0) AS left_tokens, coalesce(sum(weight) FILTER (NOT whole) OVER (), 0) AS rest FROM u),
p AS (SELECT source, lang, topic, CASE WHEN whole THEN 1.0::DOUBLE WHEN rest > 0 THEN least(1.0::DOUBLE, left_tokens * ratio / rest) ELSE 0.0 END AS probability FROM v)
SELECT doc_id, source0 AS source, lang0 AS lang, substr(topic, 2) AS topic, tokens::BIGINT AS tokens, round(probability, 6) AS probability,
       ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < probability AS kept
FROM d JOIN p USING (source, lang, topic)
"""


ORACLE = {"op9_raked_mixture": _oracle()}
