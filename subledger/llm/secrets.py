"""Incremental secret scan over a content-addressed blob ledger (native DataFrame operations).

Every historical version of a file is addressed by the SHA-256 of its text.
The ledger holds the (blob, rule, rule version) pairs scanned so far and their
findings.  A run scans only pairs that the ledger lacks: equal texts are read
once, and a new version of a rule costs a scan with that rule alone.  Findings
are then joined back to every (path, version) that holds the blob.

Rules find leftmost non-overlapping matches with Java's regular expressions.
Offsets come from the pieces between matches (``split`` and
``regexp_extract_all`` with one pattern), summed along a window per blob and
rule, so only texts with a match leave the scan as rows.

A blob that a third of all rows share is one row until the findings are
joined back; that join is skewed on the side of the versions only, which
adaptive execution splits.

Defined results: a null text is empty and has no spans; repeated (path,
version) rows each get a row; an empty table gives an empty result; other input
columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage, table


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: Group whose length is tested, and the least length that counts.
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
#: In the order in which equal starts are listed; the first three are the base rules.
RULES = (
    Rule("assign", 1, rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    # a run of 16 or more is the same match as a whole run of that length
    Rule("hex", 1, "[0-9a-f]{16,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = 3


def _hits(rule: Rule, text: Column, todo: Column) -> Column:
    """Per match: kind, its number, code points before it since the last match, its length, the tested length."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    entries = F.transform(
        F.arrays_zip(whole.alias("w"), tested.alias("t"), gaps.alias("g")),
        lambda x, i: F.struct(
            F.lit(rule.kind).alias("kind"),
            i.alias("no"),
            x["g"].alias("gap"),
            F.length(x["w"]).alias("len"),
            F.length(x["t"]).alias("tested"),
        ),
    )
    # the piece after the last match has no match of its own
    entries = F.slice(entries, 1, F.size(entries) - 1)
    empty = F.array().cast("array<struct<kind:string,no:int,gap:int,len:int,tested:int>>")
    return F.when(F.array_contains(todo, rule.kind) & text.rlike(rule.pattern), entries).otherwise(empty)


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind, start, end (code points, end exclusive) for blobs (blob, text, todo)."""
    hits = F.concat(*[_hits(r, F.col("text"), F.col("todo")) for r in rules])
    rows = blobs.select("blob", F.monotonically_increasing_id().alias("_row"), hits.alias("_h")).filter(F.size("_h") > 0)
    rows = rows.select("blob", "_row", F.inline("_h"))
    upto = W.partitionBy("blob", "_row", "kind").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("long"))
    least = F.lit(0)
    for r in rules:
        least = F.when(F.col("kind") == r.kind, F.lit(r.least)).otherwise(least)
    return rows.filter(F.col("tested") >= least).select("blob", "kind", (F.col("end") - F.col("len")).alias("start"), "end").distinct()


def scan(versions: DataFrame, scanned: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions with their blob, newly scanned pairs, new findings).

    ``versions``: path, version, text.  ``scanned``: the ledger's pairs (blob,
    kind, rule_version), or None for an empty ledger.
    """
    v = versions.select("path", "version", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    addressed = stage(v.select("path", "version", "blob"), "secrets-versions")
    one = addressed.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("_at"))
    pairs = one.select("blob", "_at", F.inline(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])))
    if scanned is not None:
        pairs = pairs.join(scanned, ["blob", "kind", "rule_version"], "left_anti")
    unseen = pairs.groupBy("blob").agg(F.first("_at").alias("_at"), F.collect_set("kind").alias("todo"))
    # one place per blob: texts are dealt by their place, so copies of one text cannot meet in a task
    places = unseen.select(F.col("_at.path").alias("_p"), F.col("_at.version").alias("_v"), F.col("blob").alias("_b"), "todo")
    at = F.col("path").eqNullSafe(F.col("_p")) & F.col("version").eqNullSafe(F.col("_v")) & (F.col("blob") == F.col("_b"))
    found = stage(find_spans(v.join(places, at).select("blob", "text", "todo"), rules), "secrets-findings")
    return addressed, pairs.select("blob", "kind", "rule_version"), found


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger folder lacks, append to it, and return every finding per (path, version).

    Findings are written before the pairs that vouch for them: a run that dies
    in between is scanned again, and repeated findings are removed on reading.
    """
    spark = versions.sparkSession
    try:
        scanned = spark.read.parquet(f"{ledger}/scanned").select("blob", "kind", "rule_version").distinct()
    except Exception as e:  # a new ledger has no tables yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        scanned = None
    addressed, pairs, found = scan(versions, scanned, rules)
    pairs = stage(pairs, "secrets-pairs")
    now = {r.kind: r.version for r in rules}
    number = F.create_map(*[F.lit(x) for kv in now.items() for x in kv])
    found.withColumn("rule_version", number[F.col("kind")]).write.mode("append").parquet(f"{ledger}/findings")
    pairs.write.mode("append").parquet(f"{ledger}/scanned")
    every = spark.read.parquet(f"{ledger}/findings").filter(F.col("rule_version") == number[F.col("kind")]).distinct()
    return addressed.join(every, "blob").select("path", "version", "blob", "kind", "rule_version", "start", "end")


def _digest(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of ``kinds``, by start, then kind as listed, comma-joined."""
    mine = F.filter("_s", lambda s: s["rank"] < len(kinds))
    return F.array_join(F.transform(mine, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_blob_ledger_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    versions, _, found = scan(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"))
    rank = F.lit(len(RULES))
    for i, r in enumerate(RULES):
        rank = F.when(F.col("kind") == r.kind, F.lit(i)).otherwise(rank)
    count = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}")
    per_blob = found.groupBy("blob").agg(
        *[count(r.kind) for r in RULES[:BASE]],
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("_s"),
    )
    kinds = tuple(r.kind for r in RULES)
    per_blob = per_blob.select(
        "blob", *[f"n_{k}" for k in kinds[:BASE]], F.sha2(_digest(kinds[:BASE]), 256).alias("base_sha256"), _digest(kinds).alias("spans")
    )
    # from a table, so that the join is not bound to an aggregation's partitions and a hot blob can be split
    per_blob = stage(per_blob, "secrets-per-blob")
    return versions.join(per_blob, "blob", "left").select(
        F.col("path").alias("doc_id"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds[:BASE]],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, '{r.kind}' AS kind, {i} AS rank, {r.least} AS least, unnest(range(len(m))) AS no, unnest(m) AS w, unnest(g) AS g, unnest(s) AS gap "
            f"FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, "
            f"string_split_regex(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))] AS s FROM d WHERE regexp_matches(t, '{p}'))"
        )
    line = "string_agg(kind || ':' || (e - length(w))::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - length(w), rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), hits AS ({" UNION ALL ".join(parts)}
), placed AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY rid, kind ORDER BY no) AS e FROM hits
), f AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES[:BASE])},
         {line} FILTER (rank < {BASE}) AS base, {line} AS spans
  FROM placed WHERE length(g) >= least GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES[:BASE])},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (rid)
"""


ORACLE = {"op5_blob_ledger_scan": _oracle()}
