"""Merkle manifest and proofs against a tree built in memory."""

import hashlib

import pytest
from pyspark.sql import functions as F

from subledger.llm.merkle import FIELDS, field_digest, folded, manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        other = i ^ 1
        out.append((bool(i & 1), nodes[other] if other < len(nodes) else None))
        i >>= 1
    return out


def brute(rows):
    """(doc_id, leaf, position, subroot, root, proof) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g])]) for g in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, h, key) in enumerate(sorted(groups[g])):
            out.append((key, h, i, trees[k][-1][0], top[-1][0], path(trees[k], i) + path(top, k)))
    return out


def proven(df, **kw):
    return [(r["row"]["key"], r["leaf"], r["position"], r["subroot"], r["root"], [tuple(x) for x in r["proof"]]) for r in manifest(df, **kw).collect()]


def fixture():
    rows = [(i, f"s{i % 3}", "en", i * 7, f"text {i} é") for i in range(1, 100)]
    rows += [(i, None, "de", None, None) for i in range(200, 233)] + [(500, "s", "fr", 1, "x" * 300_000)]
    rows += [(None, "s", "en", 3, "no id")] * 4 + [(None, "t", None, 3, "")] * 9 + [(7, "s0", "en", 1, "same id")] * 3
    rows += [(i, "s", lang, 2, "\U0001f600") for i in range(5) for lang in ("", "zz", "é", "a", "b")]
    return [dict(zip(FIELDS_IN_ORDER, r)) for r in rows]


FIELDS_IN_ORDER = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("per_part,bits", [(1, 1), (5, 2), (16, 3), (1 << 16, 16)])
def test_proofs_match_a_tree_in_memory(spark, per_part, bits):
    rows = fixture()
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    df = df.selectExpr("*", "1 AS grp", "2 AS hash", "3 AS `a.b`", "4 AS part", "5 AS local", "6 AS n", "7 AS row", "8 AS key")
    key = lambda r: (str(r[0]), *map(repr, r[1:]))
    assert sorted(proven(df, per_part=per_part, bits=bits), key=key) == sorted(brute(rows), key=key)


def test_every_proof_leads_to_the_root_and_a_changed_row_does_not(spark):
    rows = fixture()
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    other = field_digest(*[F.lit("forged") if f == "text" else F.col(f) for f in FIELDS])
    m = manifest(df, extra={"other": other}, per_part=8, bits=2).select("root", folded(F.col("leaf"), F.col("proof")).alias("a"), folded(F.col("row.other"), F.col("proof")).alias("b"))
    got = m.collect()
    assert len(got) == len(rows) and len({r["root"] for r in got}) == 1
    assert all(r["a"] == r["root"] and r["b"] != r["root"] for r in got)


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(None, None, None, None, None)], SCHEMA)
    assert proven(one) == [(None, digest("-----"), 0, digest("-----"), digest("-----"), [])]
    assert manifest(one.limit(0)).collect() == []


def test_root_depends_on_rows_and_not_on_their_files(spark):
    rows = [tuple(r.values()) for r in fixture()]
    roots = {manifest(spark.createDataFrame(rows[::step], SCHEMA).repartition(n), per_part=9, bits=3).first()["root"] for step, n in ((1, 1), (-1, 7))}
    assert len(roots) == 1
    changed = [(*rows[0][:3], rows[0][3] + 1, rows[0][4]), *rows[1:]]
    assert manifest(spark.createDataFrame(changed, SCHEMA)).first()["root"] not in roots
