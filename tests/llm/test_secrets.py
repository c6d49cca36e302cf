"""Secret spans against regular expressions in Python, and the ledger."""

import tempfile

from subledger.llm.secrets import RULES, scan, update_ledger

from .brute import secret_spans

TEXTS = [
    None,
    "",
    'password = "abcdefghijkl" and PASSWD:shorttttttt12 token: token: longlonglonglong',
    "é\U0001f600 API_KEY=ABCDEFGHIJKLMN apikey='x' secret\"   :   \"0123456789abcdef0123\"",
    "AKIA" + "Z" * 14 + " AKIAAKIA" + "B" * 12 + " AKIA" + "0" * 13 + " 0123456789abcdef 0123456789abcde " + "f" * 40,
    "token=secret=abcdefghijklmnop paſſword=abcdefghijklmnop toKen=abcdefghijklmnop",
    "secret=" * 50 + "x" * 30,
    "\n".join(f"line {i} token={i:020x}" for i in range(400)),
]


def test_spans_match_python(spark):
    rows = [(i, 0, t) for i, t in enumerate(TEXTS)] + [(100 + i, 0, TEXTS[3]) for i in range(20)]
    df = spark.createDataFrame(rows, "path long, version int, text string").selectExpr("*", "'x' AS blob", "1 AS kind").repartition(4)
    versions, pairs, found = scan(df)
    got = {}
    for r in versions.join(found, "blob", "left").collect():
        got.setdefault(r["path"], [])
        if r["kind"] in ("assign", "access", "hex"):
            got[r["path"]].append((r["start"], r["kind"], r["end"]))
    order = {"assign": 0, "access": 1, "hex": 2}
    assert {p: sorted(s, key=lambda x: (x[0], order[x[1]])) for p, s in got.items()} == {p: secret_spans(t) for p, _, t in rows}
    # null and empty texts are one blob, copies of a text one more
    assert pairs.count() == len(RULES) * (len(TEXTS) - 1)


def test_ledger_scans_only_unseen_pairs(spark):
    folder = tempfile.mkdtemp(prefix="ledger-", dir=spark.conf.get("spark.checkpoint.dir", None) or None)
    schema = "path string, version int, text string"
    one = [("a", 1, TEXTS[2]), ("b", 1, TEXTS[4])]
    first = update_ledger(spark.createDataFrame(one, schema), f"{folder}/l")
    n = first.count()
    assert n == len(secret_spans(TEXTS[2])) + len(secret_spans(TEXTS[4]))
    # old blobs under new paths need no scan; one text is new
    two = [*one, ("a", 2, TEXTS[4]), ("c", 1, TEXTS[2]), ("d", 1, "token=abcdefghijklmnop")]
    again = update_ledger(spark.createDataFrame(two, schema), f"{folder}/l")
    assert again.count() == 2 * n + 1
    pairs = spark.read.parquet(f"{folder}/l/scanned")
    assert pairs.count() == pairs.distinct().count() == 3 * len(RULES)
    # a new version of one rule costs that rule alone
    rules = tuple(r._replace(version=2) if r.kind == "hex" else r for r in RULES)
    assert update_ledger(spark.createDataFrame(two, schema), f"{folder}/l", rules).count() == 2 * n + 1
    pairs = spark.read.parquet(f"{folder}/l/scanned")
    assert pairs.count() == 3 * len(RULES) + 3 and pairs.filter("rule_version = 2").count() == 3


def test_empty_table(spark):
    versions, pairs, found = scan(spark.createDataFrame([], "path long, version int, text string"))
    assert (versions.count(), pairs.count(), found.count()) == (0, 0, 0)
