"""Licence scan against plain search, plain matching statistics and unlimited chaining."""

import random
from functools import cache

from subledger.llm import licences as m
from subledger.llm.licence_texts import PHRASES, TEMPLATES

from .brute import ALNUM, LOWER


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def starts(part, whole):
    return [i for i in range(len(whole) - len(part) + 1) if whole[i : i + len(part)] == part] if part else []


def brute_matches(w, items):
    """(first word, words) of runs that end where no longer run ends one word later."""
    known = {tuple(t[a:b]) for t in items for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    size = [next((n for n in range(i + 1, 0, -1) if tuple(w[i + 1 - n : i + 1]) in known), 0) for i in range(len(w))] + [0]
    return [(i + 1 - n, n) for i, n in enumerate(size[:-1]) if n >= m.LONG and size[i + 1] <= n]


def brute(text, phrases=PHRASES, templates=TEMPLATES):
    """(n_words, places, spans) by trying everything."""
    w = words(text)
    named = [(label, words(p)) for label, p in [(b, a) for a, b in phrases]]
    long = [(label, words(t)) for label, t in templates]
    places = sorted((at, label, len(p)) for label, p in named for at in starts(p, w))
    whole = {(label, at, len(t), len(t), len(t)) for label, t in long for at in starts(t, w)}
    found = brute_matches(w, [t for _, t in named + long if t])
    spans = set()
    for label, t in long:
        if len(t) <= m.SHORT:
            continue
        nodes = [(at, n, j) for at, n in found for j in starts(w[at : at + n], t)]

        @cache
        def best(k):
            """(covered, first word) of the best chain that ends with node k."""
            at, n, j = nodes[k]
            options = [(n, at)]
            for p in range(k):
                end, reached = nodes[p][0] + nodes[p][1], nodes[p][2] + nodes[p][1]
                twice = max(0, end - at, reached - j)
                if twice < n and j + twice - reached <= m.GAP and at + twice - end <= m.GAP:
                    options.append((best(p)[0] + n - twice, best(p)[1]))
            return max(options, key=lambda x: (x[0], -x[1]))

        chains = {}
        for k, (at, n, _) in enumerate(nodes):
            covered, begin = best(k)
            chains[begin] = min(chains.get(begin, (1, 0)), (-covered, at + n))
        spans |= {(label, begin, end - begin, -covered, len(t)) for begin, (covered, end) in chains.items() if (label, begin) not in {x[:2] for x in whole}}
    return len(w), places, sorted(whole | spans, key=lambda x: (x[1], x[0], -x[3]))


def scan(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS `a.b`", "3 AS spans").repartition(3)
    rows = sorted(m.scan_licences(df, **kw).collect(), key=lambda r: r["doc_id"])
    return [(r["n_words"], sorted((p["first"], p["label"], p["words"]) for p in r["places"]), [tuple(s) for s in r["spans"]]) for r in rows]


def test_small_templates_match_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    letters = "a b c d e".split()
    templates = [(f"t{i}", " ".join(rng.choice(letters) for _ in range(n))) for i, n in enumerate((30, 25, 40, 18, 12, 5, 17))] + [("empty", "..")]
    phrases = [("a b", "p0"), ("c c a", "p1"), ("d e a b c", "p2")]
    texts = [None, "", "...", "a", "a b", "A-B, a.b"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice(templates)[1].split()
            a = rng.randrange(len(t))
            parts += t[a : a + rng.randrange(1, 30)] + [rng.choice([*letters, "x", "y"]) for _ in range(rng.randrange(9))]
        texts.append(" ".join(parts))
    texts += [texts[-1]] * 2
    monkeypatch.setattr(m, "GAP", 6)
    # tasks import the module anew, so the gap is tried on the index itself
    index = m.TemplateIndex(phrases, templates)
    for text in texts:
        assert plain(index, text) == brute(text, phrases, templates)
    monkeypatch.undo()
    assert scan(spark, texts, phrases=phrases, templates=templates) == [brute(t, phrases, templates) for t in texts]


def plain(index, text):
    """The operator's answer without Spark."""
    import pyarrow as pa

    out = next(iter(_run(index, pa.record_batch([pa.array([1]), pa.array([text], pa.string())], names=["doc_id", "text"])))).to_pylist()[0]
    return out["n_words"], sorted((p["first"], p["label"], p["words"]) for p in out["places"]), [tuple(s.values()) for s in out["spans"]]


def _run(index, batch):
    key = ((("x", "x"),), ())
    m._built.clear()
    m._built[key] = index
    return m._scan(*key)([batch])


def test_licence_texts(spark):
    mit, bsd3 = TEMPLATES[0][1], TEMPLATES[2][1]
    cut = mit.split()
    texts = [
        "Copyright 2020 Someone\n" + mit + "\ncode();",
        "words before " + " ".join([*cut[:60], "INSERTED", "LINE", *cut[60:140]]),
        bsd3.replace("copyright holder", "University"),
        "Licensed under CC BY-NC 4.0. And released under the MIT License!",
        "the mit licence, the apache, license",
        " ".join(cut[::2]),
        ("x " * 20_000 + mit) * 3,
    ]
    got = scan(spark, texts)
    labels = [sorted({s[0] for s in spans if 100 * s[3] >= m.SHARE * s[4]}) for _, _, spans in got]
    assert labels == [["mit"], ["mit"], ["bsd-3-clause"], ["cc-by-nc-4.0", "mit"], [], [], ["mit"]]
    assert [p[1] for p in got[3][1]] == ["cc-by", "mit"] and [p[1] for p in got[4][1]] == ["apache"]
    assert [s[1] for s in got[6][2]] == [20_000 + k * (20_000 + len(words(mit))) for k in range(3)]


def test_query_matches_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    named = [(label, words(p)) for p, label in PHRASES]
    rows = m.op12_licence_templates(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = words(texts[r["doc_id"]])
        places = [(at, label) for label, p in named for at in starts(p, w)]
        at = [p[0] for p in places]
        base = sorted({p[1] for p in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(base) and set(base) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] >= 0.5 or not base)
    assert any(r["labels"] != r["base_labels"] for r in rows)


def test_too_many_templates_and_empty_table(spark):
    import pytest

    with pytest.raises(ValueError):
        m.TemplateIndex((), [("x", "word " * (m.MAX_WORDS + 1))])
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string").limit(0)
    assert m.scan_licences(df).collect() == []
