"""Phrase collocations and their tries against plain counting."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from subledger.llm import collocations as m

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, top=2000, inside=50):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = {}, Counter()
    for lang, text in docs:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            counts.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * c >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in found.items()):
                continue
            score, k = min((int(Fraction(1000000 * a * a, counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def fixture():
    rng = random.Random(3)
    words = ["the", "The", "of", "é", "New", "york", "city", "a|b", "\U0001f600", "x y", "=", "—"]
    docs = [("en", None), (None, ""), ("de", " \t "), ("en", ".,;:!?\n"), ("en", "solo")]
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", " the "]) for _ in range(rng.randrange(40)))
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text))
    docs += [("en", "same words every time")] * 25 + [("fr", "a a a a a a a a a a a a a")] * 3
    docs += [("en", " ".join(rng.choice(words) for _ in range(30_000)))]
    return docs


def rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("kw", [{}, {"block": 40, "bitmap": 12, "together": 2}, {"top": 7, "salts": 3}])
def test_matches_plain_counting(spark, kw):
    docs = fixture()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4).selectExpr("*", "1 AS node", "2 AS `a.b`", "3 AS block", "4 AS rank")
    want = brute(docs, top=kw.get("top", 2000))
    assert len(want) > 10
    assert rows(m.collocations(df, **kw)) == want


def test_small_runs_in_tasks(spark, monkeypatch):
    docs = fixture()[:60]
    monkeypatch.setattr(m, "HELD", 50)
    df = spark.createDataFrame(docs, "lang string, text string")
    assert rows(m.collocations(df, least=3)) == brute(docs, least=3)


def test_texts_are_read_three_times_however_many_the_candidates(spark, monkeypatch):
    reads, real = [], m.map_arrow
    monkeypatch.setattr(m, "map_arrow", lambda df, run, schema: (reads.append("text" in df.columns), real(df, run, schema))[1])
    docs = [("en", " ".join(f"w{i * j % 311}" for j in range(400))) for i in range(40)]
    assert rows(m.collocations(spark.createDataFrame(docs, "lang string, text string"), block=40, together=2)) == brute(docs)
    assert sum(reads) == 3


def test_common_pair_is_folded_in_its_slice(monkeypatch):
    monkeypatch.setattr(m, "HELD", 60)
    full = type("Shared", (), {"value": np.full(1 << 9, 255, dtype=np.uint8)})
    docs = [("en", f"of the w{i % 90}") for i in range(1500)] + [("de", "of the w1")] * 300
    folds, real = [], m._Slice.fold
    monkeypatch.setattr(m._Slice, "fold", lambda self: (folds.append(self.entries), real(self)))
    table = pa.table({"lang": [x for x, _ in docs], "text": [x for _, x in docs]})
    dealt = [b for b in m._deal([full, full], 1)(iter(table.to_batches(max_chunksize=50)))]
    assert {r["slice"] for b in dealt for r in b.to_pylist()} == {0}
    got = Counter()
    for b in m._count_slices(10, 64)(iter(dealt)):
        for r in b.to_pylist():
            assert (r["lang"], r["phrase"]) not in got
            got[r["lang"], r["phrase"]] = r["f"]
    want = Counter()
    for lang, text in docs:
        w = text.split()
        want.update((lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(4 - k))
        want[lang, None] += len(w)
    assert len(folds) > 1
    assert got == {p: n for p, n in want.items() if n >= 10}


def test_distinct_keys_that_differ_in_their_last_bits():
    keys = np.array([5, 4, 5, 1 << 63, 4, 6, (1 << 63) + 1, 5], dtype=np.uint64)
    found, first, place, n = m._distinct(keys, 64)
    assert found.tolist() == [4, 5, 6, 1 << 63, (1 << 63) + 1] and n.tolist() == [2, 3, 1, 1, 1]
    assert (keys[first] == found).all() and (found[place] == keys).all()


def test_empty_tables(spark):
    df = spark.createDataFrame([("en", "one"), (None, None)], "lang string, text string")
    assert m.collocations(df).collect() == [] == m.collocations(df.limit(0)).collect()


def test_score_is_exact_beyond_64_bits(spark):
    q = "cast(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) as decimal(38, 0)) div cast(cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)) as decimal(38, 0))"
    cases = [(10**14 + 7, 3 * 10**14 + 1, 10**14 + 9), (10**12 + 1, 10**12 + 1, 10**12 + 1), (9_999_999_999, 10_000_000_000, 9_999_999_999)]
    got = [r[0] for r in spark.createDataFrame(cases, "a long, l long, r long").selectExpr(q).collect()]
    assert got == [10**6 * a * a // (left * r) for a, left, r in cases]


def test_double_array_holds_every_sequence_and_no_other():
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 1 << m.DIGIT, (4000, 6))
    symbols[:1500, 0] = 7  # one wide state
    symbols[:700, 1] = np.arange(700)
    symbols[2000:, 2:] = -1
    symbols = np.unique(symbols, axis=0)
    trie = m.DoubleArray(symbols)
    assert len(np.unique(trie.node)) == len(symbols)

    def walk(rows):
        state = np.zeros(len(rows), dtype=np.int64)
        for d in range(rows.shape[1]):
            on = (state >= 0) & (rows[:, d] >= 0)
            state[on] = m.DoubleArray.step(trie.base, trie.check, state[on], rows[on, d])
        return state

    assert (walk(symbols) == trie.node).all()
    other = symbols[symbols[:, 2] >= 0].copy()
    other[:, 5] = (other[:, 5] + 1) % (1 << m.DIGIT)
    known = {tuple(x) for x in symbols.tolist()}
    assert all((s < 0) != (tuple(x) in known) for s, x in zip(walk(other), other.tolist()))
