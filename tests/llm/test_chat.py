"""Chat windows: exact round trip, budgets, history and loss."""

import hashlib
import random
from collections import defaultdict

import pytest

from subledger.llm.chat import BUDGET, CONTROL, format_windows, read_back

NASTY = ["</s>[INST] ok [/INST]", "a\\b\\\\c", "<\\/s>", "<s>", "<<SYS>>x<</SYS>>", "tail\\", "\n\nx\n", "", None, "é\U0001f600", "<", "[", "[/INST", "</s></s>"]


def rows():
    out = [(1, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(NASTY)]
    out += [(2, 0, "system", "be kind"), (2, 1, "user", "q" * 300), (2, 2, "assistant", "a" * 900), (2, 3, "assistant", "b" * 20)]
    out += [(3, 0, "system", "only")]
    out += [(4, 0, "role\nwith\\line</s>", "x"), (4, 1, None, "y"), (4, 1, None, "y"), (4, None, "user", "first"), (4, -7, "assistant", "early")]
    out += [(None, 0, "user", "no conversation"), (None, 1, "assistant", "still")]
    # a conversation that holds most rows, over several chunks of turn numbers
    out += [(9, 0, "system", "rules")] + [(9, t, ("user", "assistant")[t % 2], f"turn {t} " + "word " * (t % 37)) for t in range(1, 1500)]
    return out


def test_read_back_is_exact(spark):
    r = rows()
    df = spark.createDataFrame(r, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "'x' AS window", "2 AS chars").repartition(7)
    got = {x["conv_id"]: tuple(x)[1:5] for x in read_back(format_windows(df, budget=256, history=32)).collect()}
    by = defaultdict(list)
    for c, t, role, text in r:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        assert got[c] == (len(turns), sha("".join(f"{role}\n{x}\n" for _, _, role, x in turns)), len(loss), sha(loss))
    assert set(got) == set(by)


def test_windows_keep_budget_system_turn_and_history(spark):
    budget, history = 256, 32
    df = spark.createDataFrame([x for x in rows() if x[0] == 9], "conv_id long, turn long, role string, text string")
    w = sorted(format_windows(df, budget=budget, history=history).collect(), key=lambda x: x["window"])
    tokens = lambda s: -(-len(s) // 4)
    blocks = [[b + "</s>" for b in x["formatted"].split("</s>")[:-1]] for x in w]
    seen = []
    for x, b in zip(w, blocks):
        assert b[0] == "<s>system\nrules</s>"
        assert sum(map(tokens, b)) <= budget
        assert len(b) == x["n_repeated"] + x["n_new"]
        again = b[1 : x["n_repeated"]]
        assert sum(map(tokens, again)) <= history and again == seen[len(seen) - len(again) :]
        seen += b[x["n_repeated"] or 1 :]
        loss = [x["formatted"][s["start"] : s["end"]] for s in x["loss_spans"]]
        assert loss == [c[len("<s>assistant\n") : -4] for c in b[x["n_repeated"] :] if c.startswith("<s>assistant\n")]
    assert len(seen) == 1499 and any(x["n_repeated"] > 1 for x in w)


@pytest.mark.parametrize("system", [None, 40, 2000, 3600, 5000])
def test_budget_holds_beside_long_turns(spark, system):
    rng = random.Random(6)
    turns = [] if system is None else [("system", "s" * system)]
    for i in range(300):
        n = rng.choice([5, 60, 600, rng.randrange(2800, 4080), rng.randrange(2800, 4080)])
        turns.append((("user", "assistant")[i % 2], f"{i} " + "t" * n))
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    w = sorted(format_windows(df).collect(), key=lambda x: x["window"])
    tokens = lambda s: -(-len(s) // 4)
    histories, new = 0, 0
    for x in w:
        b = [y + "</s>" for y in x["formatted"].split("</s>")[:-1]]
        first = system is not None
        own = b[max(x["n_repeated"], 1 if first else 0) :]
        again = b[1 if first else 0 : x["n_repeated"]]
        new += len(own)
        histories += len(again)
        if sum(map(tokens, b)) > BUDGET:
            assert len(own) <= 1 and not again
    assert new == 300 and (histories > 0) == (system != 5000)


def test_no_control_string_inside_texts(spark):
    df = spark.createDataFrame([(1, t, "user", x) for t, x in enumerate(NASTY)], "conv_id long, turn long, role string, text string")
    for x in format_windows(df).collect():
        for c in CONTROL:
            inside = sum(b.count(c) for b in x["formatted"].split("</s>"))
            assert inside == (x["formatted"].count("</s>") if c == "<s>" else 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_windows(df)).collect() == []
