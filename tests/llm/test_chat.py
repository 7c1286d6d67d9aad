import hashlib
import random

import duckdb
import pandas as pd
from strandwise.llm import chat

COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
SCHEMA = "conv_id long, turn long, role string, text string, window string"


def brute(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_odd_turns(spark):
    convs = {
        1: [("system", "be brief"), *[(("user", "assistant")[i % 2], f"turn {i} " + "x" * (97 * i % 900)) for i in range(80)]],
        2: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<\\| <\\\\| <| <\\n |im_start|> <")],
        3: [("a\nb<|", ""), ("assistant", ""), ("assistant", "<")],
        4: [("assistant", "é漢😀" * 5000), ("user", "after a turn beyond the budget"), ("assistant", "yes")],
    }
    data = [(c, i, r, t, "clash") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    data += [(5, 0, None, None, None), (5, 0, None, None, None), (None, None, "user", "no id", None)]
    windows = chat.format_windows(spark.createDataFrame(data, SCHEMA), budget=300, history=80)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    want = {c: brute(t) for c, t in convs.items()} | {5: brute([("", "")] * 2), None: brute([("user", "no id")])}
    assert got == want
    first = [w for w in windows.where("conv_id = 1").collect()]
    assert len(first) > 5
    for w in first:
        assert w.formatted.startswith("<|im_start|>system\nbe brief<|im_end|>\n")
        assert w.formatted.count("<|im_start|>") == w.formatted.count("<|im_end|>\n")
    assert sum(w.n_context for w in first) > len(first) - 1


def test_history_is_limited_and_masked(spark):
    data = [(1, i, "assistant", f"{i:03d}" + "y" * 57, None) for i in range(60)]
    windows = chat.format_windows(spark.createDataFrame(data, SCHEMA), budget=200, history=60).orderBy("window").collect()
    seen = []
    for w in windows:
        assert w.n_context <= 2
        assert len(w.loss) == w.formatted.count("<|im_start|>") - w.n_context
        seen += [w.formatted[s.start : s.start + 3] for s in w.loss]
    assert seen == [f"{i:03d}" for i in range(60)]


def cost(piece):
    return -(-len(piece) // 4)


def test_windows_hold_the_budget_with_all_that_they_repeat(spark):
    draw = random.Random(3)
    turn = lambda k, n: ("user" if k % 2 == 0 else "assistant", "z" * n)
    convs = {
        1: [("system", "be brief"), ("user", "u" * 3900), ("assistant", "a" * 40)],
        2: [("user", "u" * 3800), ("assistant", "a" * 20000), ("user", "more")],
        3: [("system", "s" * 1500), *[turn(k, draw.randrange(0, 1500)) for k in range(120)]],
        4: [turn(k, draw.choice((0, 3, 60, 700, 4200))) for k in range(150)],
        5: [("system", "s" * 3000), *[turn(k, 200) for k in range(30)]],
        6: [("system", "alone")],
        7: [turn(k, 1) for k in range(400)],
    }
    data = [(c, i, r, t, None) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    budget, history = 1024, 256
    windows = chat.format_windows(spark.createDataFrame(data, SCHEMA), budget, history).orderBy("conv_id", "window").collect()
    for c, turns in convs.items():
        of = [w for w in windows if w.conv_id == c]
        assert [w.window for w in of] == list(range(1, len(of) + 1))
        pieces = [f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns]
        retained = turns[0][0] == "system" and cost(pieces[0]) <= budget // 2
        at = 0
        for w in of:
            said = [f"<|im_start|>{x}" for x in w.formatted.split("<|im_start|>")[1:]]
            own, again = said[w.n_context :], said[: w.n_context]
            assert own == pieces[at : at + len(own)]  # whole turns, in order, none left out
            if w.window > 1 and retained:
                assert again.pop(0) == pieces[0]
            assert again == pieces[at - len(again) : at] and sum(map(cost, again)) <= history
            total = sum(map(cost, said))
            assert total <= budget or len(own) == 1 and cost(own[0]) + retained * cost(pieces[0]) > budget and not again
            if w.window > 1 and at - len(again) > retained:  # one turn more would be too many
                more = cost(pieces[at - len(again) - 1])
                assert sum(map(cost, again)) + more > history or total + more > budget
            at += len(own)
        assert at == len(turns)
    assert len([w for w in windows if w.conv_id == 7]) < 8


def test_against_sql_with_ties_and_odd_turns(spark):
    draw = random.Random(8)
    data = []
    for c in range(40):
        data += [(c, draw.randrange(0, 30), draw.choice(("system", "user", "assistant", None)), draw.choice((None, "<|x|>", "y" * draw.randrange(5000)))) for _ in range(draw.randrange(1, 60))]
    data += [(c, -1, "system", "s" * draw.randrange(2500)) for c in range(20)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in chat.digests(chat.format_windows(chat.with_probe(frame))).select(*COLUMNS).collect())
    con = duckdb.connect()
    con.register("held", pd.DataFrame(data, columns=["conv_id", "turn", "role", "text"]))
    con.execute("create view conversations as select * from held")
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({chat.ORACLE})").fetchall())


def test_empty(spark):
    assert chat.digests(chat.format_windows(spark.createDataFrame([], SCHEMA))).count() == 0
