import hashlib

import pytest
from pyspark.sql import functions as F

from inkstone.llm import chat

from .conftest import prose, rows

NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>\n", "\\p \\b \\l \\\\ <\\p| <|", "a\\", "<s><<SYS>>x<</SYS>>", "", None, "[\\pINST]", "\n\n", "<\\p\\p|turn|>"]


def _frame(spark, conversations):
    data = [(c, t, r, x) for c, turns in conversations.items() for t, (r, x) in enumerate(turns)]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def _expected(conversations):
    out = []
    for c, turns in conversations.items():
        said = "".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)
        loss = "".join(x or "" for r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def _long():
    out = {}
    for c in range(40):
        turns = [("system", prose(10 + c, c))] if c % 3 == 0 else []
        for k in range(2 + c):
            turns.append(("user", prose(5 + (7 * k + c) % 60, k)))
            turns.append(("assistant", prose(10 + (11 * k * c) % 150, c)))
        out[c] = turns
    return out


@pytest.mark.parametrize("budget,history", [(1024, 256), (200, 40), (50, 0)])
def test_round_trip(spark, budget, history):
    conversations = _long() | {100 + k: [("user", x), ("assistant", x), ("weird\nrole<|", x)] for k, x in enumerate(NASTY)}
    windows = chat.windows(_frame(spark, conversations), budget=budget, history=history).cache()
    columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert rows(chat.digests(chat.read_back(windows)), *columns) == sorted(_expected(conversations), key=repr)


def test_windows_keep_budget_history_and_masks(spark):
    conversations = _long()
    windows = chat.windows(_frame(spark, conversations), budget=300, history=60).orderBy("conv_id", "window").collect()
    sizes = {x: t for x, t in ((r["text"], r["n"]) for r in _frame(spark, conversations).select("text", chat.tokens(F.col("text")).alias("n")).collect())}
    seen = {}
    for w in windows:
        turns = conversations[w["conv_id"]]
        done = seen.get(w["conv_id"], 0)
        own = turns[done : done + w["n_turns"]]
        seen[w["conv_id"]] = done + w["n_turns"]
        segments = w["text"].split(chat.TURN)[1:]
        assert len(segments) == w["n_repeated"] + w["n_turns"]
        assert [s.split("\n", 1)[1].removesuffix(chat.END) for s in segments[w["n_repeated"] :]] == [x for _, x in own]
        system = turns[0][0] == "system"
        if done and system:
            assert segments[0].startswith("system\n")
        repeated = [s.split("\n", 1)[1].removesuffix(chat.END) for s in segments[: w["n_repeated"]]][int(bool(done and system)) :]
        assert repeated == [x for _, x in turns[done - len(repeated) : done]]
        assert sum(sizes[x] for x in repeated) <= 60
        assert w["n_tokens"] <= 300 or w["n_turns"] == 1
        spans = [w["text"][s["start"] : s["end"]] for s in w["loss_spans"]]
        assert spans == [x for r, x in own if r == "assistant"]
    assert seen == {c: len(t) for c, t in conversations.items()}


def test_spans_are_filled(spark):
    # 200 turns of 124 counted tokens: six fit into 768 tokens beside the history
    conversations = {1: [("assistant" if k % 2 else "user", prose(60, k)) for k in range(200)]}
    frame = _frame(spark, conversations)
    size = frame.select(chat.tokens(F.col("text")).alias("n")).distinct().collect()
    windows = chat.windows(frame).collect()
    room = (chat.BUDGET - chat.HISTORY) // size[0]["n"]
    assert len(size) == 1 and len(windows) == -(-200 // room)
    assert sum(w["n_tokens"] for w in windows) >= 0.85 * chat.BUDGET * len(windows)
    assert all(w["loss_spans"] for w in windows)


def test_greedy_spans_same_as_brute_force(spark):
    conversations = _long()
    sizes = {(r["conv_id"], r["turn"]): r["n"] for r in _frame(spark, conversations).select("conv_id", "turn", chat.tokens(F.col("text")).alias("n")).collect()}
    expected = {}
    for c, turns in conversations.items():
        system = sizes[c, 0] if turns[0][0] == "system" else 0
        room, used, spans = max(300 - 60 - system, 75), 0, [0]
        for t in range(len(turns)):
            if t == 0 and system:
                spans[-1] += 1
                continue
            if used and used + sizes[c, t] > room:
                spans.append(0)
                used = 0
            used += sizes[c, t]
            spans[-1] += 1
        expected |= {(c, k): n for k, n in enumerate(spans)}
    found = chat.windows(_frame(spark, conversations), budget=300, history=60).collect()
    assert {(r["conv_id"], r["window"]): r["n_turns"] for r in found} == expected


def test_only_native_operators(spark):
    windows = chat.windows(_frame(spark, {1: [("user", "a"), ("assistant", "b")]}))
    plan = chat.digests(chat.read_back(windows))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_odd_rows(spark):
    data = [(None, 1, "user", "a"), (None, 2, "assistant", None), (1, None, None, "x"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (2, 5, "system", "only")]
    frame = spark.createDataFrame([(*r, 1, "w", 3) for r in data], "conv_id long, turn long, role string, text string, window long, piece string, part int")
    found = rows(chat.digests(chat.read_back(chat.windows(frame))), "conv_id", "n_turns", "loss_chars")
    assert found == sorted([(None, 2, 0), (1, 3, 2), (2, 1, 0)], key=repr)
    assert chat.digests(chat.read_back(chat.windows(frame.filter("false")))).count() == 0


def test_very_long_text(spark):
    text = "<|x " * 100_000
    found = chat.digests(chat.read_back(chat.windows(_frame(spark, {1: [("user", "q"), ("assistant", text)]})))).first()
    assert found["loss_chars"] == len(text) and found["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_probe(spark):
    frame = chat.with_probe(spark, _frame(spark, {5: [("user", "a")]}))
    text = "</s>[INST] ok [/INST]"
    assert rows(frame.filter("conv_id = -1"), "turn", "role", "text") == [(0, "user", text), (1, "assistant", text)]
