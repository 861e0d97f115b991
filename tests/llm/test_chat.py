import itertools
import random

from llm_odd import ODD
from pyspark.sql import functions as F

from foliospark.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string, block long, before int"


def convs(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], COLUMNS)


def sample(spark, n=60):
    rows = []
    for c in range(n):
        if c % 3 == 0:
            rows.append((c, 0, "system", "You are terse."))
        for t in range(4):
            role = "assistant" if t % 2 else "user"
            rows.append((c, t + (c % 3 == 0), role, "Long answer of many words. " * 12 if t % 2 else "What is it?"))
    return convs(spark, rows)


def test_roles_come_back(spark):
    known = sample(spark)
    model = chat.fit(known)
    given = {(r["conv_id"], r["turn"]): r["role"] for r in known.collect()}
    for df in (known, known.withColumn("role", F.lit(None).cast("string"))):
        rows = chat.parse(df, model).collect()
        right = sum(given[(r["conv_id"], r["turn"])] == r["role"] for r in rows)
        assert len(rows) == len(given) and right / len(rows) > 0.95


def test_marked_transcript(spark):
    model = chat.fit(sample(spark))
    text = "Human: hello there\nhow are you?\n\nAssistant: fine\n### System: be good\n[user] bye"
    rows = chat.parse(convs(spark, [(1, 0, None, text)]), model).orderBy("part").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("user", "hello there\nhow are you?"), ("assistant", "fine"), ("system", "be good"), ("user", "bye")]
    assert rows[1]["rendered"] == "<|assistant|>\nfine\n<|end|>"


def value(parts, model, states):
    """The log score of one path."""
    total = model["start"][states[0]] + parts[0][1][states[0]]
    for (head, score), last, now in zip(parts[1:], states, states[1:], strict=False):
        total += model["move" if head else "inside"][last][now] + score[now]
    return total


def scored(rows, model):
    """(head, scores) of every part of the rows, in order."""
    return [(head, chat.score_of(body, mark, not (turn or 0) > 0, model)) for _, turn, role, text in rows for head, mark, body in chat.parts_of(text or "", role)]


def test_decoding_matches_all_paths(spark, monkeypatch):
    """Viterbi over blocks of two messages against the best of all 4^n paths."""
    model = chat.fit(sample(spark))
    monkeypatch.setattr(chat, "BLOCK", 1)
    rng = random.Random(4)
    rows = [(c, t, rng.choice([None, None, "user", "bot"]), "x" * rng.randint(0, 300) + rng.choice(["", "?"])) for c in range(25) for t in range(rng.randint(1, 6))]
    got = {(r["conv_id"], r["turn"]): chat.ROLES.index(r["role"]) for r in chat.parse(convs(spark, rows), model).collect()}
    for c in range(25):
        mine = [r for r in rows if r[0] == c]
        parts = scored(mine, model)
        best = max(value(parts, model, p) for p in itertools.product(range(4), repeat=len(parts)))
        assert value(parts, model, [got[(c, r[1])] for r in mine]) == best


def test_long_conversation_over_many_blocks(spark, monkeypatch):
    model = chat.fit(sample(spark))
    monkeypatch.setattr(chat, "BLOCK", 3)
    rows = [(7, t, None if t % 5 else "user", "x" * (3 + t * 37 % 400)) for t in range(150)]
    whole = sorted((r["turn"], chat.ROLES.index(r["role"])) for r in chat.parse(convs(spark, rows), model).collect())
    parts = scored(rows, model)
    best, _ = chat.forward([s for _, s in parts], [h for h, _ in parts], model, None)
    assert [t for t, _ in whole] == list(range(150)) and value(parts, model, [s for _, s in whole]) == max(best)


def test_hot_turn_is_dealt(spark, monkeypatch):
    """Rows of one turn, null turns and repeated rows are messages in a row, over many blocks."""
    model = chat.fit(sample(spark))
    monkeypatch.setattr(chat, "BLOCK", 4)
    rows = [(1, 0, "user", "same")] * 700 + [(None, None, "user", f"t{i}") for i in range(300)] + [(1, 1, "user", f"t{i}") for i in range(500)]
    got = chat.parse(convs(spark, rows), model).collect()
    assert len(got) == 1500 and sum(r["text"] == "same" for r in got) == 700 and sum(r["conv_id"] is None for r in got) == 300
    assert chat.fit(convs(spark, rows))["move"][1][1] > chat.fit(convs(spark, rows))["move"][1][0]


def test_held_out_roles(spark):
    """Learnt on three of four conversations, decoded without the role column."""
    known = sample(spark, 200)
    model = chat.fit(known.where(~chat.held_out(F.col("conv_id"))))
    rows = chat.parse(known.where(chat.held_out(F.col("conv_id"))), model, use_role=False).collect()
    assert len(rows) > 100 and sum(r["given"] == r["role"] for r in rows) / len(rows) >= 0.9
    wrong = known.withColumn("role", F.lit("tool"))
    roles = lambda df: sorted((r["conv_id"], r["turn"], r["role"]) for r in chat.parse(df, model, use_role=False).collect())
    assert roles(wrong) == roles(known)  # the column isn't read


def test_odd_rows(spark):
    model = chat.fit(convs(spark, []))
    rows = [(i, 0, "user", t) for i, t in enumerate(ODD)] + [(None, None, None, None), (3, 1, "bot", "a"), (3, 1, "bot", "a")]
    got = chat.parse(convs(spark, rows), model).collect()
    assert len(got) >= len(rows) and {r["conv_id"] for r in got} == {*range(len(ODD)), None}
    assert [r["role"] for r in got if r["conv_id"] == 3 and r["turn"] == 1] == ["assistant"] * 2
    assert chat.parse(convs(spark, []), model).count() == 0
    long = chat.parse(convs(spark, [(1, 0, None, "line\n\n" * 30_000)]), model).collect()
    assert "".join(r["text"] for r in long).count("line") == 30_000
