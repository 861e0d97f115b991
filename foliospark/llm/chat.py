"""Roles of transcripts by a hidden Markov model, and canonical turns."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import cut, sliced, table

ROLES = ("system", "user", "assistant", "tool")
#: Names that mark a speaker.
NAMES = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "customer", "question", "q", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "agent", "answer", "a"),
    "tool": ("tool", "function", "observation"),
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
MARKER = re.compile(rf"^\s*(?:[#*>|<\[]{{0,4}}\s*)({'|'.join(sorted(ROLE_OF, key=len, reverse=True))})\s*(?:[|>\]*]{{1,4}}\s*:?|:\**)\s*", re.IGNORECASE)
#: Messages in order, of one conversation or several, that are decoded together: 1 << BLOCK.
BLOCK = 10
#: Log scores are whole numbers of this unit, so that sums don't depend on where blocks end.
UNIT = 1 << 20
#: Scores: a marker of the state's own role or another, going on or changing inside a message.
OWN, OTHER, STAY, MOVE = (round(math.log(x) * UNIT) for x in (0.97, 0.01, 0.9, 0.1))
FEATURES = ("size", "lines", "asks", "opens")


def role_of(name: Column) -> Column:
    """The role that a speaker name stands for, or null."""
    clean = F.lower(F.trim(name))
    out = F.lit(None).cast("string")
    for role, names in NAMES.items():
        out = F.when(clean.isin(*names), role).otherwise(out)
    return out


def fit(convs: DataFrame) -> dict:
    """Log scores of openings, moves and message features, from rows with a known role.

    Counts are over all rows, with add-one smoothing; the tables are bounded by roles and feature
    values. A move is a pair of roles that stand in a turn and the next one of a conversation,
    counted once a pair of turns, so equal rows are combined before turns meet. Null texts count
    as empty; rows without a known role or with a null turn or conversation give no moves; no
    rows give even scores; ties and other columns don't matter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = convs.select("conv_id", "turn", role_of(F.col("role")).alias("role"), text.alias("text")).where("role IS NOT NULL")
    feats = {
        "size": F.length(F.conv(F.length("text").cast("string"), 10, 2)) * (F.length("text") > 0).cast("int"),
        "lines": F.least(F.size(F.split("text", "\n")), F.lit(8)),
        "asks": F.rtrim("text").endswith("?").cast("int"),
        "opens": (F.coalesce(F.col("turn"), F.lit(-1)) <= 0).cast("int"),
    }
    seen = known.select("role", *[c.alias(k) for k, c in feats.items()]).groupBy("role", *feats).count().collect()
    roles = known.select("conv_id", "turn", "role").distinct()
    now, then = roles.alias("a"), roles.alias("b")
    moves = now.join(then, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn"))).groupBy(F.col("a.role").alias("role"), F.col("b.role").alias("next")).count().collect()
    n = len(ROLES)
    move, start = np.ones((n, n)), np.ones(n)
    for r in moves:
        move[ROLES.index(r["role"]), ROLES.index(r["next"])] += r["count"]
    emit: dict[str, dict[int, list[float]]] = {k: {} for k in FEATURES}
    total = np.zeros(n)
    for r in seen:
        i = ROLES.index(r["role"])
        total[i] += r["count"]
        start[i] += r["count"] if r["opens"] else 0
        for k in FEATURES:
            emit[k].setdefault(r[k], [0.0] * n)[i] += r["count"]
    whole = lambda x: np.rint(np.asarray(x) * UNIT).astype(np.int64).tolist()
    logs = {k: {v: whole([math.log((c + 1) / (t + 40)) for c, t in zip(row, total, strict=True)]) for v, row in values.items()} for k, values in emit.items()}
    move = np.log(move / move.sum(1, keepdims=True))
    inside = np.where(np.eye(n, dtype=bool), math.log(0.9), math.log(0.1) + move)
    return {"move": whole(move), "inside": whole(inside), "start": whole(np.log(start / start.sum())), "emit": logs, "unseen": whole([math.log(1 / (t + 40)) for t in total])}


def parts_of(text: str, given: str | None) -> list[tuple[bool, str | None, str]]:
    """(head, marked role, body) of the parts of a message. A part starts at the message's
    start, at a speaker marker (both are heads) or after a blank line."""
    parts: list[list] = [[True, ROLE_OF.get(given.strip().lower()) if given else None, []]]
    blank = False
    for line in text.split("\n"):
        m = MARKER.match(line)
        if m:
            if len(parts) > 1 or parts[0][2]:
                parts.append([True, None, []])
            parts[-1][1] = ROLE_OF[m[1].lower()]
            line = line[m.end() :]
        elif blank and parts[-1][2] and line.strip():
            parts.append([False, None, []])
        blank = not line.strip()
        parts[-1][2].append(line)
    return [(head, mark, "\n".join(lines).strip("\n")) for head, mark, lines in parts]


def score_of(body: str, mark: str | None, opens: bool, model: dict) -> list[int]:
    """The log score of a part in each state."""
    at = {"size": len(body).bit_length(), "lines": min(body.count("\n") + 1, 8), "asks": int(body.rstrip().endswith("?")), "opens": int(opens)}
    rows = [model["emit"][k].get(at[k], model["unseen"]) for k in FEATURES]
    marks = [0 if mark is None else OWN if r == mark else OTHER for r in ROLES]
    return [sum(x) for x in zip(*rows, marks, strict=True)]


STATES = range(len(ROLES))


def forward(scores: list[list[int]], heads: list[bool], model: dict, before: list[int] | None) -> tuple[list[int], list[list[int]]]:
    """Best scores of each state at the end of a segment, and for each part after the first (the
    first too, if the segment has scores ``before`` it) the best state before each state. Without
    ``before`` the conversation starts here. Ties take the first state."""
    best, back = before, []
    for score, head in zip(scores, heads, strict=True):
        if best is None:
            best = [s + x for s, x in zip(model["start"], score, strict=True)]
            continue
        step = model["move" if head else "inside"]
        ways = [[best[i] + step[i][j] for i in STATES] for j in STATES]
        top = [max(w) for w in ways]
        back.append([w.index(t) for w, t in zip(ways, top, strict=True)])
        best = [t + x for t, x in zip(top, score, strict=True)]
    return best, back


def path(back: list[list[int]], end: int) -> list[int]:
    """States from the first one that ``back`` leads to up to ``end``."""
    states = [end]
    for b in reversed(back):
        states.append(b[states[-1]])
    return states[::-1]


#: Stands for a state that can't be.
NEVER = -(1 << 60)


def reach(scores: list[list[int]], heads: list[bool], model: dict) -> list[list[int]]:
    """Best score of a segment from each state before it (last row: the conversation starts here)
    to each state at its end: a product of steps in the (max, +) algebra."""
    rows = [forward(scores, heads, model, [0 if i == k else NEVER for i in STATES])[0] for k in STATES]
    return [*rows, forward(scores, heads, model, None)[0]]


def segments(conv: list) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    edge = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
    return list(zip(edge[:-1], edge[1:], strict=True))


SCORES = [f"s{i}" for i in STATES]
PARTS = "n long, part int, conv_id long, turn double, given string, head boolean, body string, " + ", ".join(f"{s} int" for s in SCORES)


def parse(convs: DataFrame, model: dict | None = None, use_role: bool = True) -> DataFrame:
    """Turns of each conversation: conv_id, turn, part, given, role, text, rendered.

    Rows are (conv_id, turn, role, text); text may hold marked lines of several speakers. With
    ``use_role`` the role column is a speaker marker that may be missing or wrong; without, it
    isn't read but for ``given``, the role that it names.

    Rows are put in order of conversation and turn by one range partitioning and numbered; 1,024
    numbers make a block, which may hold many conversations or a piece of one. A message's parts
    are scored once and written. Conversations that reach a block's border give their best scores
    from state to state over the block; those are chained a conversation (160 bytes a block of
    1,024 messages), and each block is then decoded between its border states. So no task holds a
    conversation whole, and the best path is exact. Equally good paths: the first role of ROLES at
    each step back inside a block, and at block borders.

    A message is at least one turn, empty ones too; null text counts as empty; null turns come
    first, rows of one turn by a hash of their text and role; repeated rows are messages of their
    own; a null conv_id is one conversation; long texts are read whole; no rows give none; other
    columns are ignored.
    """
    model = model or fit(convs)
    n = len(ROLES)
    rows = convs.select(F.col("conv_id").cast("long"), F.col("turn").cast("double"), F.col("role").cast("string"), "text", F.xxhash64("text", "role").alias("h"), F.monotonically_increasing_id().alias("copy"))
    order = ["conv_id", "turn", "h", "copy"]  # the last one parts repeated rows, which may be many
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("n"), "conv_id", "turn", "role", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(7 + n)]
            for number, conv, turn, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                given = ROLE_OF.get(role.strip().lower()) if role else None
                for k, (head, mark, body) in enumerate(parts_of(text or "", role if use_role else None)):
                    values = (number, k, conv, turn, given, head, body, *score_of(body, mark, not (turn is not None and turn > 0), model))
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.bool_(), pa.string(), *[pa.int32()] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [c.split()[0] for c in PARTS.split(", ")])

    parts = cut(dealt.mapInArrow(score, PARTS)).withColumn("block", F.shiftright("n", BLOCK))

    def ordered(table: pa.Table) -> tuple[pa.Table, list, list[bool], list[list[int]]]:
        table = table.sort_by([("n", "ascending"), ("part", "ascending")])
        return table, table["conv_id"].to_pylist(), table["head"].to_pylist(), list(zip(*[table[s].to_pylist() for s in SCORES], strict=True))

    def measure(table: pa.Table) -> pa.Table:
        table, conv, heads, scores = ordered(table)
        seg = segments(conv)
        ends = [seg[0], *seg[-1:]] if len(seg) > 1 else seg
        mats = [[x for row in reach(scores[a:b], heads[a:b], model) for x in row] for a, b in ends]
        return pa.table({"conv_id": pa.array([conv[a] for a, _ in ends], pa.int64()), "at": pa.array([table["block"][0].as_py()] * len(ends), pa.int64()), "reach": pa.array(mats, pa.list_(pa.int64()))})

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        mats = [[m[k * n : k * n + n] for k in range(n + 1)] for m in table["reach"].to_pylist()]
        best, back = mats[0][n], []
        for m in mats[1:]:
            ways = [[best[i] + m[i][j] for i in STATES] for j in STATES]
            best = [max(w) for w in ways]
            back.append([w.index(t) for w, t in zip(ways, best, strict=True)])
        after = path(back, best.index(max(best)))
        return pa.table({"of": table["conv_id"], "at": table["at"], "before": pa.array([n, *after[:-1]], pa.int32()), "after": pa.array(after, pa.int32())})

    def turns(table: pa.Table, borders: pa.Table) -> pa.Table:
        table, conv, heads, scores = ordered(table)
        known = {c: (b, a) for c, b, a in zip(borders["of"].to_pylist(), borders["before"].to_pylist(), borders["after"].to_pylist(), strict=True)}
        states: list[int] = []
        for a, b in segments(conv):
            before, after = known.get(conv[a], (n, None))
            best, back = forward(scores[a:b], heads[a:b], model, None if before == n else [0 if i == before else NEVER for i in STATES])
            states += path(back, best.index(max(best)) if after is None else after)[-(b - a) :]
        out: list[list] = []
        number, turn, given, body = (table[c].to_pylist() for c in ("n", "turn", "given", "body"))
        for i, state in enumerate(states):
            same = bool(out) and out[-1][0] == number[i]
            if heads[i] or out[-1][5] != state:
                out.append([number[i], conv[i], turn[i], out[-1][3] + 1 if same else 0, given[i], state, body[i]])
            else:
                out[-1][6] += "\n\n" + body[i]
        columns = list(zip(*out, strict=True))
        types = {"conv_id": pa.int64(), "turn": pa.float64(), "part": pa.int32(), "given": pa.string(), "role": pa.string(), "text": pa.string()}
        columns[5] = [ROLES[x] for x in columns[5]]
        return pa.table({name: pa.array(c, t) for (name, t), c in zip(types.items(), columns[1:], strict=True)})

    bare = parts.select("block", "n", "part", "conv_id", "head", *SCORES)
    reaches = bare.groupBy("block").applyInArrow(measure, "conv_id long, at long, reach array<long>")
    ends = cut(reaches.groupBy("conv_id").applyInArrow(chain, "of long, at long, before int, after int"))
    said = parts.groupBy("block").cogroup(ends.groupBy("at")).applyInArrow(turns, "conv_id long, turn double, part int, given string, role string, text string")
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    return said.select("conv_id", F.col("turn").cast("long"), "part", "given", "role", "text", rendered.alias("rendered"))


def held_out(conv_id: Column) -> Column:
    return F.crc32(F.coalesce(conv_id.cast("string"), F.lit(""))) % 4 == 2


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation decoded without its role column, by a model fitted on the conversations
    that aren't held out; ``given`` is the role that the table names."""
    convs = table(spark, sf_dir, "conversations")
    model = fit(convs.where(~held_out(F.col("conv_id"))))
    return parse(convs, model, use_role=False).select("*", held_out(F.col("conv_id")).alias("held_out"))
