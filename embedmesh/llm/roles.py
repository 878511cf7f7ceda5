"""Chat formatting with minimum-cost role repair.

A legal conversation is a path of a small automaton: an optional system turn, then user and assistant turns in alternation,
ending with the assistant. A raw sequence of turns is repaired by dynamic programming over (turn, state): each turn is
taken as it is, relabelled, or merged into the turn before it, and empty turns are inserted, at the least total cost; ties
go to the earlier option in that order. The repaired sequence is rendered with a template.

The result is a row for each raw turn with its piece of the rendered conversation, never a row for a conversation, which may
hold a third of all turns. Conversations of more than ``segment`` turns are cut into segments by position: they are sorted over
ranges, each segment's least costs from state to state (a 4 x 4 matrix) are chained to give the costs at every cut, each
segment then says which state before it leads to which after it, and chained backwards these give the path. Costs at the cuts
are those of the whole, and so are all ties: where a conversation is cut never shows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmesh.llm.common import parts
from embedmesh.plans.storage import saved

ROLES = ("system", "user", "assistant")
_ALIASES = {
    "human": "user", "prompter": "user", "customer": "user", "question": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "answer": "assistant",
    "chatbot": "assistant", "developer": "system", "instruction": "system",
}
#: States: what the last written turn is; START has none.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which roles may be written after each state.
_NEXT = {START: (0, 1), SYSTEM: (1,), USER: (2,), ASSISTANT: (1,)}
_INFINITE = 1 << 60


@dataclass(frozen=True)
class Costs:
    relabel: int = 3
    relabel_unknown: int = 1
    merge: int = 1
    merge_other: int = 6
    insert: int = 5


@dataclass(frozen=True)
class Template:
    before: str = "<|{role}|>\n"
    after: str = "<|end|>\n"


def known_role(role: str | None) -> int:
    """0, 1, 2, or -1 for a role that says nothing."""
    name = (role or "").strip().lower()
    name = _ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def _steps(costs: Costs) -> tuple[list, list]:
    """For each role seen (0 to 2, 3: unknown): the moves (from state, to state, cost, inserted roles, written role or -1 for
    a merge); and the ends (state, cost, inserted roles)."""
    moves: list[list[tuple]] = []
    for seen in range(4):
        own = []
        for state in range(4):
            # taken or relabelled, with none or one empty turn inserted before it
            for inserted in ((), *((r,) for r in _NEXT[state])):
                at = inserted[-1] + 1 if inserted else state
                for role in _NEXT[at]:
                    cost = costs.insert * len(inserted) + (0 if role == seen else costs.relabel_unknown if seen == 3 else costs.relabel)
                    own.append((state, role + 1, cost, inserted, role))
            if state != START:
                own.append((state, state, costs.merge if state == seen + 1 or seen == 3 else costs.merge_other, (), -1))
        moves.append(own)
    ends = [(ASSISTANT, 0, ()), (USER, costs.insert, (2,)), (SYSTEM, 2 * costs.insert, (1, 2)), (START, 0, ())]
    return moves, ends


class Repair:
    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.moves, self.ends = _steps(costs)

    def matrix(self, seen: list[int]) -> list[list[int]]:
        """Least costs of a run of turns, from each state to each."""
        out = []
        for entry in range(4):
            cost = [0 if s == entry else _INFINITE for s in range(4)]
            for role in seen:
                new = [_INFINITE] * 4
                for a, b, c, _, _ in self.moves[role]:
                    new[b] = min(new[b], cost[a] + c)
                cost = new
            out.append(cost)
        return out

    def ahead(self, seen: list[int], cost: list[int]) -> tuple[list[int], np.ndarray]:
        """Least costs of the states after all turns, from those before the first; and the move by which each is reached
        (the first in order, of equal ones)."""
        back = np.zeros((len(seen), 4), np.uint8)
        for t, role in enumerate(seen):
            new = [_INFINITE] * 4
            for k, (a, b, c, _, _) in enumerate(self.moves[role]):
                if cost[a] + c < new[b]:
                    new[b] = cost[a] + c
                    back[t, b] = k
            cost = new
        return cost, back

    def before(self, seen: list[int], back: np.ndarray, state: int) -> int:
        """The state before the first turn of the path to that after the last."""
        for t in range(len(seen) - 1, -1, -1):
            state = self.moves[seen[t]][back[t, state]][0]
        return state

    def end(self, cost: list[int]) -> tuple[int, int, tuple[int, ...]]:
        """(least total cost, last state, roles inserted after it)"""
        total, _, state, tail = min((cost[s] + c, k, s, x) for k, (s, c, x) in enumerate(self.ends))
        return total, state, tail

    def plan(self, seen: list[int], cost: list[int] | None = None, leave: int | None = None) -> tuple[int, list[tuple[int, tuple[int, ...], int]], tuple[int, ...]]:
        """(cost, for each turn its cost, the roles inserted before it and the role it is written as, -1: merged; roles
        inserted at the end). seen: known_role of each turn. cost: of the states before; None: the conversation begins here.
        leave: the state to end in; None: the conversation ends here."""
        costs, back = self.ahead(seen, cost or [0, _INFINITE, _INFINITE, _INFINITE])
        total, state, tail = self.end(costs) if leave is None else (costs[leave], leave, ())
        path = []
        for t in range(len(seen) - 1, -1, -1):
            state, _, c, inserted, role = self.moves[seen[t]][back[t, state]]
            path.append((c, inserted, role))
        return total, path[::-1], tail


def written(
    repair: Repair, template: Template, joint: str, turns: list[tuple], place: int = 0, cost: list[int] | None = None, leave: int | None = None
) -> Iterator[tuple]:
    """(place, turn, role, action, inserted, cost, piece) of each (turn, role, text) of a conversation, or of a segment of one:
    the pieces of all its turns, joined in order, are the rendered conversation. A turn is closed where the next one begins,
    or at the last end. A text that is merged follows the joint, if it isn't empty. The marks of the template can't be forged
    by a text: a zero-width joiner parts them."""
    marks = [x for x in (*(template.before.format(role=r).strip() for r in ROLES), template.after.strip()) if x]
    seen = [known_role(r) for _, r, _ in turns]
    _, path, tail = repair.plan(seen, cost, leave)
    for k, ((turn, _, text), own, (paid, inserted, role)) in enumerate(zip(turns, seen, path, strict=True)):
        text = text or ""
        for mark in marks:
            if mark in text:
                text = text.replace(mark, mark[0] + "\u200d" + mark[1:])
        opened = [ROLES[r] for r in (*inserted, *([role] if role >= 0 else []))]
        piece = "".join(("" if not place + k and not j else template.after) + template.before.format(role=r) for j, r in enumerate(opened))
        piece += text if role >= 0 else joint + text if text else ""
        more, last = len(inserted), leave is None and k == len(turns) - 1
        if last:
            piece += "".join(template.after + template.before.format(role=ROLES[r]) for r in tail) + template.after
            more, paid = more + len(tail), paid + repair.costs.insert * len(tail)
        yield place + k, turn, ROLES[role] if role >= 0 else None, "merged" if role < 0 else "kept" if role == own else "relabelled", more, paid, piece


_FIELDS = "conv_id long, place long, turn long, role string, action string, inserted long, cost long, piece string"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_SEGMENT = ["conv_id", "part", "block"]


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal keys in sorted rows, as (key, rows of the other columns); a run may span batches."""
    now, held = None, []
    for frame in frames:
        frame = frame.astype({k: "Int64" for k in keys}).astype(object)
        for row in frame.where(frame.notna(), None).itertuples(index=False, name=None):
            key = row[: len(keys)]
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row[len(keys) :])
    if held:
        yield now, held


def _frames(rows: Iterator[tuple], names: list[str], ids: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 1000:
            yield pd.DataFrame(held, columns=names).astype({k: "Int64" for k in ids})
            held = []
    if held:
        yield pd.DataFrame(held, columns=names).astype({k: "Int64" for k in ids})


def format_chats(
    turns: DataFrame, costs: Costs = Costs(), template: Template = Template(), joint: str = "\n\n", segment: int = 4096, broadcast_ids: int = 500_000
) -> DataFrame:
    """(conv_id, place, turn, role, action, inserted, cost, piece): a row for each turn, numbered from 0 in its conversation.
    action: kept, relabelled or merged (role is null then); inserted: empty turns before it, and for the last turn after it;
    piece: its part of the rendered conversation, with all turns inserted.

    turns: (conv_id, turn, role, text), read in the order of turn, then role and text; null numbers come before 0. Unknown or
    null roles are relabelled cheaply; null texts are empty. Turns that are repeated (same number, role and text) are turns
    like others and merge. Null ids are one conversation. Empty table: no rows. Extra columns are left out.
    """
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = ["turn", "role", "text"]
    long = saved(own.groupBy("conv_id").count().where(F.col("count") > segment).select(F.col("conv_id").alias("long_id"), F.lit(True).alias("cut")))
    n = long.count()

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(costs)
        rows = ((key[0], *row) for key, held in _groups(frames, ["conv_id"]) for row in written(repair, template, joint, held))
        return _frames(rows, _NAMES, ["conv_id", "turn"])

    if not n:
        return own.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInPandas(whole, _FIELDS)
    marked = own.join(F.broadcast(long) if n <= broadcast_ids else long, own.conv_id.eqNullSafe(long.long_id), "left").drop("long_id")
    short = marked.where("cut is null").drop("cut").repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInPandas(whole, _FIELDS)
    return short.unionByName(_in_segments(marked.where("cut").drop("cut"), order, costs, template, joint, segment))


def _in_segments(runs: DataFrame, order: list[str], costs: Costs, template: Template, joint: str, segment: int) -> DataFrame:
    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, conv, at = TaskContext.get().partitionId(), object(), 0
        for frame in frames:
            ids = frame["conv_id"].astype("Int64").astype(object).where(frame["conv_id"].notna(), None).tolist()
            blocks, places = [], []
            for x in ids:
                if x != conv:
                    conv, at = x, 0
                blocks.append(at // segment)
                places.append(at)
                at += 1
            yield frame.assign(part=part, block=blocks, at=places).astype({"conv_id": "Int64", "turn": "Int64"})

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(costs)
        rows = ((*key, len(held), [x for r in repair.matrix([known_role(r) for r, in held]) for x in r]) for key, held in _groups(frames, _SEGMENT))
        return _frames(rows, [*_SEGMENT, "n", "matrix"], ["conv_id"])

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for (conv,), held in _groups(frames, ["conv_id"]):
                cost, place = [0, _INFINITE, _INFINITE, _INFINITE], 0
                for part, block, n, matrix in held:
                    yield conv, part, block, place, cost
                    m = np.asarray(matrix).reshape(4, 4).tolist()
                    cost, place = [min(min(cost[a] + m[a][b] for a in range(4)), _INFINITE) for b in range(4)], place + n

        return _frames(rows(), [*_SEGMENT, "place", "entry"], ["conv_id"])

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(costs)

        def rows() -> Iterator[tuple]:
            for key, held in _groups(frames, [*_SEGMENT, "place"]):
                entry, seen = [int(x) for x in held[0][0]], [known_role(r) for _, r in held]
                after, back = repair.ahead(seen, entry)
                yield (*key, entry, after, [repair.before(seen, back, s) for s in range(4)])

        return _frames(rows(), [*_SEGMENT, "place", "entry", "after", "came"], ["conv_id"])

    def backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(costs)

        def rows() -> Iterator[tuple]:
            for (conv,), held in _groups(frames, ["conv_id"]):
                state, leave = repair.end([int(x) for x in held[0][4]])[1], None
                for part, block, place, entry, _, came in held:  # the last segment comes first
                    yield conv, part, block, place, entry, leave
                    state = leave = int(came[state])

        return _frames(rows(), [*_SEGMENT, "place", "entry", "leave"], ["conv_id", "leave"])

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(costs)

        def rows() -> Iterator[tuple]:
            for (conv, _, _, place, leave), held in _groups(frames, [*_SEGMENT, "place", "leave"]):
                entry = [int(x) for x in held[0][0]]
                yield from ((conv, *row) for row in written(repair, template, joint, [x[1:] for x in held], place, entry, leave))

        return _frames(rows(), _NAMES, ["conv_id", "turn"])

    key = "conv_id long, part long, block long"
    spark = runs.sparkSession
    # equal rows only can't be parted by the ranges; a segment is still no longer than ``segment``
    rows = saved(runs.repartitionByRange(parts(spark), "conv_id", *order).sortWithinPartitions("conv_id", *order).mapInPandas(numbered, "conv_id long, turn long, role string, text string, part long, block long, at long"))

    def by_segment(df: DataFrame, *columns: str) -> DataFrame:
        return df.repartition(*_SEGMENT).sortWithinPartitions(*_SEGMENT, "at").select(*_SEGMENT, *columns)

    def with_segments(found: DataFrame) -> DataFrame:
        other = found.withColumnsRenamed({c: f"s_{c}" for c in _SEGMENT})
        same = rows.conv_id.eqNullSafe(other.s_conv_id) & (rows.part == other.s_part) & (rows.block == other.s_block)
        return rows.join(other, same).drop(*[f"s_{c}" for c in _SEGMENT])

    made = by_segment(rows, "role").mapInPandas(matrices, f"{key}, n long, matrix array<long>")
    ahead = made.repartition("conv_id").sortWithinPartitions(*_SEGMENT).mapInPandas(forward, f"{key}, place long, entry array<long>")
    ways = by_segment(with_segments(saved(ahead)), "place", "entry", "role").mapInPandas(mapped, f"{key}, place long, entry array<long>, after array<long>, came array<long>")
    path = ways.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block")).mapInPandas(backward, f"{key}, place long, entry array<long>, leave long")
    return by_segment(with_segments(saved(path)), "place", "leave", "entry", "turn", "role", "text").mapInPandas(pieces, _FIELDS)


def summary(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, written, relabelled, merged, inserted, cost) of each conversation."""
    count = lambda action: F.count(F.when(F.col("action") == action, 1))
    return pieces.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), (F.count("*") - count("merged") + F.sum("inserted")).alias("written"), count("relabelled").alias("relabelled"), count("merged").alias("merged"),
        F.sum("inserted").alias("inserted"), F.sum("cost").alias("cost"),
    )
