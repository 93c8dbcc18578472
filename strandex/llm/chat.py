"""Minimum-cost role repair of conversations, and their rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last one of the
assistant. Each input turn is kept, relabelled, or merged into the turn before; empty turns may be inserted before it
and at the end. Dynamic programming over the automaton of legal turns finds the cheapest choice (costs below; of equal
ones the first of: keep or relabel without insertion, with insertion, merge; then the earliest role of ROLES).

Turns stand in order of their number (null first), then role, then a hash of the text; equal rows follow each other. All turns are
numbered in that order, conversation by conversation, and cut into blocks of BLOCK. A block is a matrix of costs from
each state before it to each state behind it, these are multiplied in the (min, +) sense along a conversation, and then
each block is solved on its own between the states that the whole path passes; so a very long conversation, or one whose
turns have no numbers, spreads over many tasks, and results don't depend on where blocks are cut.

A text that holds a marker of turns can't open or close one: each marker in it gets a backslash behind its '<', and one
that has backslashes there one more, so that texts can be read back. Unknown and null roles must be relabelled; null and
empty texts are empty; a null conversation is one of its own, ids may be of any type. Each row, repeated ones too, gives
one row, with its part of the rendered conversation: the parts in order of `place` are the whole. An empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import table, written

ROLES = ("system", "user", "assistant")
#: Costs: another role, an inserted empty turn, a merge of equal roles, a merge of other roles.
RELABEL, INSERT, MERGE, MERGE_OTHER = 4, 3, 1, 4
#: Turns in a block.
BLOCK = 512
_START, _NONE = 3, 1 << 40
#: States are the last role (0 to 2), or 3 before the first turn. Roles to insert between a state and a role.
_BETWEEN = {
    (3, 0): (), (3, 1): (), (3, 2): (1,),
    (0, 1): (), (0, 2): (1,), (1, 2): (), (2, 1): (), (1, 1): (2,), (2, 2): (1,),
}
_ENDING = {0: (1, 2), 1: (2,), 2: ()}


def _moves(role: str | None):
    """(state, next state, cost, action, inserted) of a turn, in order of preference."""
    own = ROLES.index(role) if role in ROLES else -1
    out = []
    for (state, to), inserted in _BETWEEN.items():
        out.append((state, to, (0 if to == own else RELABEL) + INSERT * len(inserted), "keep" if to == own else "relabel", inserted))
    for state in (0, 1, 2):
        out.append((state, state, MERGE if state == own else MERGE_OTHER, "merge", ()))
    return sorted(out, key=lambda m: (m[3] == "merge", len(m[4]), m[1], m[0]))


_MOVES = {r: _moves(r) for r in (*ROLES, None)}


def _role(role):
    return role if role in ROLES else None


def _step(role: str | None) -> np.ndarray:
    out = np.full((4, 4), _NONE)
    for state, to, c, _, _ in _MOVES[role]:
        out[state, to] = min(out[state, to], c)
    return out


_STEPS = {r: _step(r) for r in _MOVES}


def transfer(roles: list) -> np.ndarray:
    """Cheapest costs from each state before the turns to each behind them."""
    cost = np.where(np.eye(4, dtype=bool), 0, _NONE)
    for r in roles:
        cost = np.minimum((cost[:, :, None] + _STEPS[_role(r)]).min(axis=1), _NONE)
    return cost


def solve(roles: list, before: int, behind: int) -> list[tuple]:
    """The cheapest moves that lead from one state to the other."""
    cost, back = [_NONE] * 4, []
    cost[before] = 0
    for r in roles:
        fresh, chosen = [_NONE] * 4, [None] * 4
        for move in _MOVES[_role(r)]:
            state, to, c = move[:3]
            if cost[state] + c < fresh[to]:
                fresh[to], chosen[to] = cost[state] + c, move
        cost = fresh
        back.append(chosen)
    out, state = [], behind
    for chosen in reversed(back):
        out.append(chosen[state])
        state = chosen[state][0]
    return out[::-1]


def best_path(matrices: list[np.ndarray]) -> tuple[list[int], int]:
    """The states between blocks of a whole conversation, first to last, and its cost with the ending."""
    costs = [np.array([_NONE, _NONE, _NONE, 0])]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), _NONE))
    final = [costs[-1][s] + INSERT * len(_ENDING[s]) for s in (0, 1, 2)]
    state = int(np.argmin(final))
    total, path = int(final[state]), [state]
    for m, c in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        path.append(state := int(np.argmin(c + m[:, state])))
    return path[::-1], total


def _turn(role: str, text: str, closed: bool = True) -> str:
    return f"<|im_start|>{role}\n{text}" + ("<|im_end|>\n" if closed else "")


_MARKER = re.compile(r"<(\\*\|im_(?:start|end)\|>)")


def escaped(text: str) -> str:
    """text without markers of turns."""
    return _MARKER.sub(r"<\\\1", text)


def _rendered(roles: list, texts: list, before: int, behind: int, first: bool, last: bool):
    """action, role, part of the rendered conversation and cost of each turn of a block."""
    moves = solve(roles, before, behind)
    out = []
    for i, (text, (_, to, cost, action, inserted)) in enumerate(zip(texts, moves, strict=True)):
        text = escaped(text or "")
        if action == "merge":
            part = "\n\n" + text
        else:
            part = ("" if first and i == 0 else "<|im_end|>\n") + "".join(_turn(ROLES[r], "") for r in inserted) + _turn(ROLES[to], text, False)
        if last and i + 1 == len(moves):
            part += "<|im_end|>\n" + "".join(_turn(ROLES[r], "") for r in _ENDING[to])
            cost += INSERT * len(_ENDING[to])
        out.append((action, ROLES[to], part, cost))
    return out


#: So that ids that are times keep their fractions as text.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def repaired(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, turn, role, place (in its conversation, from 0), action, new_role, rendered, cost of each row of turns."""
    rows = turns.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    # any type of id, null too, travels as text
    rows = rows.select(F.to_json(F.struct("conv"), _JSON).alias("key"), "turn", "role", "text").withColumn("hash", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    # no whole text in the order: the planner draws samples of what rows are ordered by
    narrow = numbered(rows, ["key", "turn", "role", "hash", "salt"], "at").drop("hash", "salt").withColumn("block", F.floor(F.col("at") / block).cast("long"))

    def matrix(batches):
        for batch_of in _grouped(batches, ["key", "block"]):
            rows = [(*g, len(roles), transfer(roles).ravel().tolist()) for g, (roles,) in batch_of]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["key", "block", "n", "costs"])

    def path(batches):
        for batch_of in _grouped(batches, ["key"]):
            rows = []
            for (key,), (blocks_, sizes, costs) in batch_of:
                states, _ = best_path([np.array(c).reshape(4, 4) for c in costs])
                n, start = len(blocks_), 0
                for i, b in enumerate(blocks_):
                    rows.append((key, b, states[i], states[i + 1], i == 0, i + 1 == n, start))
                    start += sizes[i]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "block", "before", "behind", "first", "last", "start"])

    def render(batches):
        for batch_of in _grouped(batches, ["key", "block"]):
            rows = []
            for (key, _), (_, turns_, roles, texts, before, behind, first, last, start) in batch_of:
                done = _rendered(roles[1:], texts[1:], before[0], behind[0], first[0], last[0])
                rows += [(key, t, r, start[0] + i, *d) for i, (t, r, d) in enumerate(zip(turns_[1:], roles[1:], done, strict=True))]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "turn", "role", "place", "action", "new_role", "rendered", "cost"])

    roles = narrow.select("key", "block", "at", "role").repartition("key", "block").sortWithinPartitions("key", "block", "at").select("key", "block", "role")
    blocks = written(roles.mapInArrow(matrix, "key string, block long, n long, costs array<long>"), "matrices")
    paths = blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(path, "key string, block long, before long, behind long, first boolean, last boolean, start long")
    # a block's states come as a row before its turns, so that one shuffle brings both together
    paths = paths.select("key", "block", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "before", "behind", "first", "last", "start")
    none = (F.lit(None).cast(k).alias(c) for c, k in (("before", "long"), ("behind", "long"), ("first", "boolean"), ("last", "boolean"), ("start", "long")))
    both = paths.unionByName(narrow.select("key", "block", "at", "turn", "role", "text", *none))
    both = both.repartition("key", "block").sortWithinPartitions("key", "block", "at")
    done = both.mapInArrow(render, "key string, turn long, role string, place long, action string, new_role string, rendered string, cost long")
    return done.select(F.from_json("key", f"conv {kind}", _JSON)["conv"].alias("conv_id"), "turn", "role", "place", "action", "new_role", "rendered", "cost")


def _grouped(batches, by: list[str]):
    """For each batch, the groups of equal leading columns that it completes: key, lists of the other columns. Rows
    come sorted; what a batch leaves open is carried into the next."""
    key, columns = None, None
    for batch in batches:
        done = []
        values = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        keys = list(zip(*values[: len(by)], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            part = [v[start:i] for v in values[len(by) :]]
            if columns is not None and keys[start] == key:
                for own, more in zip(columns, part, strict=True):
                    own.extend(more)
            else:
                if columns is not None:
                    done.append((key, columns))
                key, columns = keys[start], part
            start = i
        if done:
            yield done
    if columns is not None:
        yield [(key, columns)]


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
