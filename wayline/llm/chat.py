"""Chat formatting by minimum-cost role repair.

A legal chat is an optional system turn, then user and assistant turns in
alternation from a user turn on; a system turn alone is legal too. Each turn is
kept, given another role, or merged into the turn before it; an empty turn may
be put in before it. Dynamic programming over the automaton's states finds the
cheapest way.

Turns are sorted by ranges and written once to the shared folder, numbered, and
cut into chunks of so many rows, whatever their turn numbers: one huge
conversation is many chunks, and many small ones share one. The turns that a
conversation has in a chunk give the least costs between all pairs of states;
these small matrices are combined from the end of a conversation to its
beginning, then every chunk repairs and renders its own turns, knowing the
states that each conversation begins and ends in. The result has a row per
turn, and the rendered pieces in order are the chat.

Turns of equal number come by role, then a hash of the text, then the text. A
null or unknown role can only be relabelled; a null text is empty; null turns
come first, and rows of a null conversation are one conversation. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import per_task, shared_dir

#: Rows of a chunk; a power of two.
CHUNK = 1024
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
ROLES = (SYSTEM, USER, ASSISTANT)
START, STATES = 0, 4  #: state 0: nothing yet; then after each role
MERGE, RELABEL, INSERT = 2, 3, 4
FAR = 1 << 50
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def moves(state: int, role: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(cost, merge or new, roles of empty turns before) of each way to take a turn as role (1 to 3) in a state."""
    out = [(MERGE, "merge", ())] if state == role else []
    if role == 1:
        return [*out, (0, "new", ())] if state == START else out
    if state == START or state == 1:
        return [*out, (0, "new", ())] if role == 2 else [*out, (INSERT, "new", (2,))]
    return [*out, (0, "new", ()) if state != role else (INSERT, "new", (5 - role,))]


@functools.cache
def options(role: str | None) -> tuple[tuple[int, int, int, str, tuple[int, ...]], ...]:
    """(state, next state, cost, merge or new, empty turns) of a turn, the preferred first at equal cost."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    found = [(s, r, cost + (0 if r == own else RELABEL), how, empty) for s in range(STATES) for r in range(1, 4) for cost, how, empty in moves(s, r)]
    return tuple(sorted(found, key=lambda x: (x[0], x[2], x[1], x[3])))


@functools.cache
def costs(role: str | None) -> np.ndarray:
    out = np.full((STATES, STATES), FAR, np.int64)
    for s, r, cost, _, _ in options(role):
        out[s, r] = min(out[s, r], cost)
    return out


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def repair(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(role, merge or new, empty turns) of each turn, at least cost from one state to another."""
    ahead = np.full(STATES, FAR, np.int64)
    ahead[leave] = 0
    rests = [ahead]
    for role in reversed(roles):
        rests.append(np.minimum((costs(role) + rests[-1]).min(1), FAR))
    out, state = [], entry
    for role, rest in zip(roles, rests[-2::-1], strict=True):
        _, r, _, how, empty = min((x for x in options(role) if x[0] == state), key=lambda x: x[2] + rest[x[1]])
        out.append((r, how, empty))
        state = r
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys; batches are sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(len(own) + 1):
            if i == len(own) or own[i] != own[start]:
                if i > start:
                    if held and own[start] != key:
                        yield pa.Table.from_batches(held)
                        held = []
                    key = own[start]
                    held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield pa.Table.from_batches(held)


def per_group(keys: list[str], f: Callable[[pa.Table], dict[str, list]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Applies f to each group; results go out some thousand rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in schema.names}
        for group in grouped(batches, keys):
            for n, values in f(group).items():
                out[n] += values
            if len(out[schema.names[0]]) >= 4096:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out = {n: [] for n in schema.names}
        if out[schema.names[0]]:
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def runs(group: pa.Table) -> Iterator[tuple[int, int]]:
    """The rows, from and up to, of each conversation in a chunk."""
    own = group.column("conv_id").to_pylist()
    cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def measured(group: pa.Table) -> dict[str, list]:
    """The least costs of each conversation's turns in a chunk, and the number of the first of them."""
    roles, places, own = (group.column(c).to_pylist() for c in ("role", "id", "conv_id"))
    out: dict[str, list] = {"conv_id": [], "first_id": [], "costs": []}
    for a, b in runs(group):
        out["conv_id"].append(own[a])
        out["first_id"].append(places[a])
        out["costs"].append(functools.reduce(combined, map(costs, roles[a:b])).ravel().tolist())
    return out


def joined(group: pa.Table) -> dict[str, list]:
    """The states that each part of a conversation begins and ends in."""
    matrices = [np.array(x).reshape(STATES, STATES) for x in group.column("costs").to_pylist()]
    rests = [np.zeros(STATES, np.int64)]
    for m in reversed(matrices[1:]):
        rests.append((m + rests[-1]).min(1))
    states = [START]
    for m, rest in zip(matrices, reversed(rests), strict=True):
        states.append(int(np.argmin(m[states[-1]] + rest)))
    return {"first_id": group.column("first_id").to_pylist(), "entry": states[:-1], "leave": states[1:], "is_last": [False] * (len(matrices) - 1) + [True]}


def rendered(group: pa.Table) -> dict[str, list]:
    """The repaired turns of a chunk. parts: of each of its conversations in order first_id, entry, leave, is_last."""
    roles, texts = group.column("role").to_pylist(), group.column("text").to_pylist()
    out: dict[str, list] = {"new_role": [], "action": [], "inserted": [], "rendered": []}
    for (a, b), part in zip(runs(group), group.column("parts")[0].as_py(), strict=True):
        state = part["entry"]
        ways = repair(roles[a:b], state, part["leave"])
        for role, text, (r, how, empty) in zip(roles[a:b], texts[a:b], ways, strict=True):
            new = ROLES[r - 1]
            if how == "merge":
                piece = f"\n{text}"
            else:
                piece = CLOSE if state else ""
                piece += "".join(OPEN.format(ROLES[e - 1]) + CLOSE for e in empty) + OPEN.format(new) + text
            relabelled = new != role
            action = {(False, False): "keep", (True, False): "relabel", (False, True): "merge", (True, True): "relabel+merge"}[relabelled, how == "merge"]
            for n, v in zip(out, (new, action, ",".join(ROLES[e - 1] for e in empty), piece), strict=True):
                out[n].append(v)
            state = r
        if part["is_last"]:
            out["rendered"][-1] += CLOSE
    return {n: group.column(n).to_pylist() for n in ("conv_id", "turn", "role")} | out


def repaired(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``new_role``, ``action`` (keep, relabel, merge, relabel+merge), ``inserted`` and ``rendered`` of each turn."""
    spark = conversations.sparkSession
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    order = ["conv_id", "turn", "role", "hash", "text"]
    at = f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}"
    ranged = turns.withColumn("hash", F.xxhash64("text")).repartitionByRange("conv_id", "turn", "role", "hash").sortWithinPartitions(*order)
    ranged.drop("hash").withColumn("id", F.monotonically_increasing_id()).write.parquet(at)
    placed = spark.read.parquet(at).withColumn("chunk", F.shiftright("id", chunk.bit_length() - 1))

    small = placed.select("conv_id", "role", "id", "chunk").repartition("chunk").sortWithinPartitions("id")
    schema = pa.schema([("conv_id", pa.int64()), ("first_id", pa.int64()), ("costs", pa.list_(pa.int64()))])
    matrices = small.mapInArrow(per_task(per_group(["chunk"], measured, schema)), "conv_id bigint, first_id bigint, costs array<bigint>")
    plan = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "first_id")
    schema = pa.schema([("first_id", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64()), ("is_last", pa.bool_())])
    states = plan.mapInArrow(per_task(per_group(["conv_id"], joined, schema)), "first_id bigint, entry bigint, leave bigint, is_last boolean")
    parts = states.groupBy(F.shiftright("first_id", chunk.bit_length() - 1).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("first_id", "entry", "leave", "is_last"))).alias("parts"))  # a chunk's
    both = placed.join(parts, "chunk").sortWithinPartitions("chunk", "id")
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), *((n, pa.string()) for n in ("role", "new_role", "action", "inserted", "rendered"))])
    return both.mapInArrow(per_task(per_group(["chunk"], rendered, schema)), "conv_id bigint, turn bigint, role string, new_role string, action string, inserted string, rendered string")
