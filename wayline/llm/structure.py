"""Conversation structure repair by lazy weighted determinisation.

Roles should read ``(s?(ua)+)?`` by their initials. A turn is kept, given the
role that is due, or deleted; empty turns are put in. Blank and repeated turns
must go, and an unfinished one that stays costs extra. The edits are arcs of a
small automaton with costs; its states are what may come next.

The cheapest costs to all states after a turn, less the least of them, are one
state of a deterministic automaton. Few such vectors occur, so they are numbered
when first met, and their transitions by each kind of turn are kept in a table
that fills as turns come. Scanning a conversation then is a lookup a turn, and
the offsets add up to the cost. Back from the end, the states that lie on
cheapest paths are marked through tight arcs, by a second table; read from the
front, the marked arcs of the least letter give the audit: D before I before K
before R, as ASCII has them.

Turns are sorted by ranges, written once, numbered, and cut into chunks of so
many rows, so that one conversation may be any number of chunks. A conversation
inside one chunk is repaired there. Of the others each piece gives the least
costs between all pairs of states, and which of its ways ranks first by letters;
these meet in order, a few numbers for each thousand turns, and the pieces get
the states to begin and end in. Repeats are found by the least row number of
each role and text, joined back by that number, so that no text is a hot key.

Turns of equal number come by role, a hash of the text, and text; null turns come
first, and rows of a null conversation are one. Null roles and texts are one
space (so blank). Roles count by their first letter, case and all, as they are;
an empty role has none. Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayline.llm.chat import per_group, runs
from wayline.llm.common import per_task, shared_dir

#: Rows of a chunk; a power of two.
CHUNK = 1024
STATES, START = 4, 0  #: nothing yet, then after s, u, a
#: The turn that is due in each state, and the state after it; also what an inserted or relabelled turn is.
DUE, AFTER = "uuau", (2, 2, 3, 2)
ROLE = {"u": "user", "a": "assistant"}
DELETE, INSERT, RELABEL, UNFINISHED = 4, 3, 3, 3
#: Cost of ending in each state: the turns that are still due.
TAIL = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
SPACE = " \t\n\x0b\x0c\r"
#: Kinds of turns: initial s, u, a or another, then the same unfinished, then those that must go.
GONE, KINDS = 8, 9
#: How much dearer than from the column's state the rest of a conversation can be from the row's, whatever comes: an s is deleted, a turn put in.
SLACK = ((0, 0, INSERT, 0), (2 * INSERT, 0, INSERT, 2 * INSERT), (DELETE + INSERT, INSERT, 0, INSERT), (DELETE, 0, INSERT, 0))
Vector = tuple[int, ...]


def kept_as(state: int, initial: int) -> int | None:
    """The state after a turn that stays as it is."""
    if initial == 0:
        return 1 if state == START else None
    return AFTER[state] if initial < 3 and "sua"[initial] == DUE[state] else None


@functools.cache
def arcs(kind: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, from, to, cost) of what may be done with a turn, by letter."""
    out = [("D", q, q, DELETE) for q in range(STATES)]
    if kind != GONE:
        extra = UNFINISHED if kind >= 4 else 0
        out += [("K", q, to, extra) for q in range(STATES) if (to := kept_as(q, kind % 4)) is not None]
        out += [("R", q, AFTER[q], RELABEL + extra) for q in range(STATES)]
    return tuple(out)


def inserted(vector: Vector) -> Vector:
    """The least costs when empty turns may be put in."""
    out = list(vector)
    for _ in range(STATES):
        for q in range(STATES):
            out[AFTER[q]] = min(out[AFTER[q]], out[q] + INSERT)
    return tuple(out)


@dataclass
class Automaton:
    """The deterministic automaton, as far as it has been needed."""

    vectors: list[Vector] = field(default_factory=list)
    numbers: dict[Vector, int] = field(default_factory=dict)
    steps: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    tight: dict[tuple[int, int, int, bool], tuple[int, tuple[tuple[str, int] | None, ...]]] = field(default_factory=dict)

    def number(self, vector: Vector) -> tuple[int, int]:
        """The state of a vector of costs, and what was taken off it. Costs that no cheapest way can have any more count as none."""
        least = min(vector)
        flat = tuple(FAR if v >= FAR or any(v > vector[k] + SLACK[k][q] for k in range(STATES)) else v - least for q, v in enumerate(vector))
        if flat not in self.numbers:
            self.numbers[flat] = len(self.vectors)
            self.vectors.append(flat)
        return self.numbers[flat], least

    def step(self, state: int, kind: int) -> tuple[int, int]:
        """The state after a turn of a kind, and its cost."""
        if (state, kind) not in self.steps:
            before, after = inserted(self.vectors[state]), [FAR] * STATES
            for _, a, b, cost in arcs(kind):
                after[b] = min(after[b], before[a] + cost)
            self.steps[state, kind] = self.number(tuple(after))
        return self.steps[state, kind]

    def scan(self, kinds: list[int], entry: int) -> tuple[list[int], int]:
        """The states before each turn and after the last, and the cost that was taken off on the way."""
        state, total = self.number(tuple(0 if q == entry else FAR for q in range(STATES)))
        states = [state]
        for kind in kinds:
            state, cost = self.step(state, kind)
            total += cost
            states.append(state)
        return states, total

    def back(self, state: int, kind: int, goals: int, last: bool) -> tuple[int, tuple[tuple[str, int] | None, ...]]:
        """From the bits of the goals after a turn, the bits of the states before it on a cheapest path, and the arc of the least letter out of each.

        last: nothing is put in after the turn. An inserted turn's arc stays before the turn.
        """
        key = (state, kind, goals, last)
        if key not in self.tight:
            before = inserted(self.vectors[state])
            own, taken = self.step(state, kind)
            after = self.vectors[own] if last else inserted(self.vectors[own])
            out: list[list[tuple[str, int]]] = [[(letter, b) for letter, a, b, cost in arcs(kind) if a == q and goals >> b & 1 and before[q] < FAR and before[q] + cost - taken == after[b]] for q in range(STATES)]
            for _ in range(STATES):
                for q in range(STATES):
                    if before[q] < FAR and before[q] + INSERT == before[AFTER[q]] and out[AFTER[q]] and ("I", AFTER[q]) not in out[q]:
                        out[q].append(("I", AFTER[q]))
            self.tight[key] = sum(1 << q for q in range(STATES) if out[q]), tuple(min(x, default=None) for x in out)
        return self.tight[key]

    def trace(self, kinds: list[int], states: list[int], goals: int, entry: int) -> tuple[list[str], int]:
        """The edits of each turn (with insertions before it) of the least letters among the cheapest ways to a goal, and the state after."""
        ways = []
        for i in range(len(kinds) - 1, -1, -1):
            goals, least = self.back(states[i], kinds[i], goals, i == len(kinds) - 1)
            ways.append(least)
        out, q = [], entry
        for way in reversed(ways):
            edits = ""
            while True:
                letter, q = way[q]
                edits += letter
                if letter != "I":
                    break
            out.append(edits)
        return out, q


def ends(vector: Vector, rest: tuple[int, ...]) -> int:
    """The bits of the states in which a cheapest way may end, if it costs so much to go on from each."""
    least = min(v + r for v, r in zip(vector, rest, strict=True))
    return sum(1 << q for q in range(STATES) if vector[q] + rest[q] == least)


def repair(kinds: list[int], automaton: Automaton | None = None) -> tuple[list[str], int]:
    """The edits of each turn of a whole conversation (the last one's with what is put in after it), and their cost."""
    machine = automaton or Automaton()
    if not kinds:
        return [], 0
    states, total = machine.scan(kinds, START)
    vector = machine.vectors[states[-1]]
    edits, q = machine.trace(kinds, states, ends(vector, TAIL), START)
    edits[-1] += "I" * (TAIL[q] // INSERT)
    return edits, total + min(v + t for v, t in zip(vector, TAIL, strict=True))


def piece(kinds: list[int], machine: Automaton) -> tuple[list[int], list[int]]:
    """Of a part of a conversation, from each state to each: the least cost, and the rank of its edits by letters."""
    costs, ranks = [], []
    for entry in range(STATES):
        states, total = machine.scan(kinds, entry)
        vector = machine.vectors[states[-1]]
        reach = [q for q in range(STATES) if vector[q] < FAR]
        ways = {q: "".join(machine.trace(kinds, states, 1 << q, entry)[0]) for q in reach}
        order = {q: k for k, q in enumerate(sorted(reach, key=lambda q: ways[q]))}
        costs += [total + vector[q] if q in order else FAR for q in range(STATES)]
        ranks += [order.get(q, STATES) for q in range(STATES)]
    return costs, ranks


def faults(role: Column, text: Column, repeated: Column) -> tuple[Column, Column]:
    """The fault of a turn (blank, duplicate, truncated or null), and its kind as a number."""
    bare = F.rtrim(text, F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(repeated, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    known = F.create_map(*(F.lit(x) for k, c in enumerate("sua") for x in (c, k)))
    initial = F.coalesce(F.try_element_at(known, F.left(role, F.lit(1))), F.lit(3))
    return fault, F.when(fault.isin("blank", "duplicate"), GONE).otherwise(initial + F.when(fault == "truncated", 4).otherwise(0))


def tables(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns in order with ``id``, a number that grows with it, and what the automaton needs of each: id, conv_id, kind, initial, fault.

    Both are written in the shared folder and left there for what reads the result.
    """
    spark = conversations.sparkSession
    at = f"{shared_dir(spark)}/structure-{uuid.uuid4().hex}"
    turns = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    ranged = turns.withColumn("hash", F.xxhash64("text")).repartitionByRange("conv_id", "turn", "role", "hash").sortWithinPartitions("conv_id", "turn", "role", "hash", "text")
    ranged.drop("hash").withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{at}/turns")
    rows = spark.read.parquet(f"{at}/turns")
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("is_first"))
    fault, number = faults(F.col("role"), F.col("text"), F.lit(False))
    facts = rows.select("id", "conv_id", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), number.alias("kind")).join(first, "id", "left")
    again = F.col("is_first").isNull() & ~F.col("fault").eqNullSafe("blank")
    facts.select("id", "conv_id", "initial", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"), F.when(again, GONE).otherwise(F.col("kind")).alias("kind")).write.parquet(f"{at}/facts")
    return rows, spark.read.parquet(f"{at}/facts")


def own_runs(group: pa.Table) -> list[tuple[int, int, bool]]:
    """From, up to and whether it may go on in another chunk, of each conversation of a chunk."""
    found = list(runs(group))
    return [(a, b, k in (0, len(found) - 1)) for k, (a, b) in enumerate(found)]


MACHINE = Automaton()  # of each worker; its tables fill with the first turns


def measured(group: pa.Table) -> dict[str, list]:
    """Pieces of the conversations at the chunk's ends: what they cost between all states."""
    kinds, ids, initials = (group.column(c).to_pylist() for c in ("kind", "id", "initial"))
    own = group.column("conv_id")
    out: dict[str, list] = {"conv_id": [], "first_id": [], "last_initial": [], "costs": [], "ranks": []}
    for a, b, is_open in own_runs(group):
        if is_open:
            costs, ranks = piece(kinds[a:b], MACHINE)
            for n, v in zip(out, (own[a].as_py(), ids[a], initials[b - 1], costs, ranks), strict=True):
                out[n].append(v)
    return out


def joined(group: pa.Table) -> dict[str, list]:
    """The states that each piece of a conversation begins and ends in: the cheapest, and of these the first by letters."""
    costs, ranks = (np.array(group.column(c).to_pylist(), np.int64).reshape(-1, STATES, STATES) for c in ("costs", "ranks"))
    rests = [np.array(TAIL, np.int64)]
    for m in costs[:0:-1]:
        rests.append(np.minimum((m + rests[-1]).min(1), FAR))
    states = [START]
    for m, rank, rest in zip(costs, ranks, reversed(rests), strict=True):
        total = m[states[-1]] + rest
        states.append(int(np.argmin(np.where(total == total.min(), rank[states[-1]], STATES + 1))))
    before = [None, *group.column("last_initial").to_pylist()[:-1]]
    return {"first_id": group.column("first_id").to_pylist(), "entry": states[:-1], "leave": states[1:], "is_last": [False] * (len(costs) - 1) + [True], "before": before}


def taken(edits: list[str], kinds: list[int], state: int) -> Iterator[tuple[list[str], str | None, list[str]]]:
    """Of each turn the roles of the empty turns before it, its new role if it gets one, and the roles of the empty turns after it."""
    for own, number in zip(edits, kinds, strict=True):
        before: list[str] = []
        after: list[str] = []
        into, new = before, None
        for letter in own:
            if letter == "I":
                into.append(ROLE[DUE[state]])
                state = AFTER[state]
            else:
                into = after
                if letter == "R":
                    new, state = ROLE[DUE[state]], AFTER[state]
                elif letter == "K":
                    state = kept_as(state, number % 4)
        yield before, new, after


def edited(group: pa.Table) -> dict[str, list]:
    """The edits of a chunk's turns, the roles they lead to, and whether a turn's role may not follow the one before it."""
    kinds, initials = group.column("kind").to_pylist(), group.column("initial").to_pylist()
    parts = {p["first_id"]: p for p in group.column("parts")[0].as_py()}
    ids = group.column("id").to_pylist()
    out: dict[str, list] = {"id": ids, "fault": group.column("fault").to_pylist(), "edits": [], "illegal": [], "before": [], "new_role": [], "after": []}
    for a, b, is_open in own_runs(group):
        part = {"entry": START, "before": None}
        if is_open:
            part = parts[ids[a]]
            states, _ = MACHINE.scan(kinds[a:b], part["entry"])
            own, q = MACHINE.trace(kinds[a:b], states, 1 << part["leave"], part["entry"])
            own[-1] += "I" * (TAIL[q] // INSERT) if part["is_last"] else ""
        else:
            own, _ = repair(kinds[a:b], MACHINE)
        out["edits"] += own
        for before, new, after in taken(own, kinds[a:b], part["entry"]):
            out["before"].append(before)
            out["new_role"].append(new)
            out["after"].append(after)
        last = part["before"]
        for x in initials[a:b]:
            out["illegal"].append(last is not None and last + x not in ("su", "ua", "au"))
            last = x
    return out


def repaired(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each turn: conv_id, id, turn, role, text, ``fault``, ``edits``, ``illegal``, ``cost`` and ``new_turns``.

    edits: D, K or R, after an I for each empty turn put in before it; the last turn's also has those put in after it. new_turns:
    an array of (role, text), the repaired turns that come of it. id numbers the turns of a conversation in order, with gaps.
    """
    rows, facts = tables(conversations)
    shift = chunk.bit_length() - 1
    small = facts.withColumn("chunk", F.shiftright("id", shift)).repartition("chunk").sortWithinPartitions("chunk", "id")
    conv, own = rows.schema["conv_id"].dataType.simpleString(), to_arrow_type(rows.schema["conv_id"].dataType)
    schema = pa.schema([("conv_id", own), ("first_id", pa.int64()), ("last_initial", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])
    pieces = small.mapInArrow(per_task(per_group(["chunk"], measured, schema)), f"conv_id {conv}, first_id bigint, last_initial string, costs array<bigint>, ranks array<bigint>")
    schema = pa.schema([("first_id", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64()), ("is_last", pa.bool_()), ("before", pa.string())])
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first_id")
    states = ordered.mapInArrow(per_task(per_group(["conv_id"], joined, schema)), "first_id bigint, entry bigint, leave bigint, is_last boolean, before string")
    parts = states.groupBy(F.shiftright("first_id", shift).alias("chunk")).agg(F.collect_list(F.struct("first_id", "entry", "leave", "is_last", "before")).alias("parts"))  # two at most
    both = small.join(parts, "chunk").sortWithinPartitions("chunk", "id")
    words = pa.list_(pa.string())
    schema = pa.schema([("id", pa.int64()), ("fault", pa.string()), ("edits", pa.string()), ("illegal", pa.bool_()), ("before", words), ("new_role", pa.string()), ("after", words)])
    edits = both.mapInArrow(per_task(per_group(["chunk"], edited, schema)), "id bigint, fault string, edits string, illegal boolean, before array<string>, new_role string, after array<string>")
    return with_turns(rows.join(edits, "id"))


def with_turns(rows: DataFrame) -> DataFrame:
    """Adds ``cost`` and ``new_turns``, which the edits make of each turn."""
    times = lambda letter: F.length("edits") - F.length(F.translate("edits", letter, ""))
    stays = times("D") == 0
    cost = INSERT * times("I") + DELETE * times("D") + RELABEL * times("R") + F.when((F.col("fault") == "truncated") & stays, UNFINISHED).otherwise(0)
    empty = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.filter(F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))), lambda _: stays)
    new = F.concat(empty("before"), own, empty("after"))
    return rows.select("conv_id", "id", "turn", "role", "text", "fault", "edits", "illegal", cost.cast("bigint").alias("cost"), new.alias("new_turns"))


SUMS = ("blank", "duplicate", "truncated", "illegal", "cost")


def digested(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each conversation; rows come in its order. Holds one conversation's audit, but no texts."""
    key: object = batches  # like no conversation
    audit: list[str] = []
    sums: dict[str, int] = {}
    sha, lines, turns = hashlib.sha256(), 0, (None, None, 0)
    out: dict[str, list] = {n: [] for n in schema.names}

    def close() -> None:
        low, high, distinct = turns
        own = (key, high - low + 1 - distinct if distinct else 0, *(sums[n] for n in SUMS), "".join(audit), sha.hexdigest())
        for n, v in zip(schema.names, own, strict=True):
            out[n].append(v)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "fault", "illegal", "cost", "edits", "lines")]
        for conv, turn, fault, illegal, cost, edits, line in zip(*columns, strict=True):
            if conv != key:
                if key is not batches:
                    close()
                key, audit, sums, sha, lines, turns = conv, [], dict.fromkeys(SUMS, 0), hashlib.sha256(), 0, (None, None, 0)
            if fault:
                sums[fault] += 1
            sums["illegal"] += illegal
            sums["cost"] += cost
            audit.append(edits)
            if turn is not None and turn != turns[1]:
                turns = (turn if turns[0] is None else turns[0], turn, turns[2] + 1)
            if line is not None:
                sha.update((b"\n" if lines else b"") + line.encode())
                lines += 1
        if len(out["conv_id"]) >= 4096:
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            out = {n: [] for n in schema.names}
    if key is not batches:
        close()
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def digests(turns: DataFrame, originals: DataFrame) -> DataFrame:
    """``conv_id``, ``gaps``, counts of faults, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256`` of each conversation.

    turns: as ``repaired`` gives them; originals: whose conv_ids come without turns too. A conversation's hash is made in one task,
    row after row, as a hash goes.
    """
    lines = F.array_join(F.transform("new_turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    rows = turns.select("conv_id", "id", F.col("turn").cast("bigint").alias("turn"), "fault", "illegal", "cost", "edits", F.when(F.size("new_turns") > 0, lines).alias("lines"))
    conv = rows.schema["conv_id"].dataType
    numbers = ["gaps", *SUMS]
    schema = pa.schema([("conv_id", to_arrow_type(conv)), *((n, pa.int64()) for n in numbers), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    form = f"conv_id {conv.simpleString()}, {', '.join(f'{n} bigint' for n in numbers)}, audit string, repaired_sha256 string"
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "id")
    found = ordered.mapInArrow(per_task(lambda batches: digested(batches, schema)), form)
    every = originals.select("conv_id", *(F.lit(0).cast("bigint").alias(n) for n in numbers), F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256")).distinct()
    none = hashlib.sha256(b"").hexdigest()
    most = found.unionByName(every).groupBy("conv_id").agg(*(F.max(n).alias(n) for n in (*numbers, "audit", "repaired_sha256")))
    return most.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(none)))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, by the checksum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user; others stay.
    """
    space = F.lit(" ")
    names = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(names.cast("binary")) % 20).alias("by")).where("by <> 0")
    rows = rows.withColumn("text", F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).withColumn("role", F.when(F.col("by") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")
