"""Folds whose steps depend on each other, over ordered rows of many keys, one of which may have most of them.

Rows are sorted by ranges of key and order, so that a key may go over many ranges, and a task streams its range with one state in
hand. What comes before the first new key of a range waits; everything else is done at once. Then the state at a range's end is
handed to the next, whose waiting rows are folded from it: one more round where every range has a new key, and as many as ranges
for a key that fills them, since such folds have no other order. The driver sees two keys and a state a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from wayline.operators.stages import tabled

#: State before a row (null at first) and the row's values; the state after it and what to give out.
Step = Callable[[tuple | None, tuple], tuple[tuple, tuple]]
PART_BITS = 33  #: of an id below the number of its partition
OUT_ROWS = 8192


def scan(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str], step: Step, state: str, out: str, thaw: Callable = lambda x: x, freeze: Callable = lambda x: x) -> DataFrame:
    """``key``, ``order`` and the columns of ``out`` (DDL) for each row.

    step: from a state (columns of ``state``, DDL) and a row's ``order`` and ``values``, in this order. Rows of a key that are equal
    in ``order`` come by ``values``; a null key is a key, null orders come first. Where the state in hand is not what is handed over,
    ``freeze`` makes its columns of it and ``thaw`` the state again.
    """
    given = [*order, *values]
    plain = rows.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_in{k}") for k, c in enumerate(given)))
    ranges = [c for c in plain.columns if c != "_id"]
    ranged = plain.repartitionByRange(*ranges).sortWithinPartitions(*ranges).withColumn("_id", F.monotonically_increasing_id())
    results, states = StructType.fromDDL(out), StructType.fromDDL(state)
    wide = StructType([
        *(StructField(f.name, f.dataType) for f in ranged.schema), *(StructField(f"_out{k}", f.dataType) for k, f in enumerate(results)),
        StructField("_waits", BooleanType()), StructField("_first", ranged.schema["_key"].dataType), StructField("_state", states), StructField("_count", LongType()),
    ])
    schema, n_in, n_out = to_arrow_schema(wide), len(given), len(results)
    names = [f.name for f in states]

    def folded(batches: Iterator[pa.RecordBatch], entries: dict[int, tuple | None] | None) -> Iterator[pa.RecordBatch]:
        """entries: the state that each range begins with; null in the first round, where it is not known."""
        held: list[tuple] = []
        part, own, first, now, known, count, last_id = None, None, None, None, False, 0, 0

        def end() -> tuple:
            return (own, *[None] * n_in, last_id, *[None] * n_out, None, first, dict(zip(names, freeze(now), strict=True)) if known else None, count)

        def given_out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_key", *(f"_in{k}" for k in range(n_in)), "_id")]
            for name, *row, at in zip(*columns, strict=True):
                if part is None or at >> PART_BITS != part:
                    if part is not None:
                        held.append(end())
                    part, first, count = at >> PART_BITS, name, 0
                    known = entries is not None
                    now = thaw(entries[part]) if known and entries[part] is not None else None
                elif name != own:
                    known, now = True, None
                own, last_id, count = name, at, count + 1
                result: tuple = (None,) * n_out
                if known:
                    now, result = step(now, tuple(row))
                held.append((name, *row, at, *result, not known, None, None, None))
            if len(held) >= OUT_ROWS:
                yield given_out()
                held = []
        if part is not None:
            held.append(end())
        if held:
            yield given_out()

    def done(df: DataFrame) -> tuple[DataFrame, dict[int, tuple]]:
        """The table of a round, and of each range (first key, last key, state at its end or null, which it isn't while all wait)."""
        table = tabled(df)
        ends = table.where("_count is not null").select("_id", "_first", "_key", "_state").collect()  # a row for each range
        return table, {r._id >> PART_BITS: (r._first, r._key, None if r._state is None else tuple(r._state)) for r in ends}

    table, ends = done(ranged.mapInArrow(lambda batches: folded(batches, None), wide))
    numbers = sorted(ends)
    before = dict(zip(numbers, [None, *numbers], strict=False))
    tables, waiting = [table], set(numbers)
    part = F.shiftright("_id", PART_BITS)
    while waiting:
        ready = [p for p in waiting if before[p] is None or ends[before[p]][2] is not None or ends[before[p]][1] != ends[p][0]]
        entries = {p: ends[before[p]][2] if before[p] is not None and ends[before[p]][1] == ends[p][0] else None for p in ready}
        rest = table.where("_waits").where(part.isin(ready)).select(*ranged.columns).repartition(part).sortWithinPartitions("_id")
        more, found = done(rest.mapInArrow(lambda batches, entries=entries: folded(batches, entries), wide))
        for p, (first, last, now) in found.items():
            if ends[p][2] is None:
                ends[p] = first, last, now
        tables.append(more)
        waiting -= set(ready)

    every = tables[0].where("not _waits")
    for more in tables[1:]:
        every = every.unionByName(more.where("not _waits"))
    return every.select(F.col("_key").alias(key), *(F.col(f"_in{k}").alias(c) for k, c in enumerate(order)), *(F.col(f"_out{k}").alias(f.name) for k, f in enumerate(results)))
