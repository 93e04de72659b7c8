"""Training-order materialisation of token ids as fixed-stride binary shards.

Every sequence has an index: its task's first index plus its place in the task.
A keyed Feistel permutation over the least square of two powers that holds all
indexes, walked until it lands below their number, gives its global slot.
Sequences are dealt by ranges of whole shards, sorted, and written one after the
other, so slot s is at (s mod rows of a shard) x stride of shard s div rows. A
shard is written under a temporary name and then renamed: a task that is run
again, or twice, leaves the same file. The manifest, written first, says how many
slots and shards there are; ``missing`` compares. ``read_slots`` starts at any
slot.

Ids come as a binary column of little-endian unsigned integers of 1, 2 or 4
bytes, as ``bpe.encode`` has them, or as texts: then they are the UTF-8 bytes + 3,
0 for padding and 1 for the end, one byte each (no byte of UTF-8 is over 244).
Null and empty ones are one sequence that holds the end alone. Repeated rows stay
repeated; other columns are ignored; an empty table writes a manifest and no
shard.

The index needs rows that come in the same order at each reading. Rows of files
do; others are written to the shared folder first, unless ``stable`` says that
they come so. Where order still changes, a shard finds its slots missing or
double, and the job fails.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import per_task, written

LENGTH, SHARD_ROWS, ROUNDS = 512, 32_768, 6


@dataclass(frozen=True)
class Ids:
    """How ids are kept: bytes of each, what is added to them, and the ids of padding and of the end (after adding)."""

    width: int = 1
    shift: int = 3
    pad: int = 0
    end: int = 1

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"<u{self.width}")


BYTES = Ids()

#: The multipliers of a public 64-bit mixing function.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def round_keys(key: int, rounds: int = ROUNDS) -> list[int]:
    return np.random.default_rng(key).integers(0, 1 << 63, rounds).tolist()


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(key)
        for shift, by in zip((30, 27), MIX, strict=True):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    """A permutation of the numbers below 4 to the power half."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        left, right = right, left ^ (mixed(right, k) & mask)
    return left << np.uint64(half) | right


def slots(index: np.ndarray, total: int, keys: list[int]) -> np.ndarray:
    """A permutation of the numbers below total: walk on until below it."""
    half = max(1, -(-max(1, total - 1).bit_length() // 2))
    out = feistel(index.astype(np.uint64), half, keys)
    while (over := np.flatnonzero(out >= total)).size:
        out[over] = feistel(out[over], half, keys)
    return out.astype(np.int64)


def deflate(body: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, -zlib.MAX_WBITS)
    return packer.compress(body) + packer.flush()


def sequences(docs: DataFrame, length: int, width: int) -> tuple[DataFrame, int]:
    """``doc_id``, ``seq``, ``n_tokens``, ``body`` (its ids) and ``index`` of each sequence, and their number. docs: ``doc_id``, ``body``."""
    n_ids = (F.octet_length("body") / width).cast("bigint")
    n = F.ceil((n_ids + 1) / F.lit(length)).cast("bigint")
    task = F.spark_partition_id()
    sizes = sorted(tuple(r) for r in docs.groupBy(task.alias("task")).agg(F.sum(n)).collect())  # a row per task
    starts, total = [], 0
    for t, size in sizes:
        starts.append((t, total))
        total += size
    first = F.broadcast(docs.sparkSession.createDataFrame(starts, "task int, first bigint"))
    each = docs.select("doc_id", "body", n_ids.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("seq"))
    each = each.select(
        "doc_id", "seq",
        F.least(F.lit(length), F.col("n") + 1 - F.col("seq") * length).cast("int").alias("n_tokens"),
        F.substring("body", (F.col("seq") * length * width + 1).cast("int"), F.lit(length * width)).alias("body"),
        task.alias("task"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    )
    return each.join(first, "task").select("doc_id", "seq", "n_tokens", "body", (F.col("first") + F.col("place")).alias("index")), total


def materialise(docs: DataFrame, folder: str, key: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS, ids: str | None = None, form: Ids = BYTES, stable: bool = False) -> DataFrame:
    """Writes the shards; returns ``doc_id``, ``seq``, ``n_tokens``, ``slot``, ``shard`` and ``offset`` (in bytes) of each sequence.

    ids: the column of token ids, in ``form``; none: those of the texts' bytes. Ids that, shifted, don't fit or mean padding or the
    end raise an error.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(ids), F.lit(b"")) if ids else F.coalesce("text", F.lit("")).cast("binary")
    base = docs.select("doc_id", body.alias("body"))
    each, total = sequences(base if stable else written(base)[0], length, form.width)
    keys = round_keys(key)
    kind = each.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "seq", "n_tokens", "slot"]
    write_manifest(folder, {"total": total, "length": length, "shard_rows": shard_rows, "shards": -(-total // shard_rows), "key": key, **asdict(form)})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = slots(batch.column("index").to_numpy(), total, keys)
            names = ["doc_id", "seq", "n_tokens", "body"]
            packed = pa.array([deflate(x) for x in batch.column("body").to_pylist()], pa.binary())  # less to shuffle
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "seq", "n_tokens")), packed, pa.array(slot)], names=[*names, "slot"])

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pyarrow.fs.FileSystem.from_uri(folder)
        now, out, name, due = None, None, "", 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                if due != min(total, (now + 1) * shard_rows):
                    raise ValueError(f"shard {now} ends at slot {due}")
                files.move(name, shard_path(at, now))
                out = None

        try:
            for batch in batches:
                slot = batch.column("slot").to_numpy()
                shard = slot // shard_rows
                records = np.full((batch.num_rows, length), form.pad, form.dtype)
                for i, (packed, n) in enumerate(zip(batch.column("body").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True)):
                    own = np.frombuffer(zlib.decompress(packed, -zlib.MAX_WBITS), form.dtype).astype(np.int64) + form.shift
                    if len(own) and (own.max() >= 1 << 8 * form.width or ((own == form.pad) | (own == form.end)).any()):
                        raise ValueError(f"a token id is too large for {form.width} bytes, or is that of padding ({form.pad}) or of the end ({form.end})")
                    records[i, : len(own)] = own
                    if n > len(own):
                        records[i, len(own)] = form.end
                for s in np.unique(shard).tolist():
                    rows = np.flatnonzero(shard == s)
                    if s != now:
                        close()
                        now, due = s, s * shard_rows
                        name = f"{at}/.{s}-{np.random.default_rng().integers(1 << 62):x}"
                        out = files.open_output_stream(name)
                    if (slot[rows] != np.arange(due, due + len(rows))).any():
                        raise ValueError(f"slots of shard {s} are missing or double: the input changed between two readings")
                    out.write(records[rows].tobytes())
                    due += len(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns)], names=columns)
            close()
        finally:
            if out is not None:  # what a failed task leaves
                out.close()
                files.delete_file(name)

    n_shards = max(1, -(-total // shard_rows))
    parts = min(n_shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_shards // 16)))
    spread = F.floor(F.floor(F.col("slot") / shard_rows) * parts / n_shards)
    dealt = each.mapInArrow(per_task(placed), f"doc_id {kind}, seq bigint, n_tokens int, body binary, slot bigint").repartitionById(parts, spread.cast("int")).sortWithinPartitions("slot")
    done = dealt.mapInArrow(per_task(shards_of), f"doc_id {kind}, seq bigint, n_tokens int, slot bigint")
    return done.select("*", F.floor(F.col("slot") / shard_rows).alias("shard"), (F.col("slot") % shard_rows * length * form.width).alias("offset"))


def shard_path(at: str, shard: int) -> str:
    return f"{at}/shard-{shard:08d}.bin"


def write_manifest(folder: str, manifest: dict[str, int]) -> None:
    files, at = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())


def read_manifest(folder: str) -> dict[str, int]:
    files, at = pyarrow.fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


def missing(folder: str) -> list[int]:
    """The shards that the manifest promises and that aren't there, or not whole."""
    files, at = pyarrow.fs.FileSystem.from_uri(folder)
    m = read_manifest(folder)
    sizes = {x.base_name: x.size for x in files.get_file_info(pyarrow.fs.FileSelector(at))}
    whole = lambda k: (min(m["total"], (k + 1) * m["shard_rows"]) - k * m["shard_rows"]) * m["length"] * m["width"]
    return [k for k in range(m["shards"]) if sizes.get(f"shard-{k:08d}.bin") != whole(k)]


def read_slots(folder: str, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
    """Token ids of the slots from first up to last, in training order; padding is left out."""
    files, at = pyarrow.fs.FileSystem.from_uri(folder)
    m = read_manifest(folder)
    form = Ids(*(m[k] for k in ("width", "shift", "pad", "end")))
    last = m["total"] if last is None else min(last, m["total"])
    stride = m["length"] * form.width
    while first < last:
        shard = first // m["shard_rows"]
        with files.open_input_file(shard_path(at, shard)) as f:
            f.seek(first % m["shard_rows"] * stride)
            for _ in range(first, min(last, (shard + 1) * m["shard_rows"])):
                record = np.frombuffer(f.read(stride), form.dtype)
                yield record[record != form.pad]
                first += 1


def text_of(ids: np.ndarray) -> bytes:
    """The bytes of a sequence of byte ids, without the end."""
    return (ids[ids >= BYTES.shift] - BYTES.shift).astype(np.uint8).tobytes()
