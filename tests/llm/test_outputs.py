"""Shards and chats."""

from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayline.llm import bpe, chat, shards


def test_slots_are_a_permutation():
    for total in (1, 2, 3, 17, 64, 1000):
        assert sorted(shards.slots(np.arange(total), total, shards.round_keys(9)).tolist()) == list(range(total))


def test_shards_hold_every_sequence(docs, rows, empty, tmp_path):
    folder = f"file://{tmp_path}/out"
    placed = shards.materialise(docs, folder, key=3, length=128, shard_rows=200).collect()
    assert sorted(r.slot for r in placed) == list(range(len(placed)))
    assert not shards.missing(folder) and shards.read_manifest(folder)["total"] == len(placed)
    read = list(shards.read_slots(folder))
    texts = {}
    for r in placed:
        assert len(read[r.slot]) == r.n_tokens and (r.shard, r.offset) == (r.slot // 200, r.slot % 200 * 128)
        if r.doc_id is not None:
            texts.setdefault(r.doc_id, {}).setdefault(r.seq, shards.text_of(read[r.slot]))
    for d, t, *_ in rows:
        if d is not None:
            assert b"".join(texts[d][k] for k in sorted(texts[d])).decode() == (t or "")
    resumed = list(shards.read_slots(folder, 300, 310))
    assert [x.tolist() for x in resumed] == [x.tolist() for x in read[300:310]]
    (tmp_path / "out" / "shard-00000001.bin").unlink()
    assert shards.missing(folder) == [1] and not any(p.name.startswith(".") and not p.name.endswith(".crc") for p in (tmp_path / "out").iterdir())
    assert shards.materialise(empty, f"{folder}-none", key=3).count() == 0 and not shards.missing(f"{folder}-none")


def test_shards_of_a_tokenizer(docs, pairs, tmp_path):
    """The ids of op2, two bytes each, in training order."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(docs.where("doc_id is not null"), path)
    short = F.expr("transform(sequence(0, length(ids) div 4 - 1), i -> substring(ids, i * 4 + 1, 2))")
    two = encoded.withColumn("ids", F.when(F.col("n_tokens") > 0, F.array_join(F.transform(short, F.hex), "")).otherwise("")).withColumn("ids", F.unhex("ids"))
    form = shards.Ids(2, 0, 65535, 65534)
    placed = shards.materialise(two, f"file://{tmp_path}/ids", key=5, length=64, shard_rows=50, ids="ids", form=form).collect()
    read = list(shards.read_slots(f"file://{tmp_path}/ids"))
    own = {}
    for r in placed:
        assert r.offset == r.slot % 50 * 128 and len(read[r.slot]) == r.n_tokens
        own.setdefault(r.doc_id, {})[r.seq] = read[r.slot]
    tok = Tokenizer.from_file(path)
    for d, t in pairs:
        if d is not None:
            ids = np.concatenate([own[d][k] for k in sorted(own[d])])
            assert ids[-1] == 65534 and ids[:-1].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_ids_that_cannot_be_told_apart_raise(spark, tmp_path):
    for k, (shift, ids) in enumerate(((3, [250, 253]), (0, [7, 255]), (0, [254]), (1, [253]), (0, [1, 0, 253]))):
        docs = spark.createDataFrame([(1, bytearray(ids))], "doc_id bigint, ids binary")
        run = lambda: shards.materialise(docs, f"file://{tmp_path}/{k}", key=1, ids="ids", form=shards.Ids(1, shift, 255, 254)).collect()  # noqa: B023, E731
        if k < 4:
            with pytest.raises(Exception, match="token id"):
                run()
        else:
            run()
            assert [x.tolist() for x in shards.read_slots(f"file://{tmp_path}/{k}")] == [[1, 0, 253, 254]]


def least_cost(roles):
    """By trying every role for every turn."""
    best = None
    for chosen in product((1, 2, 3), repeat=len(roles)):
        state, total = 0, 0
        for role, r in zip(roles, chosen, strict=True):
            own = chat.ROLES.index(role) + 1 if role in chat.ROLES else 0
            costs = [c for c, _, _ in chat.moves(state, r)]
            if not costs:
                break
            total, state = total + min(costs) + (chat.RELABEL if r != own else 0), r
        else:
            best = total if best is None else min(best, total)
    return best


def cost_of(turns):
    return sum({"keep": 0, "relabel": 3, "merge": 2, "relabel+merge": 5}[t.action] + 4 * len([x for x in t.inserted.split(",") if x]) for t in turns)


def test_repairs_cost_least(spark):
    kinds = ("system", "user", "assistant", "tool", None)
    rng = np.random.default_rng(4)
    chats = {c: [kinds[k] for k in rng.integers(0, 5, rng.integers(1, 7))] for c in range(60)}
    rows = [(c, t, role, f"text {c} {t}" if t != 2 else None, "x") for c, roles in chats.items() for t, role in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, chunk string")
    for chunk in (2, 1024):
        done = {}
        for r in chat.repaired(df, chunk).collect():
            done.setdefault(r.conv_id, []).append(r)
        for c, roles in chats.items():
            turns = sorted(done[c], key=lambda r: r.turn)
            assert [t.role for t in turns] == roles and cost_of(turns) == least_cost(roles)
            text = "".join(t.rendered for t in turns)
            assert text.endswith(chat.CLOSE) and text.count("<|im_start|>") == text.count(chat.CLOSE)
            said = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
            said = said[1:] if said[0] == "system" else said
            assert said == [("user", "assistant")[i % 2] for i in range(len(said))]


def test_repairs_of_nulls_and_nothing(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (3, None, "user", "b"), (3, 1, "user", "b"), (3, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert chat.repaired(df).count() == len(rows) and chat.repaired(df.limit(0)).count() == 0
