"""Fingerprints and near-duplicates against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wayline.llm import simhash, sketch
from wayline.llm.components import components
from wayline.llm.queries import op3_scaled_sketch


def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """Least index of each print's component, by comparing all pairs."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4 and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def test_near_duplicates(docs, pairs):
    prints = [simhash_of(t) for _, t in pairs]
    label = linked(prints)
    ids = {}
    for (d, _), c in zip(pairs, label, strict=True):
        if d is not None:
            ids[c] = min(ids.get(c, d), d)
    want = Counter((d, p, ids.get(c)) for (d, _), p, c in zip(pairs, prints, label, strict=True))
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in found) == want


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_a_dense_group():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 60, rng.integers(0, 4)).astype(np.uint64)) if n else b for b in base for n in range(70)]
    prints = np.unique(np.array(near, np.uint64))
    order = sorted(prints.tolist(), key=lambda x: (x ^ x >> 1, x))
    a, b = simhash.group_links(np.zeros(len(order), np.int64), np.array(order, np.uint64))
    label = list(range(len(order)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert root(x) != root(y)
        label[max(root(x), root(y))] = min(root(x), root(y))
    assert [root(i) for i in range(len(order))] == linked(order)


def test_large_groups_are_dealt_anew(spark):
    rng = np.random.default_rng(6)
    centre = int(rng.integers(0, 1 << 63))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(120)} | {int(x) for x in rng.integers(0, 1 << 63, 40)}
    order = sorted(prints)
    classes = spark.createDataFrame([(simhash.signed(x),) for x in order], "fingerprint bigint")
    want = linked(order)
    for hot in (3, 20, 1 << 16):
        found = {r.node: r.component for r in components(simhash.links(classes, hot)).collect()}
        groups = {}
        for x, c in zip(order, want, strict=True):
            groups.setdefault(c, set()).add(found.get(simhash.signed(x), simhash.signed(x)))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (1, 0)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert found == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 160), 100)}


def shingles(spark, texts):
    """The hashes of each text's distinct five-word runs, as Spark has them: of the words' own hashes."""
    rows = []
    for k, t in enumerate(texts):
        w = re.sub(r"[ \t\n\x0B\f\r]+", " ", t.lower()).strip(" ").split(" ") if t.strip(" \t\n\x0B\f\r") else []
        runs = [w[i : i + 5] for i in range(len(w) - 4)] or ([w] if w else [])
        rows += [(k, r) for r in {tuple(r) for r in runs}]
    df = spark.createDataFrame([(k, list(r)) for k, r in rows], "k int, w array<string>").withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    five = df.select("k", F.when(F.size("w") >= 5, F.xxhash64(*(F.get("h", F.lit(i)) for i in range(5)))).otherwise(F.xxhash64("h")).alias("h"))
    found = [set() for _ in texts]
    for r in five.collect():
        found[r.k].add(r.h)
    return found


def test_sketches(spark, rows, tmp_path):
    """Every value of the query against one worked out from all shingle hashes."""
    own = {r[0]: r for r in rows if r[0] is not None}
    spark.createDataFrame([own[k][:2] for k in own], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op3_scaled_sketch(spark, str(tmp_path)).collect()}
    ids = sorted(own, reverse=True)
    plain = [own[d][1] or "" for d in ids]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(plain, plain[1:] + plain[:1], strict=True)]
    hashes = shingles(spark, plain + edited)
    low = [{h for h in x if 0 <= h < 1 << 62} for x in hashes]

    def alike(i, j):
        if low[i] and low[j]:
            return len(low[i] & low[j]) / min(len(low[i]), len(low[j]))
        return float(not low[i] and not low[j] and min(hashes[i], default=None) == min(hashes[j], default=None))

    def digits(i):
        return "".join(f"{h:016x}" for h in sorted(low[i])) + (f"-{min(hashes[i]) & (1 << 64) - 1:016x}" if hashes[i] else "")

    n = len(ids)
    for i, d in enumerate(ids):
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (len(plain[i]), hashlib.sha256(edited[i].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digits(i), digits(n + i))
        assert abs(r.near_edited - alike(i, n + i)) < 1e-12 and abs(r.near_next - alike(i, (i + 1) % n)) < 1e-12
    assert len(found) == n


def test_order_of_repeated_and_null_ids(spark):
    """A third of the rows have one id, a third none: each row's next is that of one sorted list."""
    rng = np.random.default_rng(1)
    rows = [(int(d), f"t{rng.integers(1 << 40)}") for d in (*range(300), *[77] * 300)] + [(None, f"t{rng.integers(1 << 40)}") for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = {r.text: r.o for r in df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 33).alias("o")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order[r[1]], r[1]), reverse=True)
    found = {(r.doc_id, r.text): r.next_text for r in sketch.with_next(df.repartition(7), "text").collect()}
    assert found == {w: want[(i + 1) % len(want)][1] for i, w in enumerate(want)}


def test_sketches_with_nulls_repeats_and_nothing(docs, empty, rows):
    assert sketch.edited_fingerprints(docs).count() == len(rows)
    assert sketch.edited_fingerprints(empty).count() == 0


def test_merged_fingerprints_are_those_of_both_texts(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (3, 5, 6, 8, 40, 400)]
    rows = [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    df = sketch.with_fingerprint(sketch.with_fingerprint(spark.createDataFrame(rows, "i int, j int, a string, b string"), "a", "x"), "b", "y")
    one = shingles(spark, texts)
    for r in df.select("i", "j", sketch.merged(F.col("x"), F.col("y")).alias("m")).collect():
        both = one[r.i] | one[r.j]
        assert set(r.m.sketch) == {h for h in both if 0 <= h < 1 << 62} and r.m.least == min(both)


def test_containment_of_unequal_documents(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[500:900])), (3, " ".join(f"z{i}" for i in range(400)))]
    f = sketch.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "fingerprint")
    a, b = f.select(F.col("doc_id").alias("d"), F.col("fingerprint").alias("a")), f.withColumnRenamed("fingerprint", "b")
    found = {r.doc_id: (r.near, r.n) for r in a.where("d = 1").crossJoin(b).select("doc_id", sketch.likeness(F.col("a"), F.col("b")).alias("near"), F.size("a.sketch").alias("n")).collect()}
    assert found[2][0] == 1 and found[3][0] == 0 and 800 < found[1][1] < 1200
