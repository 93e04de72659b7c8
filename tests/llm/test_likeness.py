"""Near copies against brute force over five-word runs."""

import random

import corpus_pipeline
from wayline.llm import likeness


def edited(rng, words, share):
    return [f"z{rng.random()}" if rng.random() < share else w for w in words]


def groups(rows):
    """doc_id: least id of its component, by comparing all pairs."""
    sets = [(d, set(likeness.runs(t or "").tolist())) for d, t in rows]
    label = {d: d for d, _ in sets}
    pairs = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x == y or (x and y and len(x & y) >= 0.8 * len(x | y))]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def planted():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, 0.02)))]
    return [*rows, (1000, ""), (1001, None), (1002, "one two"), (1003, "One  two"), (1004, rows[0][1])]


def test_the_stage_drops_planted_near_copies(spark):
    rows = planted()
    want = {d for d, c in groups(rows).items() if d == c}
    docs = spark.createDataFrame([*rows, (None, "no id")], "doc_id bigint, text string")
    kept = corpus_pipeline.keep_first_of_copies(spark, docs, "").collect()
    assert sum(r.doc_id is None for r in kept) == 1
    assert {r.doc_id for r in kept if r.doc_id is not None} == want and len(want) < 230


def test_a_large_group_is_dealt_anew(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = [(i, " ".join(edited(rng, words, 0.01))) for i in range(200)] + [(500, " ".join(f"v{i}" for i in range(90)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for chunk in (8, 256):
        assert {r.doc_id: r.component_id for r in likeness.near_copies(docs, chunk=chunk).collect()} == groups(rows)


def test_nothing(spark):
    assert likeness.near_copies(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
