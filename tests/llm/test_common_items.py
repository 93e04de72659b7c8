"""Recall by kind of item: held by a large share of the rows, of common words, changed, or hardly in the latent space."""

import random
from collections import Counter

import numpy as np

from wayline.llm import decontaminate
from wayline.llm.common import read

WORDS = [f"w{i}" for i in range(2000)]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_an_item_held_by_a_third_of_the_rows(spark):
    rng = random.Random(2)
    items = [(i, passage(rng, 25)) for i in range(30)]
    clean = [(i, passage(rng, rng.randint(20, 100))) for i in range(300)]
    held = [(1000 + i, f"{passage(rng, 20)} {items[0][1]}") for i in range(150)]
    docs = spark.createDataFrame(clean + held, "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert found == {(d, 0) for d, _ in held}


def test_a_weak_item_is_found_by_its_runs():
    rng = random.Random(3)
    items = decontaminate.Items.of([(7, passage(rng, 25)), (8, "one two three")])
    n = len(items.number)
    latent = decontaminate.LatentItems(items, np.ones(n), np.zeros((n, 4), np.float32), np.zeros((2, 4), np.float32), [0, 1])
    filler = [-1] * 100
    docs = [[*filler, *items.words[0], *filler], [], [*filler, *items.words[1]], items.words[1][:2], items.words[1][2:], [*filler, *items.words[0][:6]]]
    found = latent.found_in([np.array(x, np.int32) for x in docs])
    assert [set(x) for x in found] == [{7}, set(), {8}, set(), set(), set()]


def test_recall_by_kind(spark):
    """Items planted in real documents: verbatim and of common words, with a fifth or a third of the words replaced, with swapped halves."""
    rng = random.Random(7)
    docs = [(r.doc_id, r.text or "") for r in read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    seen = Counter(w for _, t in docs for w in set(decontaminate.WORD.findall(t.lower()))).most_common(3000)
    usual, common = [w for w, _ in seen], [w for w, _ in seen[:40]]
    items = []

    def add(kind, n, source, change=lambda x: x):
        words = [rng.choice(source) for _ in range(n)]
        items.append((kind, " ".join(words), " ".join(change(words))))

    replaced = lambda share: lambda x: [rng.choice(usual) if rng.random() < share else w for w in x]
    for _ in range(20):
        add("common", 20, common)
        add("a fifth", rng.randint(18, 40), usual, replaced(0.2))
        add("a third", rng.randint(18, 40), usual, replaced(0.35))
        add("swapped", 24, usual, lambda x: x[12:] + x[:12])
        add("verbatim", rng.randint(5, 60), usual)
    hosts = [t.split() for _, t in docs if 60 < len(t.split()) < 800]
    planted = []
    for i, ((_, _, held), host) in enumerate(zip(items, rng.sample(hosts, len(items)), strict=True)):
        at = rng.randint(0, len(host))
        planted.append((100_000 + i, " ".join([*host[:at], held, *host[at:]])))
    found = decontaminate.matches(spark.createDataFrame(docs + planted, "doc_id bigint, text string"), spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(items)], "item_id bigint, text string"))
    pairs = {(r.doc_id, r.item_id) for r in found.collect()}
    hit = Counter(k for i, (k, _, _) in enumerate(items) if (100_000 + i, i) in pairs)
    assert all(hit[k] >= 18 for k in ("common", "a fifth", "a third", "swapped")) and hit["verbatim"] == 20, hit
    assert len(pairs) <= sum(hit.values()) + 2


def test_long_items_are_decided_as_a_whole(spark):
    """Items of 65 to 600 words: whole ones are found, also with words replaced; documents that quote a part, but not most and the answer, are clean."""
    rng = random.Random(12)
    docs = [(r.doc_id, r.text or "") for r in read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    usual = [w for w, _ in Counter(w for _, t in docs for w in set(decontaminate.WORD.findall(t.lower()))).most_common(3000)]
    hosts = [t.split() for _, t in docs if 60 < len(t.split()) < 800]
    items, planted, whole, quoting = [], [], set(), set()
    replaced = lambda words, share: [rng.choice(usual) if rng.random() < share else w for w in words]
    for i in range(30):
        words = [rng.choice(usual) for _ in range(rng.choice([65, 66, 100, 129, 250, 600]) if i < 24 else 600)]
        items.append((i, " ".join(words)))
        n = len(words)
        kinds = [words, replaced(words, 0.2), replaced(words, 0.35)] if i < 24 else [words[:60], words[: n // 2], words[n // 4 : n // 2], words[-60:], words[: n // 10] + words[-n // 10 :]]
        for k, held in enumerate(kinds):
            host = rng.choice(hosts)
            at = rng.randint(0, len(host))
            planted.append((100_000 + i * 10 + k, " ".join([*host[:at], *held, *host[at:]])))
            (whole if i < 24 else quoting).add((100_000 + i * 10 + k, i))
    found = decontaminate.matches(spark.createDataFrame(docs + planted, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert not pairs & quoting
    by_kind = Counter(d % 10 for d, _ in pairs & whole)
    assert by_kind[0] == 24 and min(by_kind[1], by_kind[2]) >= 22 and len(pairs) <= len(whole), by_kind
    assert all(r.common_share == 1 and r.answer_share == 1 for r in found if r.doc_id % 10 == 0 and r.doc_id >= 100_000)


def test_matches_are_those_of_all_pairs(spark):
    """Small texts over few words: what is found holds enough of an item in order, and every verbatim item is found."""
    rng = random.Random(5)
    words = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([6, 20, 70, 140])))) for k in range(24)]
    docs = []
    for k in range(90):
        own = rng.choices(words, k=rng.randint(0, 80))
        held = rng.choice(items)[1].split() if k % 3 else []
        cut = len(held) if k % 3 == 1 else rng.randint(0, len(held))
        docs.append((k, " ".join([*own, *held[:cut], *rng.choices(words, k=10)])))
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}

    def share(item, doc):
        numbers = {w: i for i, w in enumerate({*item, *doc})}
        return decontaminate.common_length(decontaminate.places([numbers[w] for w in item]), len(item), [numbers[w] for w in doc]) / len(item)

    for d, text in docs:
        for i, item in items:
            own = item.split()
            if (d, i) in found:
                assert share(own, text.split()) >= decontaminate.LIKELY
            else:
                assert item not in text and not (share(own, text.split()) > 0.95 and len(own) > 10)
