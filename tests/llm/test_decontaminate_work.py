"""What decontamination does before it decides on candidates: words, the sketch, and which candidates it decides on at all."""

import random

import numpy as np
import pytest

from wayline.llm import decontaminate


def test_words_are_those_of_the_pattern():
    rng = random.Random(4)
    odd = "aZ_09 .'-\t\n\x00\x1c\x85\xa0 ́̇“”—…¿«»ßẞİıΣςσéÉñ漢か٣²Ⅷ😀👍🏽‍﻿�"
    texts = ["", " ", "İstanbul ΟΔΟΣ ὈΔΥΣΣΕΎΣ. Σ", "don't—stop “now”", "naïve café…x", "éa", odd]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(200)) for _ in range(20)]
    number = {w: i for i, w in enumerate(sorted({w for t in texts[::2] for w in decontaminate.WORD.findall(t.lower())}))}
    coded = {w.encode(): i for w, i in number.items()}
    for t in texts:
        ids = decontaminate.word_numbers(t, coded)
        assert ids.dtype == np.int32 and ids.tolist() == [number.get(w, -1) for w in decontaminate.WORD.findall(t.lower())]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 200])
def test_sketch_is_the_product(n):
    rng = np.random.default_rng(n)
    dense = rng.random((n, 90)) * (rng.random((n, 90)) < 0.1)
    dense[n // 3 : n // 2] = 0
    passage, term = np.nonzero(dense)
    test = rng.standard_normal((90, 7))
    weight = dense[passage, term]
    assert np.allclose(decontaminate.gram_times(passage, term, weight, n, test), dense.T @ (dense @ test))
    weight[term == 4] = dense[:, 4] = 0  # as of a common word
    assert np.allclose(decontaminate.gram_times(passage, term, weight, n, test), dense.T @ (dense @ test))


@pytest.mark.parametrize("columns", [None, 16])
def test_only_candidates_with_enough_words_are_decided(monkeypatch, columns):
    """All windows are near all parts here: those that share half of a part's words are decided, and the same is found as when all are."""
    if columns:  # words share columns, so that some with too few come through
        monkeypatch.setattr(decontaminate, "CELLS", 0, raising=False)
        monkeypatch.setattr(decontaminate, "COLUMNS", columns, raising=False)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = decontaminate.Items.of([(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 2, 5, 12, 20, 40, 64, 65, 150, 400])])
    n = len(items.number)
    terms = np.ones((n, 4), np.float32)
    latent = decontaminate.LatentItems(items, np.ones(n), terms, np.full((len(items.words), 4), 0.5, np.float32), [0, 4])
    docs = [[rng.randrange(-60, n) for _ in range(rng.choice([1, 11, 30, 200, 700]))] for _ in range(60)]
    for k, doc in enumerate(docs):
        own = rng.choice(items.whole)
        at = rng.randint(0, len(doc))
        doc[at:at] = [x if rng.random() > 0.2 else -1 for x in own] if k % 3 else []
    docs = [np.maximum(np.array(x), -1).astype(np.int32) for x in docs]
    decided = []
    check = decontaminate.LatentItems.check

    def counting(self, ids, low, high, start, size, part, *rest):
        own = self.items.words[part]
        margin = max(decontaminate.STRIDE, len(own) // 2)
        there = set(ids[max(low, start - margin) : min(high, start + size + margin)])
        decided.append(sum(w in there for w in own) >= decontaminate.LIKELY * len(own))
        check(self, ids, low, high, start, size, part, *rest)

    monkeypatch.setattr(decontaminate.LatentItems, "check", counting)
    found, calls = latent.found_in(docs), len(decided)
    if columns is None:
        runs = sum(len(latent.shared_runs(d)) for d in docs)
        assert decided.count(False) <= runs
    monkeypatch.setattr(decontaminate.LatentItems, "shared_words", lambda self, terms, again, a, b, part: np.full(len(part), 1 << 30))
    enough = sum(decided)
    decided.clear()
    assert latent.found_in(docs) == found and sum(map(len, found)) > 20
    assert sum(decided) == enough and calls < len(decided)
