"""The learned operators' arithmetic against slow, plain versions of it."""

import math
import random

import numpy as np

from wayline.llm import quality, toxicity


def texts(rng, n):
    words = ["One", "two", "thr33", "four!", "FIVE", "six", "seven-8", "nine", "ten.", "eleven"]
    return [" ".join(rng.choice(words[: 2 + k % 9]) for _ in range(rng.randint(1, 40))) for k in range(n)]


def test_votes():
    """Cosines with every voter, the nearest 25, labels weighed by the eighth power."""
    rng = random.Random(6)
    known, asked = texts(rng, 60), [*texts(rng, 40), "", "   "]
    counts = lambda t: (lambda x: (x[1].tolist(), x[2].tolist()))(quality.term_counts([t]))
    labels = [rng.randint(0, 1) for _ in known]
    voters = quality.Voters.fit([counts(t) for t in known], labels)
    found = voters.scores(asked)
    for text, score in zip(asked, found, strict=True):
        terms, n = counts(text)
        if not terms:
            assert abs(score - np.mean(labels)) < 1e-6
            continue
        own = sum(math.log1p(c) * voters.idf[t] * voters.axes[t].astype(float) for t, c in zip(terms, n, strict=True))
        own = own / max(math.sqrt((own**2).sum()), 1e-9)
        near = sorted(((float(own @ v), y) for v, y in zip(voters.vectors.astype(float), labels, strict=True)), reverse=True)
        best = [(max(c, 0.0) ** 8 + 1e-9, y) for c, y in near[: quality.NEIGHBOURS]]
        edge = near[quality.NEIGHBOURS - 1][0] - near[quality.NEIGHBOURS][0]
        if edge > 1e-5:  # else which of equal neighbours vote is open
            assert abs(score - sum(w * y for w, y in best) / sum(w for w, _ in best)) < 1e-4


def risk(w, bias, positive, unlabelled, prior):
    """prior x toxic risk of positives + max(0, clean risk of the unlabelled less the positives' part of it)."""
    clean = lambda z: math.log1p(math.exp(z))
    score = lambda x: bias + sum(w[f] for f in x)
    as_toxic = sum(clean(-score(x)) for x in positive) / len(positive)
    rest = sum(clean(score(x)) for x in unlabelled) / len(unlabelled) - prior * sum(clean(score(x)) for x in positive) / len(positive)
    return prior * as_toxic, rest


def lists(rows):
    return toxicity.Lists(np.array([f for x in rows for f in x], np.int64), np.array([len(x) for x in rows]))


def test_risk_is_that_of_positive_unlabelled_learning():
    """Training by numeric differences of the written risk ends at the same weights."""
    rng = random.Random(2)
    positive = [[f for f in range(6) if rng.random() < (0.8 if f < 3 else 0.3)] for _ in range(40)]
    unlabelled = [[f for f in range(6) if rng.random() < (0.25 if f < 3 else 0.3)] for _ in range(60)]
    prior = 0.2
    model = toxicity.train(lists(positive), lists(unlabelled), prior)
    seen = lambda rows, f: sum(f in x for x in rows)
    used = [f for f in range(6) if seen(positive, f) >= toxicity.LEAST and seen(positive, f) / 40 > toxicity.LIFT * seen(unlabelled, f) / 60]
    keep = lambda rows: [[used.index(f) for f in x if f in used] for x in rows]
    p, u = keep(positive), keep(unlabelled)
    w, bias = [0.0] * len(used), math.log(prior / (1 - prior))
    m1, m2 = [0.0] * (len(used) + 1), [0.0] * (len(used) + 1)
    for step in range(1, toxicity.STEPS + 1):

        def value(at, rest_now=risk(w, bias, p, u, prior)[1]):
            toxic, rest = risk(at[:-1], at[-1], p, u, prior)
            return toxic + rest if rest_now >= 0 else -rest

        now = [*w, bias]
        for k in range(len(now)):
            up, down = now.copy(), now.copy()
            up[k] += 1e-6
            down[k] -= 1e-6
            g = (value(up) - value(down)) / 2e-6 + (toxicity.DECAY if k < len(used) else 0)
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
        move = [toxicity.RATE * (a / (1 - 0.9**step)) / (math.sqrt(b / (1 - 0.999**step)) + 1e-8) for a, b in zip(m1, m2, strict=True)]
        w, bias = [max(x - y, 0) for x, y in zip(w, move[:-1], strict=True)], bias - move[-1]
    assert used and all(abs(model.weights.get(f, 0) - x) < 0.02 for f, x in zip(used, w, strict=True)) and abs(model.bias - bias) < 0.02


def test_of_equal_neighbours_the_first_vote():
    rng = np.random.default_rng(3)
    for n, k in ((40, 5), (25, 25), (400, 25)):
        near = rng.integers(0, 6, (50, n)).astype(np.float32) / 6
        best = quality.nearest(near, k)
        want = [sorted(range(n), key=lambda j: (-row[j], j))[:k] for row in near]
        assert [sorted(b) for b in best.tolist()] == [sorted(w) for w in want]


def test_copies_of_one_id_take_one_place_of_the_sample(spark, monkeypatch):
    rows = [(7, "vile trash scum")] * 300 + [(k, f"quiet river {k}") for k in range(8, 40)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(7, 1), (8, 0), (9, 0), (10, 0)], "doc_id bigint, toxic int")
    sizes = []
    monkeypatch.setattr(toxicity, "train", lambda positive, unlabelled, prior: sizes.append((len(positive.sizes), len(unlabelled.sizes), prior)))
    toxicity.fit(docs, labels, unlabelled=20)
    assert sizes == [(1, 20, 0.25)]
