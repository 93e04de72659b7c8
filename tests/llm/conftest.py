"""Documents with every awkward case, and with columns that bear the operators' own names."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, ids binary, row bigint, piece int, fingerprint string, spans string, sketch string, key string, rank int, item_id bigint"
PASSAGE = "the committee compared seventeen harbour cranes before it chose the oldest of them for the new museum beside the river gate and paid nothing"


def sentence(rng: random.Random, n: int) -> str:
    words = "harbour stone river quiet lamp paper garden winter copper signal machine orchard simple yellow distance letter window carry between".split()
    return " ".join(rng.choice(words) + (rng.choice(["", "", ",", "."])) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    long = sentence(rng, 9000) + " naïve café 漢字かな " + "x" * 70_000 + " don't we'll " + sentence(rng, 4000)
    plain = [sentence(rng, rng.randint(5, 120)) for _ in range(60)]
    texts = [*plain, *plain[:6], plain[7] + " lamp", None, "", "   ", "a", "Ünïcödé ẞ ﬁ — “q” 😀👍🏽", long, plain[0].upper(), f"{plain[3]} {PASSAGE} {plain[4]}",
             "password: hunter2hunter2 and AKIA" + "B3" * 10 + " or 0123456789abcdef0123456789abcdef", "<|endoftext|> it's <|endoftext|>", "1 22 333\n\n\t'll 's"]
    out = [(i * 3 + 1, t, "en", "s", len(t or ""), 0.5, b"x", 1, 2, "f", "p", "k", "y", 4, 5) for i, t in enumerate(texts)]
    return [*out, out[2], (None, "no id but words enough to count as one text", None, None, None, None, None, None, None, None, None, None, None, None, None), (None, sentence(rng, 14000), None, None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs(rows):
    """(doc_id, text), null as the empty text."""
    return [(r[0], r[1] or "") for r in rows]
