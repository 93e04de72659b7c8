"""Secrets and benchmark passages against brute force."""

import re
from collections import Counter

from tests.llm.conftest import PASSAGE
from wayline.llm import decontaminate, secrets


def test_spans(docs, pairs):
    want = Counter()
    for d, t in pairs:
        spans = sorted((m.start(), k, m.end(), r.kind) for k, r in enumerate(secrets.RULES) for m in r.regex.finditer(t) if len(m[r.group]) >= r.least)
        want[d, tuple((kind, a, b) for a, _, b, kind in spans)] += 1
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in secrets.scan(docs).collect()) == want
    assert sum(n for (_, spans), n in want.items() if spans) == 1


def test_queries_of_the_rules():
    asked = {r.kind: secrets.trigram_query(r) for r in secrets.RULES}
    assert asked["hex"] is None  # it scans every text
    assert [frozenset({b"aki", b"kia"})] in asked["access"]
    assert len(asked["assign"][0]) == 18  # six words (api_key may lack its sign), bare or with either quote


def test_redacted(docs, rows, empty):
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and secrets.redact(empty).count() == 0
    found = {r.doc_id: r for r in clean.collect()}
    hit = next(r for r in rows if r[1] and r[1].startswith("password"))
    assert found[hit[0]].text == "[SECRET] and [SECRET] or [SECRET]" and found[hit[0]].n_chars == 33
    assert sum(r.text is None for r in found.values()) == 1


def test_benchmark_passages(spark, docs, rows, empty):
    words = PASSAGE.split()
    paraphrase = " ".join(w for i, w in enumerate(words) if i % 9 != 4)
    items = spark.createDataFrame([(1, PASSAGE), (2, "entirely different question about glaciers moving slowly through alpine valleys every single summer"), (3, None), (4, ""), (1, PASSAGE), (None, "x y")], "item_id bigint, text string")
    more = docs.unionByName(docs.limit(1).selectExpr("900 as doc_id", f"'{paraphrase}' as text", *docs.columns[2:]))
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(more, items).collect()}
    holder = next(r[0] for r in rows if r[1] and PASSAGE in r[1])
    assert found == {(holder, 1), (900, 1)}
    kept = decontaminate.clean(more, items)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    a, b = [1, 2, 3, 2, 5, 1, 7, 3], [2, 9, 3, 5, 5, 1, 3, 3, 2]
    assert decontaminate.common_length(decontaminate.places(a), len(a), b) == plain(a, b)
    assert re.findall(r"\w+", "it's") == decontaminate.WORD.findall("it's")
