"""The pipeline's stages take effect, and leave clean documents alone."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import PASSAGE
from wayline.llm import likeness, secrets
from wayline.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = read(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append((docs.columns, docs.collect()))
    return out


def test_all_but_the_last_return_documents(spark, stages):
    columns = read(spark, SF, "documents").columns
    assert all(c == columns for c, _ in stages[:-1])


def test_quality_goes_by_the_score(spark, stages):
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in stages[0][1]}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.4 * len(bad)


def test_one_of_each_group_stays(stages):
    before = sorted(stages[0][1], key=lambda r: r.doc_id)
    sets = [set(likeness.runs(r.text or "").tolist()) for r in before]
    label = list(range(len(before)))

    def alike(i, j):
        return sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0

    links = [(i, j) for j in range(len(before)) for i in range(j) if alike(i, j)]
    for _ in before:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert sorted(r.doc_id for r in stages[1][1]) == [before[i].doc_id for i in sorted(set(label))]


def test_awkward_rows_go_through(spark, docs, rows, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names; and an empty table."""
    now = docs.withColumn("_quality", docs["score"])
    labels = tmp_path / "labels.parquet", spark.createDataFrame([(r[0], 1) for r in rows if r[0] is not None], "doc_id bigint, quality int")
    items = tmp_path / "benchmark.parquet", spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id bigint, text string")
    for at, df in (labels, items):
        df.write.parquet(str(at))
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == 4 or out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(now.count())
    # six copies, an upper-case one, one with a word more, the repeated row, and two of the three texts without words go
    assert sizes[0] == len(rows) and sizes[1] == len(rows) - 11 and sizes[2] == sizes[1] - 1 and sizes[3] == sizes[4] == sizes[2]
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing_left = stage(spark, nothing, str(tmp_path))
        assert nothing_left.count() == 0


def test_benchmark_items_are_gone(spark, stages):
    items = [r.text for r in read(spark, SF, "benchmark").collect()]
    before, after = stages[1][1], stages[2][1]
    kept = {r.doc_id for r in after}
    holds = {r.doc_id for r in before if any(i in r.text for i in items)}
    assert not kept & holds and len(before) - len(after) <= len(holds) + 2


def test_secrets_are_masked_and_ids_decode(stages):
    after = stages[3][1]
    assert not any(r.spans(x.text) for r in secrets.BASE[:2] for x in after if x.text)
    assert {x.doc_id for x in after} == {x.doc_id for x in stages[2][1]}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: r.n_tokens for r in stages[4][1]}
    assert ids == {x.doc_id: len(tok.encode(x.text or "", add_special_tokens=False).ids) for x in after}
