"""The pipeline's stages, each against brute force over its own input."""


import pytest

import corpus_pipeline
from quire.llm import toxicity
from quire.llm.shared import save
from tests.llm.test_jaccard import brute as similar
from tests.llm.test_packing import check
from tests.llm.test_substring import brute as seen

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    """Input of each stage, and the last result."""
    tables = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(save(stage(spark, tables[-1], FOLDER), name))
    return tables


def test_stages_keep_the_columns(inputs):
    for table in inputs[1:-1]:
        assert table.dtypes == inputs[0].dtypes and table.count() > 0


def ids(table):
    return {r.doc_id for r in table.select("doc_id").collect()}


def test_toxicity_takes_what_the_model_predicts(spark, inputs):
    scored = toxicity.op2_toxicity(spark, FOLDER)
    assert ids(inputs[1]) == ids(scored.where("predicted = 0"))


def test_language_keeps_nearly_all(inputs):
    assert len(ids(inputs[1]) - ids(inputs[2])) <= 1 and ids(inputs[2]) <= ids(inputs[1])


def test_one_of_each_group_stays(inputs):
    want = similar([(r.doc_id, r.text) for r in inputs[2].collect()])
    assert ids(inputs[3]) == {d for d, (group, _) in want.items() if d == group}


def test_seen_passages_go(inputs):
    want = seen([(r.doc_id, r.text) for r in inputs[3].collect()], 50)
    before = {r.doc_id: r.text for r in inputs[3].collect()}
    for r in inputs[4].collect():
        _, removed, kept = want[r.doc_id]
        assert r.text == (kept if removed else before[r.doc_id])
        assert not removed or r.n_chars == len(kept)


def test_every_id_is_packed(inputs):
    from tokenizers import Tokenizer

    from quire.llm.bpe import default_vocabulary

    library = Tokenizer.from_file(default_vocabulary())
    lengths = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in inputs[4].collect()}
    check(inputs[5].collect(), lengths, 1024)


def test_run_gives_the_rows_of_the_stages(spark, inputs):
    got = corpus_pipeline.run(spark, FOLDER)
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, inputs[5].select(columns).collect()))
