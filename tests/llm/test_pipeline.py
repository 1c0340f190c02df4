"""The pipeline's stages against plain versions, each on its own input."""

from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline as pipeline
from pricewright.session import written
from pricewright.sources.tables import load
from test_dedup import plain_components, plain_lines
from test_rest import MODEL, plain_measures, words


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = load(spark, sf_dir, "documents"), {}
    for name, stage in pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir), "stage")
        out[name] = (docs, after)
        docs = after
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    assert list(stages) == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    for name in list(stages)[:-1]:
        assert stages[name][1].dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
        assert stages[name][1].where("n_chars <> char_length(text)").isEmpty()


def test_quality(spark, sf_dir, stages):
    before, after = stages["quality rules"]
    kept = {d for d, _ in pairs(after)}
    good = {r[0] for r in load(spark, sf_dir, "labels").where("quality = 1").collect()}
    for doc, text in pairs(before):
        m = plain_measures(text)
        if m[0] < 50 or 100 * m[4] > 50 * m[0]:
            assert doc not in kept
        elif doc in good:
            assert doc in kept


def test_lines_of_the_stage(stages):
    before, after = stages["line dedup"]
    assert Counter(pairs(after)) == Counter({(d, t): n for (d, _, _, t), n in plain_lines(pairs(before)).items()})


def test_one_of_each_group(stages):
    before, after = stages["n-gram Jaccard join"]
    want, groups = plain_components(pairs(before), 5, 80)
    assert after.count() == groups
    assert {d for d, _ in pairs(after)} == {c for _, _, c in want}


def test_mixture(stages):
    before, after = stages["mixing sources to target weights"]
    sizes = {d: len(words(t)) for d, t in pairs(before)}
    taken = Counter()
    for d, t in pairs(after):
        taken[d] += len(words(t))
    assert all(n <= 2 * sizes[d] for d, n in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)


def test_pieces(stages):
    before, after = stages["SentencePiece encoding and decoding"]
    assert Counter(pairs(after)) == Counter(pairs(before))
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in after.collect():
        assert r["n_tokens"] == len(model.encode(r["text"])) + 2 and r["decoded"] == model.decode(model.encode(r["text"]))


def test_run(spark, sf_dir, stages):
    assert Counter(pairs(pipeline.run(spark, sf_dir))) == Counter(pairs(stages["SentencePiece encoding and decoding"][1]))


def test_no_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    assert docs.count() == 0
