import numpy as np
import pyarrow as pa
import pytest

from encore.llm import votes

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def space(spark):
    return votes.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))


def test_votes_are_those_of_the_exact_nearest(space):
    texts = ["the and of that " * 30, "all CAPS!! TEXT!! " * 20, "word*** word$$$ word%%% " * 9]
    voter = votes.Voter(space)
    got = voter(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        (counts,) = votes._counted(pa.array([text]))
        place = votes._unit(votes._weighted(counts, space.weights) @ space.projection)[0]
        near = space.vectors @ place
        best = np.argsort(-near)[: space.neighbours]
        pull = np.maximum(near[best], 0).astype(float) ** space.power
        assert score == pytest.approx((pull * space.labels[best]).sum() / pull.sum(), abs=1e-4)


def test_held_out_labels_are_predicted(spark, space):
    found = votes.quality(spark.read.parquet(f"{FOLDER}/documents.parquet"), space)
    rows = found.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4


def test_odd_texts_get_the_base_rate(space):
    got = votes.Voter(space)(pa.array([None, "", "a"]))
    assert got.tolist() == pytest.approx([float(space.labels.mean())] * 3)
    assert votes.Voter(space)(pa.array([], pa.string())).tolist() == []


def test_weights_count_every_document(spark):
    texts = ["abc", "abcd", None, "", "zzzz zz zz"] * 3
    got = votes.bucket_weights(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    (counts,) = votes._counted(pa.array(texts))
    expected = np.log((len(texts) + 1) / ((counts > 0).sum(0) + 1)) + 0.1
    expected[votes.TRIGRAMS :] *= votes.EMPHASIS
    assert np.allclose(got, expected, atol=1e-5)


def test_no_labels(spark):
    documents = spark.createDataFrame([(1, "some words", 0.9), (None, None, 0.1)], "doc_id long, text string, score double")
    nothing = votes.train(documents, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in votes.quality(documents, nothing).collect()] == [0.5, 0.5]
    assert votes.keep_good(documents, nothing).count() == 2
    assert votes.quality(documents.limit(0), nothing).count() == 0


def test_directions_are_the_leading_ones():
    rows = np.random.default_rng(1).standard_normal((60, 40)).astype(np.float32)
    rows[:, 0] *= 50
    first = votes.singular_directions(rows, 4)
    exact = np.linalg.svd(rows, full_matrices=False)[2][0]
    assert first.shape == (40, 4) and abs(first[:, 0] @ exact) > 0.999
