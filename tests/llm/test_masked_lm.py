from collections import Counter

import numpy as np
import pytest

from encore.llm import masked_lm as lm
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return lm.train(documents, how=lm.Fit(steps=80))


def coded(texts, frequent):
    import pyarrow as pa

    from encore.llm import scan

    tokens, out = lm.Tokens(frequent), []
    for _, data, offsets in scan.blocks(pa.array(texts, pa.string())):
        found, ptr = tokens(data, offsets)
        out += [found[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    return out


def test_frequent_words_are_those_of_the_whole_corpus(documents, model):
    seen = Counter(w for r in documents.collect() for w in brute.blank_words(r["text"]))
    number = lm.VOCABULARY - 1 - lm.SHAPES
    least = sorted(seen.values(), reverse=True)[number - 1]
    for word, n in seen.items():
        token = coded([word], model.frequent)[0][0]
        if n > least:
            assert token > lm.SHAPES
        if n < least:
            assert 1 <= token <= lm.SHAPES


def test_counts_cover_every_neighbourhood(documents, model):
    expected = Counter()
    texts = [r["text"] for r in documents.collect()]
    for tokens in coded(texts, model.frequent):
        padded = [lm.EDGE, *tokens, lm.EDGE]
        for a, t, b in zip(padded, padded[1:], padded[2:], strict=False):
            expected[(a * lm.VOCABULARY + b) * lm.VOCABULARY + t] += 1
    got = {r["code"]: r["n"] for r in lm.neighbour_counts(documents, "text", model.frequent).collect()}
    assert got == dict(expected)


def test_scores_sum_the_log_probabilities(spark, model):
    texts = ["the and of", "", None, "one", "the  and\nof THE 12 x%% é", "the and of"]
    table = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "doc_id long, text string, log_prob double")
    found = {r["doc_id"]: r for r in lm.score(table, model).collect()}
    for i, tokens in enumerate(coded(texts, model.frequent)):
        padded = [lm.EDGE, *tokens, lm.EDGE]
        total = sum(float(model.table[a, b, t]) for a, t, b in zip(padded, padded[1:], padded[2:], strict=False))
        assert found[i]["n_tokens"] == len(tokens) and found[i]["log_prob"] == pytest.approx(total, abs=1e-3)
        assert (found[i]["mean_log_prob"] is None) == (not tokens)
    assert lm.score(table.limit(0), model).count() == 0


def test_the_network_beats_frequencies(documents, model):
    rows = lm.neighbour_counts(documents, "text", model.frequent).toPandas()
    counts, codes = rows["n"].to_numpy(), rows["code"].to_numpy()
    single = np.bincount(codes % lm.VOCABULARY, weights=counts, minlength=lm.VOCABULARY) / counts.sum()
    plain = (counts * np.log(single[codes % lm.VOCABULARY])).sum() / counts.sum()
    assert (counts * model.table.reshape(-1)[codes]).sum() / counts.sum() > plain + 0.1
    assert np.allclose(np.exp(model.table).sum(2), 1, atol=1e-3)


def test_an_empty_corpus_gives_a_uniform_model(spark):
    model = lm.train(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert np.allclose(np.exp(model.table).sum(2), 1, atol=1e-3)
