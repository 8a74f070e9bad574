from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.llm import masked_lm as lm, queries, word_lm
from tests.llm import brute
from tests.llm.test_masked_lm import coded

FOLDER = "/root/testdata/sf0.001"


def by_hand(texts, model):
    """Sum of the log-probabilities of all words, from counts of words and pairs in dictionaries."""
    words = [[None, *brute.blank_words(t or ""), None] for t in texts]
    tokens = [[lm.EDGE, *x, lm.EDGE] for x in coded(texts, model.frequent)]
    single, pairs, kinds, size = Counter(), Counter(), {}, Counter()
    for w, t in zip(words, tokens, strict=True):
        for i in range(1, len(w) - 1):
            single[w[i]] += 1
            kinds.setdefault(t[i], set()).add(w[i])
            size[t[i]] += 1
        if len(w) > 2:
            single[None] += 1
            pairs.update(zip(w, w[1:], strict=False))
    unseen = 1 / (len(single) - 1 + 2)
    out = []
    for w, t in zip(words, tokens, strict=True):
        total = 0.0
        for i in range(1, len(w) - 1):
            total += float(model.table[t[i - 1], t[i + 1], t[i]]) / 3
            if t[i] <= lm.SHAPES:
                total += log((single[w[i]] - 1 + 1 / (len(kinds[t[i]]) + 1)) / size[t[i]]) / 3
            total += log((pairs[w[i - 1], w[i]] - 1 + unseen) / single[w[i - 1]]) / 3
            total += log((pairs[w[i], w[i + 1]] - 1 + unseen) / single[w[i + 1]]) / 3
        out.append((len(w) - 2, total))
    return out


def scored(documents, how=lm.Fit(steps=20)):
    model = lm.train(documents, how=how)
    return model, {r["doc_id"]: r for r in word_lm.score(documents, model).collect()}


@pytest.mark.parametrize("small", [False, True])
def test_same_as_counting_by_hand(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(word_lm, "RANGE_WORDS", 5_000)
        monkeypatch.setattr(word_lm, "CHUNK_WORDS", 2_000)
        monkeypatch.setattr(word_lm, "CHUNK_TEXTS", 7)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "one"), (-5, "one"), (-6, "the the the")], "doc_id long, text string")
    documents = documents.unionByName(odd).repartition(3).cache()
    model, found = scored(documents)
    rows = documents.collect()
    for row, (n, total) in zip(rows, by_hand([r["text"] for r in rows], model), strict=True):
        got = found[row["doc_id"]]
        assert got["n_tokens"] == n and got["log_prob"] == pytest.approx(total, rel=1e-4, abs=1e-3)
        assert got["mean_log_prob"] == (None if n == 0 else pytest.approx(got["log_prob"] / n))
    assert word_lm.score(documents.limit(0), model).count() == 0


def test_words_of_the_same_shape_are_told_apart(spark):
    rng = np.random.default_rng(3)
    made = lambda n: ["".join(rng.choice(list("bcdfgklmnprstvz"), 5)) for _ in range(n)]
    frequent = [f"f{i}" for i in range(90)]
    known = made(60)
    sentences = [rng.choice(known, 6).tolist() for _ in range(40)]
    rows = [(i, " ".join(sentences[i % 40] + [frequent[(i + j) % 90] for j in range(8)])) for i in range(4000)]
    strange = [(10_000 + i, " ".join(made(6) + [frequent[(i + j) % 90] for j in range(8)])) for i in range(100)]
    _, found = scored(spark.createDataFrame(rows + strange, "doc_id long, text string").repartition(4))
    plain = [found[i]["mean_log_prob"] for i, _ in rows]
    assert max(found[i]["mean_log_prob"] for i, _ in strange) < min(plain)


def test_the_query_scores_by_words(spark):
    """Every distinct word counts: tokens are only a part of the score."""
    model = lm.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), how=lm.Fit(steps=5))
    assert model.words.sizes.sum() > 1000 and model.words.words == model.words.totals.sum() + model.before[:, 1 + lm.SHAPES :].sum()
    level = lm.score(spark.read.parquet(f"{FOLDER}/documents.parquet"), lm.train(spark.read.parquet(f"{FOLDER}/documents.parquet")))
    level = level.select("doc_id", (F.col("log_prob") / 3).alias("log_prob")).toPandas()
    got = queries.QUERIES["op2_masked_scores"](spark, FOLDER).toPandas().merge(level, on="doc_id", suffixes=("", "_level"))
    long = got[got["n_tokens"] > 20]
    assert len(long) > 100 and (long["log_prob"] < long["log_prob_level"] - 0.5 * long["n_tokens"]).mean() > 0.8


def test_many_keys_are_counted_alike():
    key = np.random.default_rng(1).integers(0, 1 << 40, 1000, dtype=np.uint64)
    key = np.concatenate([key, key[:300], key[:10]])
    seen = Counter(key.tolist())
    assert word_lm._others(key.copy()).tolist() == [seen[k] - 1 for k in key.tolist()]
    assert sorted(np.unique(word_lm._others(np.zeros(1 << 24, np.uint64)))) == [(1 << 24) - 1]
