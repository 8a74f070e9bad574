import random

import numpy as np
import pyarrow as pa
import pytest

from encore.llm import mil

random.seed(9)
CLEAN = [f"word{i}" for i in range(60)]
BAD = ["vile", "rotten", "nasty"]


def text(toxic, n=8):
    lines = [" ".join(random.choice(CLEAN) for _ in range(7)) for _ in range(n)]
    if toxic:
        place = random.randrange(n)
        lines[place] = f"{lines[place]} {random.choice(BAD)}"
    return ". ".join(lines) + "."


ROWS = [(i, text(i % 5 == 0, random.choice([2, 8, 40])), int(i % 5 == 0)) for i in range(900)]


@pytest.fixture(scope="module")
def model():
    return mil.fit(pa.array([t for _, t, _ in ROWS[:700]]), np.array([y for *_, y in ROWS[:700]]))


def test_held_out_documents_are_told_apart(model):
    score = mil.Scorer(model).scores(pa.array([t for _, t, _ in ROWS[700:]]))
    assert ((score >= 0.5) == np.array([y for *_, y in ROWS[700:]], bool)).mean() > 0.98


def test_the_offending_sentence_is_found(model):
    whole = "word1 word2 word3. Word4 vile Word5! word6 word7"
    score, n, spans = mil.Scorer(model)(pa.array([whole, "", None, "...", whole.replace("vile", "fine")]))
    assert n.tolist() == [3, 0, 0, 0, 3] and score[1] == score[2] == score[3] == 0
    assert [whole[s["start"] : s["end"]] for s in spans[0]] == ["Word4 vile Word5"]
    assert spans[1:] == [[], [], [], []] and score[4] < 0.5


def test_noisy_or_of_the_sentences(model):
    scorer = mil.Scorer(model)
    parts = ["word1 vile.", "word2 word3.", "nasty word9."]
    single = [scorer.scores(pa.array([p]))[0] for p in parts]
    assert scorer.scores(pa.array([" ".join(parts)]))[0] == pytest.approx(1 - np.prod([1 - p for p in single]))


def test_tables(spark):
    documents = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in ROWS] + [(None, "vile", 0.1, "y"), (9999, None, 0.1, "z")], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in ROWS] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = mil.train(documents, labels)
    found = {r["doc_id"]: r for r in mil.toxicity(documents, model).collect()}
    assert len(found) == len(ROWS) + 2 and found[9999]["score"] == 0 and found[None]["held_out"] is False
    assert np.mean([found[i]["predicted"] == y for i, _, y in ROWS if found[i]["held_out"]]) > 0.97
    kept = mil.drop_toxic(documents, model)
    assert kept.columns == documents.columns and kept.filter("doc_id = 9999").count() == 1
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["score"] < 0.5}
    assert mil.toxicity(documents.limit(0), model).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 1), (2, 1)]])
def test_without_both_labels_nothing_is_toxic(spark, rows):
    documents = spark.createDataFrame([(i, "vile words") for i in range(4)], "doc_id long, text string")
    model = mil.train(documents, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert mil.toxicity(documents, model).filter("predicted = 1").count() == 0


def test_the_sample_is_bounded(spark):
    documents = spark.createDataFrame([(i, t) for i, t, _ in ROWS], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in ROWS], "doc_id long, toxic int")
    from encore.llm.labelled import fit_rows

    assert fit_rows(documents, labels, "toxic", "doc_id", "text", 50, 10**9).count() == 50
    some = fit_rows(documents, labels, "toxic", "doc_id", "text", 50, 5000).collect()
    assert 0 < sum(len(r["text"]) for r in some) <= 5000


def test_length_alone_is_not_toxic(model):
    scorer = mil.Scorer(model)
    plain = "\n".join(["neutral unheard sentence"] * 100_000)
    assert scorer(pa.array([plain]))[1] == [100_000] and scorer.scores(pa.array([plain]))[0] == 0
    clean = ". ".join(text(False) for _ in range(12_500))
    assert scorer.scores(pa.array([clean]))[0] < 0.5 <= scorer.scores(pa.array([f"{clean} vile"]))[0]


def test_harmless_uses_of_model_words_do_not_add_up(model):
    weak = mil.Scorer(mil.Model(model.keys, np.full(len(model.keys), 0.5), -6.0))
    assert weak.scores(pa.array(["\n".join(["word1 vile rotten nasty"] * 100_000)]))[0] < 0.5


def test_long_texts_do_not_end_the_sample(spark):
    from encore.llm.labelled import fit_rows

    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    for long in (range(0, 60, 3), range(60)):
        documents = spark.createDataFrame([(i, "x" * (20_000 if i in long else 50)) for i in range(60)], "doc_id long, text string")
        if len(long) == 60:
            with pytest.raises(ValueError):
                fit_rows(documents, labels, "toxic", "doc_id", "text", 60, 10_000)
        else:
            some = fit_rows(documents, labels, "toxic", "doc_id", "text", 60, 10_000).collect()
            assert len(some) > 20 and max(len(r["text"]) for r in some) == 50
