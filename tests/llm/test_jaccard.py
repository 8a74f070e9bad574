import random

import numpy as np
import pytest

from encore.llm import jaccard
from encore.llm.components import components
from tests.llm import brute

random.seed(8)
WORDS = [f"w{i}" for i in range(3000)]


def prose(n):
    return [random.choice(WORDS) for _ in range(n)]


def edited(words, n):
    out = list(words)
    for _ in range(n):
        out[random.randrange(len(out))] = random.choice(WORDS)
    return out


def corpus():
    texts = [None, "", " \n", "one", "One", "one two three", "ONE two\tthree", "a b c d e", "a b c d e f"]
    for _ in range(4):
        base = prose(random.choice([40, 150, 400]))
        texts += [" ".join(base)] * 3 + [" ".join(edited(base, k)) for k in (1, 1, 2, 3, 4, 8)]
    chain = prose(120)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(chain, 2)
    shared = prose(50)
    texts += [" ".join(prose(6) + shared + prose(6)) for _ in range(25)]
    texts += [" ".join(prose(3) + shared + prose(2)) for _ in range(10)]
    texts += [" ".join(prose(random.randint(1, 90))) for _ in range(40)]
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize("percent", [80, 60])
def test_components_match_all_pairs(spark, percent):
    texts = {i * 3: t for i, t in enumerate(corpus())}
    table = spark.createDataFrame([(i, t, 7, "x") for i, t in texts.items()], "doc_id long, text string, id int, key string")
    found = {r["doc_id"]: r for r in jaccard.near_duplicates(table, rule=jaccard.Rule(percent=percent)).collect()}
    sizes, roots = brute.near_components(texts, percent)
    assert {i: r["n_shingles"] for i, r in found.items()} == sizes
    assert {i: r["component_id"] for i, r in found.items()} == roots


def test_text_ids_repeated_ids_and_nulls(spark):
    base, other = " ".join(prose(60)), " ".join(prose(60))
    rows = [("b", base), ("c", base), ("b", base), (None, base), ("d", other), ("a", other), ("c", other), ("e", None)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", None: None}


def test_one_of_each_group_stays(spark):
    base = prose(80)
    rows = [(3, " ".join(base)), (1, " ".join(base)), (2, " ".join(edited(base, 1))), (4, "else"), (5, None), (6, ""), (1, " ".join(base)), (None, "x"), (7, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7]


def test_rows_with_one_id_and_different_texts_stay(spark):
    river, engine = prose(80), prose(80)
    rows = [
        (1, " ".join(river), "a"), (1, " ".join(engine), "b"), (2, " ".join(edited(engine, 1)), "c"), (1, " ".join(river), "d"), (3, " ".join(edited(river, 1)), "e"),
        (1, None, "f"), (1, "\t", "g"), (None, " ".join(river), "h"), (4, "other words here", "i"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, key string")
    for parts in (1, 4):
        kept = jaccard.keep_one(table.repartition(parts))
        assert kept.columns == table.columns
        names = sorted(r["key"] for r in kept.collect())
        assert "".join(names) in ("abfghi", "bdfghi")
    assert len({tuple(sorted(r["key"] for r in jaccard.keep_one(table.repartition(n)).collect())) for n in (1, 3, 5)}) == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(blank).collect()} == {1: 1, 2: 2}


def test_sketch_counts_all_sets(spark):
    texts = corpus()
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counts = jaccard.sketch(jaccard.profiles(table, "id", "text", 5))
    assert counts.sum() == sum(len(brute.shingles(t)) for t in texts)


def test_overlap_bound_never_understates():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(0, 120)).astype(np.uint64)) for _ in range(2))
        assert jaccard.overlap_bound(a, b) >= len(np.intersect1d(a, b))


def test_components_match_union_find(spark):
    links = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(900, i) for i in range(901, 960)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = brute.roots({x for a, b in links if a != b for x in (a, b)}, [x for x in links if x[0] != x[1]])
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
