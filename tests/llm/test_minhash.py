import random

import numpy as np
import pytest

from encore.llm import minhash
from tests.llm import brute
from tests.llm.test_jaccard import corpus, edited, prose

INDEX = minhash.Index()


def signed(sets):
    ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return minhash.signatures(np.concatenate(sets), ptr, INDEX)


def test_distance_follows_similarity():
    rng = np.random.default_rng(5)
    apart = []
    for _ in range(400):
        shared, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (340, 30, 30))
        a, b = signed([np.concatenate([shared, left]), np.concatenate([shared, right])])
        apart.append(int((a != b).sum()))
    # Similarity 0.85: each of 96 positions differs with probability 0.15.
    assert abs(np.mean(apart) - 14.4) < 0.8 and 2.7 < np.std(apart) < 4.3
    assert max(apart) <= INDEX.distance


def test_every_pair_within_the_distance_meets():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**16, INDEX.positions).astype(np.uint16)
    mine = set(minhash.chunk_keys(base[None], INDEX)[0].tolist())
    for _ in range(500):
        other = base.copy()
        at = rng.choice(INDEX.positions, INDEX.distance, replace=False)
        other[at] ^= rng.integers(1, 2**16, len(at)).astype(np.uint16)
        assert mine & set(minhash.chunk_keys(other[None], INDEX)[0].tolist())
    far = rng.integers(0, 2**16, INDEX.positions).astype(np.uint16)
    assert not mine & set(minhash.chunk_keys(far[None], INDEX)[0].tolist())
    worst = base.copy()
    worst[np.arange(0, INDEX.positions, 3)] ^= np.uint16(1)
    assert not mine & set(minhash.chunk_keys(worst[None], INDEX)[0].tolist())


@pytest.mark.parametrize("percent", [85, 95])
def test_components_match_all_pairs(spark, percent):
    texts = {i * 3: t for i, t in enumerate(corpus())}
    table = spark.createDataFrame([(i, t, 7, "x") for i, t in texts.items()], "doc_id long, text string, id int, key string")
    found = {r["doc_id"]: r for r in minhash.near_duplicates(table, index=minhash.Index(percent=percent)).collect()}
    sizes, roots = brute.near_components(texts, percent)
    assert {i: r["n_shingles"] for i, r in found.items()} == sizes
    assert {i: r["component_id"] for i, r in found.items()} == roots
    assert all(r["kept"] == (i == roots[i]) for i, r in found.items())


def test_copies_around_a_late_centre(spark):
    """Copies link with their origin but not with one another, and the origin has the greatest id."""
    base = prose(110)
    texts = {i: " ".join(base[:k] + [f"new{i}"] + base[k + 1 :]) for i, k in enumerate(range(5, 105, 5))}
    texts |= {i + 20: " ".join(base[:k] + [f"new{i}", f"more{i}"] + base[k + 2 :]) for i, k in enumerate(range(7, 100, 10))}
    texts[500] = " ".join(base)
    found = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute.near_components(texts, 85)[1]


def test_text_ids_repeated_ids_and_nulls(spark):
    base, other = " ".join(prose(60)), " ".join(prose(60))
    rows = [("b", base), ("c", base), ("b", base), (None, base), ("d", other), ("a", other), ("c", other), ("e", None), ("f", " ")]
    found = minhash.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "lead string, text string, key int"), "lead").collect()
    assert len(found) == len(rows)
    assert {r["lead"]: r["component_id"] for r in found} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f", None: None}
    assert all(r["kept"] == (r["lead"] in ("a", "e", "f", None)) for r in found)


def test_empty_tables_and_short_sets(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    six, seven = "a b c d e f g h i j", "a b c d e f g h i j k"
    table = spark.createDataFrame([(1, "one two"), (2, "one TWO"), (3, six), (4, seven), (5, "w " * 200_000)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (6, 3), 4: (7, 3), 5: (1, 5)}
