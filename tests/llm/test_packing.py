import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from encore.llm import packing
from encore.llm.tokens import default_path

random.seed(6)
TEXTS = [None, "", "short text", "word " * 3000, "é日本 " * 40, *(" ".join(random.choice(["ab", "cde", "fghi"]) for _ in range(random.randint(1, 900))) for _ in range(150))]


@pytest.fixture(scope="module")
def packed(spark):
    table = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length int, group string")
    return packing.pack(table, group=60, with_ids=True).collect()


def test_pieces_are_the_documents(packed):
    plain = Tokenizer.from_file(default_path())
    by_document = {}
    for r in packed:
        by_document.setdefault(r["doc_id"], []).append(r)
    assert set(by_document) == set(range(len(TEXTS)))
    for i, rows in by_document.items():
        rows.sort(key=lambda r: r["piece"])
        ids = np.array([*plain.encode(TEXTS[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(bytes(r["ids"]) for r in rows) == ids.tobytes()
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        at = 0
        for r in rows:
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(bytes(r["ids"])))
            at += r["length"]
        assert all(r["length"] == packing.CAPACITY for r in rows[1:]) and len(rows) == -(-len(ids) // packing.CAPACITY)


def test_sequences_are_gapless_and_full(packed):
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rows in sequences.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == list(np.cumsum([0] + [r["length"] for r in rows[:-1]]))
        assert sum(r["length"] for r in rows) <= packing.CAPACITY
    least = -(-sum(r["length"] for r in packed) // packing.CAPACITY)
    assert len(sequences) <= least + 5


@pytest.mark.parametrize("seed", range(8))
def test_local_search_raises_squared_fill_and_saves_sequences(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(20, 60) for _ in range(120)]
    bins = packing.Bins(sizes, 100)
    bins.best_fit()
    before, squares = bins.used(), sum((100 - f) ** 2 for f in bins.free)
    bins.improve()
    assert sorted(i for c in bins.content for i in c) == list(range(len(sizes)))
    for c, free in zip(bins.content, bins.free, strict=True):
        assert 0 <= free == 100 - sum(sizes[i] for i in c)
    assert bins.used() <= before and sum((100 - f) ** 2 for f in bins.free) >= squares


def test_an_exchange_can_empty_a_sequence():
    bins = packing.Bins([], 10)
    bins.sizes = [6, 3, 5, 4, 2]
    bins.content, bins.free = [[0, 1], [2, 3], [4]], [1, 1, 8]
    bins.improve()
    assert bins.used() == 2


def test_empty_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = packing.pack(spark.createDataFrame([(1, "same")] * 5, "doc_id long, text string")).collect()
    assert len(same) == 5 and len({(r["sequence_id"], r["offset"]) for r in same}) == 5


def test_special_tokens_keep_the_ids_of_the_library(spark):
    plain = Tokenizer.from_file(default_path())
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a.<|endoftext|>b  c\n<|endoftext|>\n d", "x y"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: bytes(r["ids"]) for r in packing.pack(table, with_ids=True).collect()}
    assert found == {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in enumerate(texts)}


class Plain(packing.Bins):
    """The same search step by step over all bundles and homes."""

    def improve(self):
        stuck = set()
        while self.used() > self.least():
            under = sorted((h for h, c in enumerate(self.content) if c and self.free[h]), key=lambda h: -self.free[h])
            donor = next((h for h in under if h not in stuck), None)
            if donor is None:
                return
            mine = sorted(self.content[donor], key=lambda i: -self.sizes[i])
            best = (0, None)
            for home in (h for h in under if self.free[h] <= self.free[donor] and h != donor):
                for bundle in [[i] for i in mine] + [[i, j] for n, i in enumerate(mine) for j in mine[n + 1 :]]:
                    for other in [None, *self.content[home]] if len(bundle) == 1 else self.content[home]:
                        gain = sum(self.sizes[i] for i in bundle) - (0 if other is None else self.sizes[other])
                        if best[0] < gain <= self.free[home]:
                            best = (gain, (bundle, home, [] if other is None else [other]))
                if best[0] == self.free[home]:
                    break
            if best[0]:
                self._give(donor, *best[1])
                stuck.clear()
            else:
                stuck.add(donor)


@pytest.mark.parametrize("low,high,capacity", [(300, 900, 2048), (20, 60, 100), (100, 1200, 2048), (1, 2048, 2048)])
def test_search_misses_nothing_that_plain_search_finds(low, high, capacity):
    for seed in range(30):
        rng = random.Random(seed)
        sizes = [rng.randint(low, high) for _ in range(rng.randint(90, 120))]
        plain, bins = Plain(sizes, capacity), packing.Bins(sizes, capacity)
        for x in (plain, bins):
            x.best_fit()
            x.improve()
        assert bins.used() <= plain.used()


def test_optimum_of_few_pieces():
    def optimum(sizes, capacity):
        """Fewest sequences and greatest last room, over all subsets."""
        best = {0: (0, 0)}
        for mask in range(1, 1 << len(sizes)):
            options = []
            for i, s in enumerate(sizes):
                if mask >> i & 1:
                    used, room = best[mask ^ 1 << i]
                    options.append((used, -(room - s)) if room >= s else (used + 1, -(capacity - s)))
            used, room = min(options)
            best[mask] = (used, -room)
        return best[(1 << len(sizes)) - 1][0]

    rng = random.Random(1)
    missed = 0
    for _ in range(40):
        sizes = [rng.randint(10, 60) for _ in range(rng.randint(4, 12))]
        bins = packing.Bins(sizes, 100)
        bins.best_fit()
        bins.improve()
        missed += bins.used() - optimum(sizes, 100)
    assert missed <= 1


def test_any_name_of_the_id(spark):
    for name in ("row", "group", "_id"):
        table = spark.createDataFrame([(i, "some words", "x") for i in range(20)], f"{name} long, text string, other string")
        found = packing.pack(table, name)
        assert found.columns[0] == name and sorted(r[0] for r in found.collect()) == list(range(20))
