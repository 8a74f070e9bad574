import heapq
import random
import zlib

import pytest

from encore.llm import shards

random.seed(4)


@pytest.mark.parametrize("k", [1, 3, 16])
def test_schedule_is_the_one_by_one_schedule(k):
    for _ in range(30):
        classes = sorted({random.randint(1, 500): random.choice([1, 2, 7, 300, 1000]) for _ in range(12)}.items(), reverse=True)
        heap, expected = [(0, i) for i in range(k)], []
        for size, count in classes:
            given = [0] * k
            for _ in range(count):
                x, i = heap[0]
                given[i] += 1
                heapq.heapreplace(heap, (x + size, i))
            expected.append(given)
        got = shards.schedule([(float(s), n) for s, n in classes], k)
        loads = lambda plan: sorted(sum(s * g[i] for (s, _), g in zip(classes, plan, strict=True)) for i in range(k))
        assert [sum(g) for g in got] == [n for _, n in classes]
        assert loads(got) == loads(expected)


@pytest.fixture(scope="module")
def rows():
    texts = ["x" * random.randint(0, 400) + str(i) for i in range(400)] + ["copy" * 20] * 300 + ["é" * 50, None, "", None, "big" * 3000]
    return [(i if i % 97 else None, t, i, "x") for i, t in enumerate(texts)]


@pytest.mark.parametrize("lane", [100_000, 40])
def test_laws(spark, rows, monkeypatch, lane):
    monkeypatch.setattr(shards, "LANE_ROWS", lane)
    table = spark.createDataFrame(rows, "doc_id long, text string, shard int, digest string")
    found = shards.assign_shards(table, shards=4).collect()
    assert len(found) == len(rows)
    by_id = {i: t or "" for i, t, *_ in rows if i is not None}
    slots, home, load = {}, {}, [0] * 4
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
        if r["doc_id"] is not None:
            text = by_id[r["doc_id"]]
            assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
            assert home.setdefault(text, r["shard"]) == r["shard"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load) - min(load) <= 81 * 300 + 9001
    assert sum(load) == sum(len((t or "").encode()) + 1 for _, t, *_ in rows)


def test_loads_are_near_equal_on_documents(spark):
    found = shards.assign_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    load = [r["bytes"] for r in shards.shard_loads(found).collect()]
    assert len(load) == shards.SHARDS and max(load) / min(load) < 1.05


def test_empty_and_repeated(spark):
    assert shards.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(1, "a")] * 20, "doc_id long, text string")
    assert sorted(r["slot"] for r in shards.assign_shards(same).collect()) == list(range(20))
