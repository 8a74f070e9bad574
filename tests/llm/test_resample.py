import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from encore.llm import resample, scan
from tests.llm import brute

random.seed(11)


def prose(n, words="the of and river engine tree é ü 漢字 x9 Zed".split()):
    return random.choice([" ", ", ", " -- "]).join(random.choice(words) for _ in range(n))


def features(text):
    words = brute.alnum_words(text)
    return [" ".join(words[i : i + m]) for m in (1, 2, 3) for i in range(len(words) - m + 1)]


def expected(docs, target, percent=5, buckets=resample.BUCKETS):
    def counts(texts):
        out = [0] * buckets
        for text in texts:
            for f in features(text):
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (big_s + buckets) / ((a + 1) * (big_t + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(brute.alnum_words(text))])
    able = sorted((r for r in rows if r[3] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return [tuple(r[:5]) for r in rows]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("long", [0, 1 << 21])
def test_every_ngram_has_its_own_crc(long):
    texts = [prose(random.randint(0, 300)) + "z" * random.randint(0, 2000) for _ in range(60)] + ["", None, " .", "one", "two words", "y" * long + " end " + "q" * 300]
    for first, data, offsets in scan.blocks(pa.array(texts)):
        found, grams = resample.ngram_crcs(data, offsets)
        mine = texts[first : first + len(offsets) - 1]
        for width, (_, crc) in enumerate(grams, 1):
            split = [brute.alnum_words(t) for t in mine]
            assert crc.tolist() == [zlib.crc32(" ".join(w[i : i + width]).encode()) for w in split for i in range(len(w) - width + 1)]


def test_shift_equals_zero_bytes():
    state = np.arange(1, 6, dtype=np.uint32) * np.uint32(0x9E3779B9)
    lengths = np.array([0, 1, 255, 256, 70_001])
    for s, n, got in zip(state.tolist(), lengths.tolist(), resample.shift(state, lengths).tolist(), strict=True):
        register = np.array([s], np.uint32)
        for _ in range(n):
            register = resample._step(register)
        assert int(register[0]) == got


def test_scores_and_draws(spark):
    docs = [(i, prose(random.randint(0, 60))) for i in range(300)] + [(None, prose(30)), (900, None), (901, ""), (7, prose(50)), (5, docs_text := prose(40)), (5, docs_text)]
    target = [prose(20, ["river", "tree", "zed"]) for _ in range(5)] + [None, ""]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, weight string, n_words int").repartition(5)
    found = resample.resample(table, spark.createDataFrame([(t,) for t in target], "text string"))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(tuple(r) for r in found.collect()) == order(expected(docs, target))


def test_draw_keeps_columns(spark):
    docs = [(i, prose(30), "x") for i in range(100)]
    table = spark.createDataFrame(docs, "doc_id long, text string, rank string")
    drawn = resample.draw(table, spark.createDataFrame([("river tree",)], "text string"), percent=20)
    assert drawn.columns == table.columns and drawn.count() == 20
    best = {r[0] for r in expected([d[:2] for d in docs], ["river tree"], 20) if r[4] is not None}
    assert {r["doc_id"] for r in drawn.collect()} == best


def test_ties_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, prose(40))] * 40, "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    found = resample.resample(some, none).collect()
    assert sorted(r["rank"] for r in found if r["rank"] is not None) == [1, 2]
    assert len({r["score"] for r in found}) == 1
