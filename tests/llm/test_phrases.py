import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from encore.llm import phrases
from tests.llm import brute

random.seed(13)
WORDS = "the of and The of the a in river engine-room tree é 漢字 x9".split()


def prose(n):
    return "".join(random.choice(WORDS) + random.choice([" "] * 9 + ["\t", ". ", ",", "\n"]) for _ in range(n))


def pieces(text):
    low = (text or "").translate(brute._LOWER)
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def expected(rows, least, top):
    count, out = defaultdict(Counter), []
    for lang, text in rows:
        for words in pieces(text):
            for m in range(1, 6):
                count[lang if lang is not None else "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for lang, f in count.items():
        n = sum(k for g, k in f.items() if len(g) == 1)
        often = {g: k for g, k in f.items() if len(g) > 1 and k >= least}
        gone = set()
        for g, k in often.items():
            for m in range(2, len(g)):
                gone |= {h for h in (g[i : i + m] for i in range(len(g) - m + 1)) if h in often and 100 * k >= 100 * often[h]}
        scored = []
        for g, a in often.items():
            if g not in gone:
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize("least,top", [(2, 2000), (5, 40), (30, 2000)])
def test_same_as_counting_everything(spark, least, top):
    rows = [(random.choice(["en", "fr", None]), prose(random.randint(0, 80))) for _ in range(150)]
    rows += [("en", "one fixed line of words here. " * 30), ("en", None), ("de", ""), (None, "a a a a a a a a " * 10), ("xx", "the of")]
    table = spark.createDataFrame([(x, t, 5, "z") for x, t in rows], "lang string, text string, f long, words string").repartition(3)
    found = phrases.phrases(table, mining=phrases.Mining(least=least, top=top))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, least, top)


def test_empty_tables(spark):
    assert phrases.phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.phrases(spark.createDataFrame([("en", None), (None, "rare words only")], "lang string, text string")).count() == 0


@pytest.mark.parametrize("known", [0, 4, 100])
def test_union_of_shards_counts_all_phrases(known):
    rng = np.random.default_rng(known)
    names = np.sort(rng.integers(1, 2**63, 12).astype(np.uint64))
    packer, ranges, least = phrases.Packer(names[:known]), 3, 4
    parts, count = defaultdict(list), Counter()
    for _ in range(20):
        keys, joined = names[rng.integers(0, 12, 300) * rng.integers(0, 2, 300)], rng.random(299) < 0.8
        for low in range(0, 300, 70):
            high = min(300, low + 70)
            reach = min(300, high + 4)
            for part, blob in phrases.shard_automata(keys[low:reach], joined[low : reach - 1], high - low, ranges, packer):
                parts[part].append(packer.unpack(blob))
        for i in range(300):
            for m in range(2, 6):
                if i + m <= 300 and joined[i : i + m - 1].all():
                    count[tuple(keys[i : i + m].tolist())] += 1
    often = {g: k for g, k in count.items() if k >= least}
    got, merged = {}, {p: packer.unpack(packer.whole(phrases.union(found, least))) for p, found in parts.items()}
    for part, found in merged.items():
        for m in [2] if part % 2 == 0 else [3, 4, 5]:
            for path, weight in zip(found.paths(m).tolist(), found.weight[m - 1].tolist(), strict=True):
                got[tuple(path)] = weight
    assert got == often
    for g, k in often.items():
        row = np.array([g], np.uint64)
        assert merged[int(phrases.route(row, ranges)[0])].run(row)[0] == k
    strange = np.array([[5, 6, 7]], np.uint64)
    assert all(found.run(strange)[0] == 0 for p, found in merged.items() if p % 2)


def test_scores_beyond_64_bits(spark):
    row = spark.sql(f"SELECT {phrases._score('a', 'n', 'l', 'r')} AS score FROM VALUES (3000000000000, 90000000000000, 4000000000000, 5000000000000) AS t(a, n, l, r)")
    assert row.first()[0] == 1000 * 3000000000000 * 90000000000000 // (4000000000000 * 5000000000000)
