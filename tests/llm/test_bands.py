import random

import pytest

from encore.llm import bands
from tests.llm import brute

random.seed(5)
PROSE = " ".join("".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 9))) for _ in range(900))
NOISE = "".join(random.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9000))
NOISE = " ".join(NOISE[i : i + 60] for i in range(0, 9000, 60))
TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h i j", "a b c d e a b c d e f g", "x\nx\n \nx \n\n y\ny", "# * $ %% | <a> &",
    PROSE, PROSE[:700], "spam eggs " * 500, PROSE[:3000] + "\n" + "again and again " * 4000, NOISE, "é ü ß " * 5, "a\x0bb\x0cc\x1cd e", PROSE,
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(TEXTS)]
    table = spark.createDataFrame(rows, "doc_id long, text string, reason string, kept double")
    return {r["doc_id"]: r for r in bands.quality_rules(table).collect()}


def test_counts_match_brute_force(found):
    for i, text in enumerate(TEXTS):
        expected = brute.base_counts(text)
        assert {k: found[i][k] for k in expected} == expected, text


def test_verdicts(found):
    why = {i: found[i]["reason"] for i in found}
    assert why[8] == why[9] == why[15] == "" and found[8]["kept"]
    assert why[12] == "incompressible"
    assert why[0] == why[1] == why[10] == "base"
    assert not found[11]["kept"]
    judge = bands.Judge(bands.Limits())
    assert judge.compression(("spam eggs " * 500).encode())[3] == "repetitive"
    assert judge.compression((PROSE + "again and again " * 2000).encode())[3].startswith("repetitive")
    assert judge.compression(random.randbytes(5000))[3] == "incompressible"
    strict = bands.Judge(bands.Limits(odd_chunks=0.1))
    mixed = random.randbytes(4096) + "".join(random.sample(PROSE.split(), 900)[i] + " " for i in range(900)).encode() * 3
    assert strict.compression(mixed)[3] == "incompressible chunks"
    assert judge.compression(b"")[0] == 0.0


def test_limits_follow_the_length():
    limits = bands.Limits()
    assert limits.of(5) == (0.0, float("inf"))
    assert limits.of(128)[1] < limits.of(10**6)[1]


def test_filter_keeps_all_columns(spark):
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string")
    kept = bands.keep_by_quality(table)
    assert kept.columns == table.columns
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [4, 8, 9, 15]


def test_empty_table(spark):
    assert bands.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_limits_follow_the_documents(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(6)) for _ in range(3000)]
    good = [" ".join(rng.choice(words) for _ in range(400))[:2100] for _ in range(150)]
    filler = ["".join(f"{rng.choice(words)} {rng.choice(words[:4])} " for _ in range(220))[:2100] for _ in range(8)]
    rows = list(enumerate([*good, *filler, *filler[:1] * 300]))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    wide = {r["doc_id"] for r in bands.quality_rules(table, limits=bands.Limits()).collect() if r["kept"]}
    kept = {r["doc_id"] for r in bands.quality_rules(table).collect() if r["kept"]}
    assert wide == set(range(len(rows))) and len(kept & set(range(150))) >= 148 and not kept - set(range(150))
    assert {r["doc_id"] for r in bands.keep_by_quality(table).collect()} == kept
