import hashlib
import random

import pytest

from encore.llm import decontam
from tests.llm import brute

random.seed(3)
WORDS = [f"w{i}" for i in range(400)] + ["é", "日本", "x-y"]


def passage(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


ITEMS = {"7": passage(30), "10": passage(10), "2": "just four Words here", "3": "", "4": passage(15), "twin": None}
ITEMS["twin"] = ITEMS["10"]
TEXTS = [
    None, "", passage(200), f"{passage(5)}, {ITEMS['7'].upper()}! {passage(5)}", ITEMS["10"], passage(3) + " JUST, four\nwords here. " + passage(2),
    ITEMS["7"][: len(ITEMS["7"]) // 2], " ".join([ITEMS["4"], passage(4), ITEMS["4"], ITEMS["10"]]), "just four", (passage(3000) + " ") * 3 + ITEMS["4"], ITEMS["10"],
]


@pytest.fixture(scope="module")
def tables(spark):
    documents = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_hit int, item_id string")
    rows = [*ITEMS.items(), (None, passage(12)), ("7", ITEMS["7"]), ("null", None)]
    return documents, spark.createDataFrame(rows, "item_id string, text string")


@pytest.mark.parametrize("part", [200_000, 9])
def test_report_matches_brute_force(tables, part):
    documents, benchmark = tables
    for row in decontam.leak_report(documents, benchmark, part_windows=part).collect():
        n, covered, names = brute.leaks(TEXTS[row["doc_id"]], ITEMS)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"]) == (n, len(covered), len(names), digest)
        assert row["contaminated"] == bool(covered)


def test_spans_are_cut_and_clean_rows_stay(tables):
    documents, benchmark = tables
    cut = {r["doc_id"]: r for r in decontam.decontaminate(documents, benchmark, mode="spans").collect()}
    assert set(cut) == set(range(len(TEXTS)))
    for i in (0, 1, 2, 8):
        assert cut[i]["text"] == TEXTS[i]
    for i, row in cut.items():
        assert not brute.leaks(row["text"], ITEMS)[1] and row["item_id"] == "x"
        words = brute.alnum_words(TEXTS[i])
        covered = brute.leaks(TEXTS[i], ITEMS)[1]
        assert brute.alnum_words(row["text"]) == [w for k, w in enumerate(words) if k not in covered]


def test_documents_with_leaks_go(tables):
    documents, benchmark = tables
    kept = decontam.decontaminate(documents, benchmark)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if not brute.leaks(t, ITEMS)[1]]
    with pytest.raises(ValueError):
        decontam.decontaminate(documents, benchmark, mode="sentences")


def test_empty_tables(spark, tables):
    documents, benchmark = tables
    assert decontam.leak_report(documents.limit(0), benchmark).count() == 0
    assert decontam.leak_report(documents, benchmark.limit(0)).filter("contaminated").count() == 0


def test_items_without_id_hit_as_the_sql_says(spark):
    import duckdb

    from encore.llm.queries import ORACLE_SQL

    lost, named = passage(14), passage(12)
    rows = [(0, f"{passage(3)} {lost} {passage(3)}"), (1, f"{named}, {lost}"), (2, passage(20)), (3, named)]
    items = [(None, lost), (None, f"{lost} more"), ("a", named)]
    documents, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    con = duckdb.connect()
    for name, frame in (("documents", documents), ("benchmark", benchmark)):
        con.register(name, frame.toPandas())
    names = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    expected = con.sql(f"SELECT {names} FROM ({ORACLE_SQL['op3_decontamination']}) ORDER BY doc_id").fetchall()
    for part in (200_000, 4):
        found = decontam.leak_report(documents, benchmark, part_windows=part).orderBy("doc_id").collect()
        assert [tuple(r) for r in found] == expected
    assert [r["doc_id"] for r in decontam.decontaminate(documents, benchmark).collect()] == [2]


def test_id_named_like_the_marks(spark):
    table = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "none")], "marks long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    found = {r["marks"]: r["n_hit"] for r in decontam.leak_report(table, items, id_col="marks").collect()}
    assert found == {1: 10, 2: 0}
