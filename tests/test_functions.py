import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from encore.functions import aggregates as A, buckets, ranking
from encore.functions.media import CLICK_LABELS, event_taxonomy, media_group
from encore.functions.places import COVERAGE_REGION_CITIES, DESTINATION_KIND_CITIES, REGION_CITIES
from encore.operators.lookups import lookup


def test_first_and_last_skip_nulls_and_break_ties(spark):
    rows = spark.createDataFrame(
        [("a", 1, None), ("a", 1, "x"), ("a", 1, "w"), ("a", 2, "z"), ("b", 1, None)], "k string, t int, v string"
    )
    got = rows.groupBy("k").agg(
        A.first_by("v", "t").alias("first"), A.last_by("v", "t").alias("last"), A.latest("v", "t").alias("latest")
    )
    assert {r["k"]: (r["first"], r["last"], r["latest"]) for r in got.collect()} == {
        "a": ("w", "z", "z"),
        "b": (None, None, None),
    }


def test_latest_keeps_a_null_on_the_newest_row(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "t int, v string")
    assert rows.agg(A.latest("v", "t").alias("v")).first()["v"] is None


def test_text_list_is_sorted_and_null_when_empty(spark):
    rows = spark.createDataFrame([("a", "z"), ("a", "b"), ("a", "z"), ("b", None)], "k string, v string")
    got = {r["k"]: r["l"] for r in rows.groupBy("k").agg(A.text_list("v").alias("l")).collect()}
    assert got == {"a": "b | z", "b": None}


def test_media_lists_come_before_prefixes_and_underscore_is_literal(spark):
    cases = {
        "SEO_X": "SEM/SEO/KWBrand", "SEOAX": "Otros", "SEM_KAYAK": "Metabuscadores", "SEM_WHATSAPP": "CRM",
        "ERROR_SEM_Z": "SEM/SEO/KWBrand", "MANUAL_ENTRY": "Directo", "BND_Q": "SEM/SEO/KWBrand", "OTHER": "Otros",
    }
    rows = spark.createDataFrame([(e,) for e in cases] + [(None,)], "e string")
    got = {r["e"]: r["g"] for r in rows.select("e", event_taxonomy("e").alias("g")).collect()}
    assert got == {**cases, None: None}
    assert rows.filter("e IS NULL").select(media_group("e", CLICK_LABELS)).first()[0] == "Otros"


def test_bucket_edges(spark):
    rows = spark.createDataFrame([(d,) for d in (-1, 0, 6, 7, 29, 30, 89, 90, None)], "d int")
    got = [r[0] for r in rows.select(buckets.lead_time_bucket("d")).collect()]
    assert got == ["Invalido", "0-6 dias", "0-6 dias", "7-29 dias", "7-29 dias", "30-59 dias", "60-89 dias", "90+ dias", None]
    ages = spark.createDataFrame([(a,) for a in (None, -1, 0, 17, 18, 110, 111)], "a int")
    got = [r[0] for r in ages.select(buckets.age_bucket("a")).collect()]
    assert got == ["Sin dato", "Edad invalida", "<18", "<18", "18-24", "65+", "Edad invalida"]


def test_lookup_tables():
    assert len(REGION_CITIES) == 189
    kinds = DESTINATION_KIND_CITIES
    assert len(kinds) == 192
    assert (kinds["IGU"], kinds["CHI"], kinds["VER"]) == ("CATARATAS", "USA_CA", "CIUDAD_TUR")
    assert COVERAGE_REGION_CITIES["BEL"] == "BR_N"
    assert REGION_CITIES["BEL"] == "BR_NE"


def test_lookup_of_a_list(spark):
    rows = spark.createDataFrame([("CUN | MIA",), (None,), ("???",)], "c string")
    both = rows.select(lookup("c", REGION_CITIES), lookup("c", REGION_CITIES, first_of_list=False)).collect()
    assert [tuple(r) for r in both] == [("CAR_MX", "OTRO"), ("OTRO", "OTRO"), ("OTRO", "OTRO")]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(4, 3, 500), -rng.lognormal(2, 2, 100), np.full(300, 7.5), [0.0] * 50])
    pdf = pd.DataFrame({"g": rng.integers(0, 3, len(values)).astype(str), "v": values})
    rows = spark.createDataFrame(pdf)
    p = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r["probability"]: r["value"] for r in ranking.exact_quantiles(rows, "v", p).collect()}
    np.testing.assert_allclose([got[x] for x in p], np.quantile(values, p))
    grouped = ranking.exact_quantiles(rows, "v", [0.5], ["g"]).collect()
    np.testing.assert_allclose(
        [r["value"] for r in sorted(grouped, key=lambda r: r["g"])], pdf.groupby("g")["v"].median().to_numpy()
    )


def test_seeded_sample_is_exact_and_repeatable(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    one = {r["k"] for r in ranking.seeded_sample(rows, 777, "k", 5, digits=1).collect()}
    two = {r["k"] for r in ranking.seeded_sample(rows.repartition(7), 777, "k", 5, digits=3).collect()}
    assert len(one) == 777 and one == two
    assert one != {r["k"] for r in ranking.seeded_sample(rows, 777, "k", 6).collect()}
    assert ranking.seeded_sample(rows, 9999, "k").count() == 5000
    assert ranking.seeded_sample(rows, 0, "k").count() == 0


def test_global_row_number(spark):
    rows = spark.createDataFrame([(w,) for w in ["b", "aa", "ab", "c", "a", "bz"]], "w string")
    got = ranking.global_row_number(rows, ["w"], F.substring("w", 1, 1), "n").collect()
    assert [r["w"] for r in sorted(got, key=lambda r: r["n"])] == ["a", "aa", "ab", "b", "bz", "c"]
    assert sorted(r["n"] for r in got) == list(range(1, 7))


def test_quantiles_leave_out_nan(spark):
    from encore.functions.ranking import exact_quantiles

    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, float("nan"), None)], "x double")
    assert exact_quantiles(rows, "x", [0.5]).first()["value"] == 2.5
