import datetime as dt
import json
from pathlib import Path

from encore.operators.grain import EXPORT_COLUMNS
from encore.sources import files
from encore.streaming import intake


def put(folder, name, text):
    path = Path(folder) / name
    path.write_text(text)
    return str(path)


def test_drifting_csv(spark, folder):
    a = put(folder, "final_2024_01.csv", 'social_id,pais\nu1,"A ""quoted"", R"\nu2,BR,extra,more\nu3,CL\n')
    b = put(folder, "final_2024_02.csv", "pais,nuevo,social_id\nAR,n1,u4\n")
    rows = files.with_file_period(files.read_drifting_csv(spark, [a, b]))
    got = {r["social_id"]: (r["pais"], r["nuevo"], r["archivo_anio"], r["archivo_mes"]) for r in rows.collect()}
    assert got == {"u1": ('A "quoted", R', None, 2024, 1), "u3": ("CL", None, 2024, 1), "u4": ("AR", "n1", 2024, 2)}
    bad = files.read_drifting_csv(spark, [a, b], keep_corrupt=True).filter(f"{files.CORRUPT} IS NOT NULL")
    assert [r[files.CORRUPT] for r in bad.collect()] == ["u2,BR,extra,more"]
    some = files.read_monthly_exports(spark, [a, b], ["social_id", "nuevo"])
    assert sorted(some.columns) == ["archivo", "archivo_anio", "archivo_mes", "nuevo", "social_id"] and some.count() == 3


def test_fact_scan_prunes_partitions(spark, folder):
    rows = spark.createDataFrame([(1, "2024-01"), (2, "2024-02"), (3, "2024-03"), (4, None)], "v int, ym string")
    files.write_parquet(rows, f"{folder}/fact", ["ym"])
    assert {r["v"] for r in files.read_fact(spark, f"{folder}/fact", "ym").collect()} == {1, 2, 3}
    scan = files.read_fact(spark, f"{folder}/fact", "ym", "2024-02", "2024-02")
    assert [r["v"] for r in scan.collect()] == [2]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan


def test_tables_views_and_ids(spark, folder):
    rows = spark.createDataFrame([("1", 2.5), ("2", float("nan"))], "social_id string, x double")
    files.register_view(rows, "some_rows")
    assert spark.sql("SELECT count(*) AS n FROM some_rows").first()["n"] == 2
    files.replace_table(rows, "kept")
    files.replace_table(rows.limit(1), "kept")
    assert spark.table("kept").count() == 1
    files.write_bucketed(rows, "bucketed", "social_id", 2)
    joined = spark.table("bucketed").join(spark.table("bucketed").withColumnRenamed("x", "y").hint("merge"), "social_id")
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    files.write_csv(rows, f"{folder}/ids")
    assert {r["social_id"] for r in files.read_ids(spark, f"{folder}/ids").collect()} == {"1", "2"}
    files.write_json_results({"a": rows}, f"{folder}/json")
    lines = [json.loads(x) for p in Path(f"{folder}/json/a").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["social_id"]: x["x"] for x in lines} == {"1": 2.5, "2": None}


def export(folder, year, month, rows):
    names = list(dict.fromkeys(EXPORT_COLUMNS))
    lines = [",".join(names)] + [",".join(str(r.get(c, "")) for c in names) for r in rows]
    put(folder, f"final_{year}_{month:02d}.csv", "\n".join(lines) + "\n")


def test_intake_keeps_the_newest_file_per_user(spark, folder):
    landing = Path(folder) / "landing"
    landing.mkdir()
    row = lambda user, pais, money, tx="t": {
        "social_id": user, "nro_trip": 1, "transaction_code": tx, "reservation_datetime": dt.date(2024, 1, 1), "product_type": "Vuelos",
        "pais": pais, "gross_bookings_usd": money,
    }
    table = intake.UserTable(spark, f"{folder}/users")
    run = lambda: intake.run_intake(
        intake.export_stream(spark, str(landing), intake.export_schema()), table, f"{folder}/progress"
    ).awaitTermination()
    export(landing, 2024, 2, [row("a", "new", 1.0), row("b", "only", 2.0), row("b", "only", 3.0, "t2")])
    run()
    export(landing, 2024, 1, [row("a", "old", 9.0), row("c", "late", 4.0)])
    export(landing, 2024, 3, [row("b", "newest", 7.0)])
    run()
    got = {r["social_id"]: (r["pais"], r["gross_bookings_usd"], r["archivo_mes"]) for r in table.read().collect()}
    assert got == {"a": ("new", 1.0, 2), "b": ("newest", 7.0, 3), "c": ("late", 4.0, 1)}
    first = {r["social_id"]: r["gross_bookings_usd"] for r in spark.read.parquet(table.versions()[0][2]).collect()}
    assert first == {"a": 1.0, "b": 5.0}


def test_intake_counts_what_it_drops_and_goes_on_without_its_progress(spark, folder):
    landing = Path(folder) / "landing"
    landing.mkdir()
    row = lambda user, money, pais="AR": {
        "social_id": user, "nro_trip": 1, "transaction_code": "t", "reservation_datetime": dt.date(2024, 1, 1), "product_type": "Vuelos", "pais": pais,
        "gross_bookings_usd": money,
    }
    table = intake.UserTable(spark, f"{folder}/users", keep=1)
    run = lambda progress: intake.run_intake(
        intake.export_stream(spark, str(landing), intake.export_schema()), table, f"{folder}/{progress}"
    ).awaitTermination()
    export(landing, 2024, 1, [row("a", "n/a"), row("b", 2.0, '"two\nlines"')])
    with (landing / "final_2024_01.csv").open("a") as out:
        out.write("x,y\n")
    run("first")
    got = {r["social_id"]: r["pais"] for r in table.read().collect()}
    assert got == {"a": "AR", "b": "two\nlines"} and table.dropped().first()["records"] == 1
    export(landing, 2024, 2, [row("c", 1.0)])
    run("second")
    assert {r["social_id"] for r in table.read().collect()} == {"a", "b", "c"} and len(table.versions()) == 1


def test_line_breaks_in_quotes_and_lines_like_the_header(spark, folder):
    a = put(folder, "x_2024_01.csv", 'social_id,pais\nu1,"A\nB"\nsocial_id,pais\nu2,C,D\n')
    rows = files.read_drifting_csv(spark, [a])
    assert {(r["social_id"], r["pais"]) for r in rows.collect()} == {("u1", "A\nB"), ("social_id", "pais")}
    assert files.read_drifting_csv(spark, [a], keep_corrupt=True, columns=["pais"]).filter(f"{files.CORRUPT} IS NOT NULL").count() == 1
