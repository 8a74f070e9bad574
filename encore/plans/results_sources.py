"""Registered results: readers and writers, over tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import exact_quantiles
from ..sources import files
from .catalog import result
from .stages import Stages


def _place(s: Stages, name: str) -> str:
    return f"{s.store.root}/files/{name}"


@result(
    "drifting_csv",
    "S1 U3",
    """SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment,
        CASE WHEN c_nationkey % 2 = 1 THEN c_acctbal END AS c_acctbal, c_name || chr(10) || '"' || c_mktsegment || ', x"' AS note FROM customer""",
)
def _(s: Stages):
    rows = s.src.table("customer").withColumn("note", F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit(', x"')))
    parts = {"even": ["c_custkey", "c_mktsegment", "note"], "odd": ["note", "c_acctbal", "c_custkey"]}
    for i, (name, columns) in enumerate(parts.items()):
        files.write_csv(rows.filter(F.col("c_nationkey") % 2 == i).select(*columns), _place(s, name))
    read = files.read_drifting_csv(s.store.spark, [_place(s, name) for name in parts])
    return read.select("c_custkey", "c_mktsegment", F.col("c_acctbal").try_cast("double").alias("c_acctbal"), "note")


@result(
    "monthly_exports",
    "S2 U1",
    """SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, year(o_orderdate)::INTEGER AS archivo_anio, month(o_orderdate)::INTEGER AS archivo_mes
    FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) <= 3""",
)
def _(s: Stages):
    orders = s.src.table("orders")
    paths = []
    for month in (1, 2, 3):
        some = orders.filter((F.year("o_orderdate") == 1996) & (F.month("o_orderdate") == month))
        paths.append(_place(s, f"orders_1996_{month:02d}.csv"))
        files.write_csv_file(some.select("o_orderkey", "o_totalprice", "o_orderstatus"), paths[-1])
    return files.read_monthly_exports(s.store.spark, paths, ["o_orderkey", "o_orderstatus"]).drop("archivo")


@result(
    "fact_scan",
    "S3",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1995-11' AND '1996-02'""",
)
def _(s: Stages):
    rows = s.src.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"))
    files.write_parquet(rows.filter(F.col("ym").between("1995-01", "1996-12")), _place(s, "fact"), ["ym"])
    return files.read_fact(s.store.spark, _place(s, "fact"), "ym", "1995-11", "1996-02", schema=rows.schema)


@result("named_view", "S5", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(s: Stages):
    files.register_view(s.src.table("customer"), "customer_view")
    return s.store.spark.sql("SELECT c_mktsegment, count(*) AS n FROM customer_view GROUP BY c_mktsegment")


@result("replaced_table", "S6", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0")
def _(s: Stages):
    rows = s.src.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    name = "replaced_" + s.store.root.rpartition("-")[2]
    files.replace_table(rows, name)
    files.replace_table(rows.filter("c_acctbal >= 0").select("c_custkey", "c_mktsegment"), name)
    return s.store.spark.table(name)


@result("csv_sink", "S8", "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def _(s: Stages):
    files.write_csv(s.src.table("customer").select("c_custkey", "c_name"), _place(s, "csv"))
    return s.store.spark.read.option("header", True).options(**files.CSV_OPTIONS).csv(_place(s, "csv"))


@result("json_sink", "S9", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def _(s: Stages):
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("double")).otherwise(F.lit(float("nan")))
    rows = s.src.table("customer").select("c_custkey", balance.alias("c_acctbal"))
    files.write_json_results({"customers": rows}, _place(s, "json"))
    return s.store.spark.read.schema(rows.schema).json(_place(s, "json/customers"))


@result("id_list", "S10", "SELECT c_custkey::VARCHAR AS social_id FROM customer WHERE c_nationkey = 3")
def _(s: Stages):
    ids = s.src.table("customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("social_id"), "c_name")
    files.write_csv(ids, _place(s, "ids"))
    return files.read_ids(s.store.spark, _place(s, "ids"))


@result(
    "quantiles_without_nan",
    "A8 A10",
    " UNION ALL ".join(
        f"""SELECT c_mktsegment, {p}::DOUBLE AS probability, quantile_cont(c_acctbal::DOUBLE, {p}) AS value FROM customer
        WHERE c_acctbal >= 0 GROUP BY c_mktsegment"""
        for p in (0.01, 0.5, 0.99)
    ),
)
def _(s: Stages):
    holed = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("double")).otherwise(F.lit(float("nan")))
    return exact_quantiles(s.src.table("customer").withColumn("x", holed), "x", [0.01, 0.5, 0.99], ["c_mktsegment"])
