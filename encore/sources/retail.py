"""The twelve source tables expressed over a generic retail star schema.

Orders play the part of trips, order lines of product rows, suppliers of destinations, and click-stream
events of visits. Event times are stretched over the years the orders cover, so that visits fall before,
between and after trips.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BRAND = "House"
EVENT_STRETCH = 80
# Suppliers are sent to all executors up to this many rows of two numbers, and joined like any table beyond.
BROADCAST_ROWS = 1_000_000

# Fixed values that give the star schema's codes the names the operators expect.
PLACES = (
    "CUN", "RIO", "BUE", "MIA", "MAD", "SCL", "BOG", "LIM", "GRU", "IGU", "CHI", "VER", "BRC",
    "PUJ", "MEX", "LAX", "NYC", "REC", "FLN", "COR", "QQQ", "ZZZ", "XYZ", "SSA", "PVR",
)
PRODUCTS = {
    "STANDARD": "Vuelos",
    "MEDIUM": "Hoteles",
    "PROMO": "Traslados",
    "ECONOMY": "Autos",
    "LARGE": "Asistencia al viajero",
    "SMALL": "Actividades",
}
PURCHASES = {"A": "Vuelos", "N": "Hoteles", "R": "Carrito"}
STATUSES = {"F": "Confirmado", "O": "Pendiente", "P": "Cancelado"}
OPEN_EVENTS = ("MANUAL_ENTRY", "EMAIL", "SEM_KAYAK", "SEO_BRAND", "BND_CORE", "ERROR_SEM_X", "DISPLAY_ADS")
CLOSED_EVENTS = ("PUSH", "SEM_WHATSAPP", "SEO_GOOGLE_HOTELS", "SEOAX", "SEM_GENERIC", "MANUAL_ENTRY", None)
PAYMENT_TYPES = (
    "Tarjeta de Crédito", "Transferencia", "Depósito Bancario", "Puntos Loyalty", "Cupón", "Cash", None,
)
BANKS = ("Banco Uno", "Banco Dos", " ", None, "Banco Tres")
TIERS = ("1-Viajero", " 2-Explorador", "3-Global", "")
MOODS = ("Satisfecho", "Neutro", "Insatisfecho", "NA")


def _pick(values: tuple[str | None, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def _named(values: dict[str, str], code: Column) -> Column:
    chain = None
    for key, name in values.items():
        chain = F.when(code == key, name) if chain is None else chain.when(code == key, name)
    return chain


def _transaction() -> Column:
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_returnflag")


class RetailSources:
    """Source tables for the operators, read from the Parquet files of one data folder."""

    brand = BRAND
    company = BRAND
    # First cohort kept, and the first days with usable margin and media-path data, on the orders' calendar.
    cohort_dates = {"min_date": "1995-03-01", "margin_since": "1996-01-01", "media_since": "1997-01-01"}

    def __init__(self, spark: SparkSession, folder: str, status: str | None = None, dealt: int | None = None):
        """With a ``status``, order lines are those of orders with that status only; with ``dealt``, they are stored in that many
        parts by user."""
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.status = status
        self.dealt = dealt
        self._keep: Callable[[Callable[[], DataFrame]], DataFrame] | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def size(self) -> int:
        """Order lines, which every table of transactions comes from."""
        return self.table("lineitem").count()

    def share(self, keep: Callable[[Callable[[], DataFrame]], DataFrame]) -> None:
        """Has the joined order lines stored by ``keep`` on first use, so that nine tables do not join and move them again."""
        self._keep = keep

    def within(
        self, status: str, keep: Callable[[Callable[[], DataFrame]], DataFrame], dealt: int | None = None
    ) -> RetailSources:
        """The same tables for orders of one status: all that operators need whose key lists have no other. Lines stored by ``keep``,
        dealt by user if a number of parts is given."""
        some = RetailSources(self.spark, self.folder, status, dealt)
        some.share(keep)
        return some

    def _orders(self, status: str | None) -> DataFrame:
        orders = self.table("orders").drop("o_totalprice")
        if status is None:
            return orders
        return orders.filter(_named(STATUSES, F.col("o_orderstatus")) == status).drop("o_orderstatus")

    def by_user(self, status: str, heaviest: int) -> bool:
        """Whether lines can be dealt by user: every order of the status has one buyer, and no buyer more than ``heaviest`` orders."""
        orders = self._orders(status)
        heavy = orders.groupBy("o_custkey").count().filter(F.col("count") > heaviest)
        owners = orders.groupBy("o_orderkey").agg(
            F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"),
            F.count("o_custkey").alias("known"), F.count(F.lit(1)).alias("n"),
        )
        return heavy.isEmpty() and owners.filter("low <> high OR (known > 0 AND known < n)").isEmpty()

    @cached_property
    def _described(self) -> DataFrame:
        return self._describe() if self._keep is None else self._keep(self._describe)

    def _describe(self) -> DataFrame:
        """Order lines with all that the tables below need of their order, buyer, seller and part, in as few moves as joins take.

        ``placed`` and ``typed`` mark lines whose buyer and seller, or part, are known: only those are rows of some tables.
        """
        nation = self.table("nation")
        region = lambda key, name: F.broadcast(nation.select(F.col("n_nationkey").alias(key), F.col("n_regionkey").alias(name), F.lit(True).alias(f"{name}_known")))
        sellers = self.table("supplier").select("s_suppkey", "s_nationkey").join(region("s_nationkey", "seller_region"), "s_nationkey")
        few = self.table("supplier").count() <= BROADCAST_ROWS
        buyers = self.table("customer").select(F.col("c_custkey").cast("string").alias("social_id"), "c_nationkey", "c_mktsegment")
        buyers = buyers.join(region("c_nationkey", "buyer_region"), "c_nationkey")
        parts = self.table("part").select("p_partkey", "p_type", "p_size")
        of_order = Window.partitionBy("l_orderkey")
        sold = F.col("l_suppkey") == F.col("s_suppkey")
        # Orders come first: what they leave out moves no further. What a user brings is joined last, where lines stay.
        lines = (
            self.table("lineitem")
            .join(self._orders(self.status), F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumns({"trip_checkin": F.min("l_shipdate").over(of_order), "trip_checkout": F.max("l_shipdate").over(of_order)})
            .join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
            .withColumns({"typed": F.col("p_partkey").isNotNull(), "social_id": F.col("o_custkey").cast("string")})
            .drop("o_orderkey", "p_partkey", "o_custkey")
        )
        if not few:
            lines = lines.join(sellers, sold, "left")
        if self.dealt is not None:
            lines = lines.repartition(self.dealt, "social_id")
        lines = lines.join(buyers, "social_id", "left")
        if few:
            lines = lines.join(F.broadcast(sellers), sold, "left")
        known = lines.withColumns(
            {
                "domestic": F.col("buyer_region") == F.col("seller_region"),
                "placed": F.col("buyer_region_known").isNotNull() & F.col("seller_region_known").isNotNull(),
            }
        ).drop("s_suppkey", "buyer_region", "buyer_region_known", "seller_region", "seller_region_known")
        # Lines stored by user get their transaction when they are read: it need not move.
        return known if self.dealt is not None else known.withColumn("transaction_code", _transaction())

    @cached_property
    def _lines(self) -> DataFrame:
        order_day = F.col("o_orderdate").cast("date")
        lines = self._described
        if self.dealt is not None:
            lines = lines.withColumn("transaction_code", _transaction())
        return lines.withColumns(
            {
                "reservation_date": order_day,
                "reservation_datetime": F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber")),
                "reservation_year_month": F.date_format(order_day, "yyyy-MM"),
                "status": _named(STATUSES, F.col("o_orderstatus")) if self.status is None else F.lit(self.status),
                "price": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            }
        )

    @property
    def _placed_lines(self) -> DataFrame:
        return self._lines.filter("placed")

    @property
    def _typed_lines(self) -> DataFrame:
        return self._lines.filter("typed").withColumn("product_type", _named(PRODUCTS, F.col("p_type")))

    @cached_property
    def transactions(self) -> DataFrame:
        return self._placed_lines.select(
            "transaction_code",
            "social_id",
            "reservation_date",
            "reservation_datetime",
            "reservation_year_month",
            F.when(F.col("l_linestatus") == "F", "APP").otherwise(F.col("o_orderpriority")).alias("platform"),
            F.when(F.col("l_quantity") <= 40, F.col("c_mktsegment")).alias("parent_channel"),
            F.when(F.col("domestic"), "Nac").otherwise("Int").alias("trip_type"),
            F.lit(BRAND).alias("brand"),
            F.lit("B2C").alias("line_of_business"),
            F.col("status").alias("transaction_status"),
            F.col("price").alias("gross_bookings_usd"),
            (F.col("l_extendedprice") * 0.8).alias("cost_usd"),
            (F.col("price") * (F.col("l_tax") - 0.02)).alias("margin_variable_without_mkt_net_usd"),
            (F.col("price") * F.col("l_tax")).alias("net_revenues_usd"),
            (F.col("price") * (F.col("l_tax") - F.col("l_discount"))).alias("npv_without_mkt_net_usd"),
            F.col("l_quantity").alias("fee_net_usd"),
        )

    @cached_property
    def trips(self) -> DataFrame:
        buyer = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer_nation"))
        lines = self._placed_lines.filter("typed").join(F.broadcast(buyer), "c_nationkey")
        product = _named(PRODUCTS, F.col("p_type"))
        return lines.select(
            "social_id",
            F.col("l_orderkey").cast("string").alias("trip_id"),
            "transaction_code",
            "reservation_datetime",
            "reservation_date",
            "reservation_year_month",
            F.col("status").alias("trip_status"),
            F.col("status").alias("transaction_status"),
            F.lit(BRAND).alias("brand"),
            _named(PURCHASES, F.col("l_returnflag")).alias("purchase_type"),
            product.alias("product_type"),
            F.col("buyer_nation").alias("country_code"),
            F.when(product == "Vuelos", _pick(PLACES, F.col("c_nationkey"))).alias("first_origin_id"),
            F.when(F.col("l_tax") < 0.08, _pick(PLACES, F.col("s_nationkey"))).alias("first_destination_id"),
            "trip_checkin",
            "trip_checkout",
        )

    @cached_property
    def visits(self) -> DataFrame:
        start = F.expr(
            f"(ts - TIMESTAMP_NTZ'2024-01-01 00:00:00') * {EVENT_STRETCH} + TIMESTAMP_NTZ'1995-01-01 00:00:00'"
        )
        return self.table("events").select(
            F.col("user_id").cast("string").alias("social_id"),
            F.col("event_id").cast("string").alias("visit_id"),
            start.alias("start_visit"),
            F.date_format(start.cast("date"), "yyyy-MM-dd").alias("visit_date"),
            F.get_json_object("props", "$.k").try_cast("int").alias("count_search"),
            F.when(F.col("event_type") == "error", "Other").otherwise(f" {BRAND.lower()} ").alias("company"),
            F.when(F.col("event_type") == "view", "iphone-app")
            .when(F.col("event_type") == "click", "android-app")
            .otherwise("web")
            .alias("main_channel"),
        )

    @cached_property
    def attribution(self) -> DataFrame:
        line = F.col("l_linenumber") - 1
        clicked = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))
        return self._lines.select(
            F.col("transaction_code").alias("transaction_id"),
            "social_id",
            "reservation_date",
            F.when(F.col("l_linestatus") == "F", _pick(CLOSED_EVENTS, line))
            .otherwise(_pick(OPEN_EVENTS, line))
            .alias("event_type"),
            F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                        F.col("l_linenumber").cast("string")).alias("event_id"),
            F.when(F.col("l_discount") == 0, "not a date")
            .otherwise(F.date_format(clicked, "yyyy-MM-dd HH:mm:ss"))
            .alias("click_date_time"),
            F.when(F.col("l_tax") == 0.08, 34).otherwise(33).alias("model_id"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        size = F.col("p_size")
        return self._typed_lines.select(
            "transaction_code",
            "social_id",
            "reservation_year_month",
            F.when(size <= 25, "ECONOMY")
            .when(size <= 35, "PREMIUM_ECONOMY")
            .when(size <= 45, "BUSINESS")
            .when(size <= 48, "FIRST")
            .alias("flight_class"),
        )

    @cached_property
    def discounts(self) -> DataFrame:
        return self._lines.select(
            "transaction_code",
            "social_id",
            "reservation_date",
            "reservation_year_month",
            F.when(F.col("l_discount") > 0.07, "SAVE").otherwise(" ").alias("coupon_code"),
            F.when(F.col("l_discount") == 0.02, "U").cast("string").alias("coupon_use_id"),
        )

    @cached_property
    def products(self) -> DataFrame:
        known = F.col("l_tax") > 0
        adults = F.when(known, (F.col("l_quantity") % 3 + 1).cast("int"))
        childs = F.when(known, F.when(F.col("l_discount") >= 0.09, 1).otherwise(0))
        infants = F.when(known, F.when(F.col("l_quantity") >= 48, 1).otherwise(0))
        return self._typed_lines.select(
            "transaction_code",
            "social_id",
            "product_type",
            "reservation_year_month",
            adults.alias("adults_quantity"),
            childs.alias("childs_quantity"),
            infants.alias("infants_quantity"),
            (adults + childs + infants).alias("total_passengers_quantity"),
        )

    @cached_property
    def redemptions(self) -> DataFrame:
        return self._lines.filter("l_tax >= 0.05").select(
            F.col("transaction_code").alias("redeemed_transaction_code"),
            "social_id",
            F.when(F.col("l_quantity") > 5, F.col("l_quantity") * 10).alias("puntos_redimidos"),
            _pick(TIERS, F.col("l_linenumber") % 4).alias("tier"),
            F.when(F.col("l_tax") == 0.08, 1).otherwise(0).alias("flg_cancelado"),
            F.when(F.col("l_discount") == 0.1, 1).otherwise(0).alias("flg_error"),
        )

    @cached_property
    def contacts(self) -> DataFrame:
        return self._lines.filter("l_returnflag = 'R'").select(
            "transaction_code",
            "social_id",
            F.col("l_suppkey").cast("string").alias("conversation_id"),
            _pick(MOODS, F.col("l_linenumber") % 4).alias("nps"),
            F.when(F.col("l_linestatus") == "F", "Si").otherwise("No").alias("resolution"),
            F.when(F.col("l_quantity") > 45, "n/a")
            .otherwise(F.col("l_quantity").cast("int").cast("string"))
            .alias("agent_empathy"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        slot = F.col("l_linenumber") % 3
        return self._lines.select(
            "transaction_code",
            "social_id",
            "reservation_year_month",
            F.col("l_linenumber").cast("string").alias("payment_method_id"),
            F.concat_ws("-", "social_id", slot.cast("string")).alias("payment_user_id"),
            F.when(F.col("l_discount") < 0.1, F.col("price")).alias("gross_bookings_usd"),
        )

    @cached_property
    def payment_instruments(self) -> DataFrame:
        owned = self.table("customer").withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        return owned.select(
            F.concat_ws("-", F.col("c_custkey").cast("string"), F.col("slot").cast("string")).alias("payment_user_id"),
            F.col("c_custkey").cast("string").alias("social_id"),
            _pick(PAYMENT_TYPES, (F.col("c_nationkey") + F.col("slot")) % 7).alias("payment_type"),
            _pick(BANKS, (F.col("c_nationkey") + F.col("slot")) % 5).alias("bank"),
            F.when(F.col("c_acctbal") > 5000, "Black").when(F.col("c_acctbal") > 0, "Gold").otherwise("").alias("tier"),
        )

    @cached_property
    def profiles(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        rows = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, "c_nationkey")
        )
        balance = F.col("c_acctbal")
        known = lambda value: F.when(F.col("o_orderpriority") != "5-LOW", value).otherwise(F.lit(" "))
        return rows.select(
            F.col("o_custkey").cast("string").alias("social_id"),
            F.col("o_orderdate").alias("audit_datetime"),
            F.date_sub(F.col("o_orderdate").cast("date"), F.floor(F.col("o_totalprice") / 100).cast("int")).alias(
                "creation_date"
            ),
            F.when(F.col("o_totalprice") > 20000, (1880 + F.floor(F.col("o_totalprice") / 4000)).cast("int")).alias(
                "birth_year"
            ),
            F.when(balance < 0, " ").when(balance < 3000, "Low").when(balance < 6000, "Medium")
            .when(balance < 9000, "High").otherwise("Unknown").alias("income"),
            known(F.col("n_name")).alias("nationality"),
            F.col("n_name").alias("country_code"),
            known(F.col("c_nationkey").cast("string")).alias("state_code"),
            F.concat_ws(" ", F.lit("State"), F.col("c_nationkey").cast("string")).alias("state_name"),
            F.col("c_mktsegment").alias("city_id"),
            known(F.col("c_mktsegment")).alias("city_code"),
            F.initcap("c_mktsegment").alias("city_name"),
            _pick(PLACES, F.col("c_nationkey")).alias("last_visit_geolocation_city_code"),
            F.col("n_name").alias("last_visit_geolocation_country_code"),
            known(_pick(PLACES, F.col("c_nationkey"))).alias("frequent_visit_geolocation_city_code"),
            known(F.col("n_name")).alias("frequent_visit_geolocation_country_code"),
            _pick(PLACES, F.col("c_nationkey")).alias("last_transaction_geolocation_city_code"),
            F.col("n_name").alias("last_transaction_geolocation_country_code"),
            F.lit(BRAND).alias("company"),
        )
