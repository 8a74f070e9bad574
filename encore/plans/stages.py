"""Wiring of the operators, and the tables that several results share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import actions, enrich, grain, lookups, neighbours, propensity, targets, trips, wide
from ..session import remove_folder, shared_dir


class TableStore:
    """Writes a shared result once as Parquet in the shared folder and hands back the written table.

    A written table cuts lineage, survives lost executors and keeps column pruning and pushdown.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[str] = []
        self.root = f"{shared_dir(spark)}/encore-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        frame = build()
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def keep_bucketed(self, name: str, build: Callable[[], DataFrame], key: str, buckets: int) -> DataFrame:
        """The same as a table in buckets of its key, one sorted file each: joins and aggregates on the key need no exchange."""
        table = f"encore_{self.root.rsplit('-', 1)[-1]}_{name}"
        path = f"{self.root}/{name}"
        rows = build().repartition(buckets, key)
        rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def remove(self) -> None:
        """Deletes everything this store has written; call it when the application is done with its tables."""
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        remove_folder(self.spark, self.root)


@dataclass(frozen=True)
class Layout:
    """How shared tables are stored: in ``buckets`` of their users or transactions (None: as many as shuffle partitions, and more if
    a bucket would hold more than ``rows`` rows of the sources, so that tasks sort in memory), as long as no user has more than
    ``heaviest`` transactions and every transaction belongs to one user; otherwise as plain tables, whose joins adaptive execution
    splits. ``bucketed=False`` always gives plain tables."""

    bucketed: bool = True
    buckets: int | None = None
    rows: int = 120_000
    heaviest: int = 1_000_000


@dataclass(frozen=True)
class Modelling:
    """Settings of the modelling tables: rare levels, cut-off month, a given score, and the boosted trees."""

    rare: int = 1000
    cutoff: str = propensity.CUTOFF_MONTH
    coefficients: Mapping[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    trees: Mapping[str, int] = field(default_factory=dict)
    repeats: int = 5


class Stages:
    """Every shared result over one set of sources, built on first use."""

    def __init__(
        self, sources, store: TableStore, *, pre_days: int = 90, post_days: int = 90, modelling: Modelling = Modelling(), layout: Layout = Layout()
    ):
        self.modelling = modelling
        self.layout = layout
        self.src = sources
        self.store = store
        self.scope = trips.Scope(brand=sources.brand)
        self.pre_days = pre_days
        self.post_days = post_days
        if layout.bucketed:
            # Rows in buckets of a transaction, or of a user, also have all rows of a transaction and its day, or a user and a trip.
            store.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        if hasattr(sources, "share"):
            sources.share(lambda build: self.keep_all("lines", build))

    @cached_property
    def buckets(self) -> int:
        """How many buckets, see :class:`Layout`; sources that do not know their ``size`` are dealt by shuffle partitions alone."""
        least = int(self.store.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.layout.buckets or max(least, -(-getattr(self.src, "size", 0) // self.layout.rows))

    def keep_all(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table of all transactions, which are never heavy themselves."""
        if not self.layout.bucketed:
            return self.store.keep(name, build)
        return self.store.keep_bucketed(name, build, "transaction_code", self.buckets)

    @cached_property
    def dealt(self) -> bool:
        """Whether the rows of confirmed orders are stored by user from the start, so that users, trips and transactions meet without
        moving: sources have to tell that no transaction has two users and no user is heavy."""
        return self.layout.bucketed and hasattr(self.src, "by_user") and self.src.by_user(self.scope.status, self.layout.heaviest)

    @cached_property
    def facts(self):
        """The sources of all that key lists reach. These hold confirmed transactions only, so lines of other orders, where sources
        can leave them out, are not moved at all."""
        if not hasattr(self.src, "within"):
            return self.src
        # Steps on the way to the buckets sort in memory as well; adaptive execution joins partitions that are small.
        conf = self.store.spark.conf
        if self.layout.bucketed:
            conf.set("spark.sql.shuffle.partitions", str(max(int(conf.get("spark.sql.shuffle.partitions")), self.buckets)))
        if not self.dealt:
            return self.src.within(self.scope.status, lambda build: self.keep_all("facts", build))
        return self.src.within(self.scope.status, lambda build: self.keep_dealt("facts", build), self.buckets)

    def keep_dealt(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table of confirmed orders: by user where the facts are, else by transaction."""
        if not self.dealt:
            return self.keep_all(name, build)
        return self.store.keep_bucketed(name, build, "social_id", self.buckets)

    @cached_property
    def confirmed(self) -> DataFrame:
        return self.keep_dealt("confirmed", lambda: trips.confirmed_transactions(self.facts.transactions, self.scope))

    @cached_property
    def bucketed(self) -> bool:
        """Whether the tables of users and transactions are stored in buckets, see :class:`Layout`."""
        if not self.layout.bucketed:
            return False
        rows = self.confirmed.groupBy("social_id").agg(F.count(F.lit(1)).alias("n"))
        owners = self.confirmed.groupBy("transaction_code").agg(F.min("social_id").alias("low"), F.max("social_id").alias("high"))
        heavy = rows.filter((F.col("n") > self.layout.heaviest) & F.col("social_id").isNotNull())
        return heavy.isEmpty() and owners.filter("low <> high").isEmpty()

    def keep_by(self, key: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not self.bucketed:
            return self.store.keep(name, build)
        return self.store.keep_bucketed(name, build, key, self.buckets)

    @cached_property
    def users(self) -> DataFrame:
        return self.keep_by(
            "social_id",
            "users",
            lambda: trips.first_second_trip(trips.trips_base(self.facts.trips, self.confirmed, self.scope)),
        )

    @cached_property
    def detail(self) -> DataFrame:
        return self.keep_by(
            "social_id",
            "detail", lambda: trips.trip_detail(self.users, self.facts.trips, self.confirmed, self.scope)
        )

    @cached_property
    def targets(self) -> DataFrame:
        return self.keep_by("transaction_code", "targets", lambda: trips.target_transactions(self.detail))

    @cached_property
    def owner(self) -> str | None:
        """The column by which tables of transactions are stored beside their key, if the facts are: their user."""
        return "social_id" if self.dealt and self.bucketed else None

    @cached_property
    def keys(self) -> DataFrame:
        """The key list, with its users where tables of transactions carry them."""
        if self.owner is None:
            return self.targets
        return self.keep_by(self.owner, "keys", lambda: trips.target_transactions(self.detail, self.owner))

    def keep_side(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.keep_by(self.owner or "transaction_code", name, build)

    def by_transaction(self, side: DataFrame) -> DataFrame:
        """A table of transactions without its user."""
        return side if self.owner is None else side.drop(self.owner)

    @property
    def payment_methods(self) -> DataFrame:
        return enrich.payment_methods(self.facts.payments, self.src.payment_instruments, self.keys, owner=self.owner)

    @cached_property
    def payments(self) -> DataFrame:
        return self.keep_side("payments", lambda: self.payment_methods)

    @cached_property
    def app(self) -> DataFrame:
        return self.keep_by(
            "social_id",
            "app",
            lambda: enrich.app_behaviour(
                self.src.visits, self.users, self.src.company, self.pre_days, self.post_days
            ),
        )

    @cached_property
    def profile(self) -> DataFrame:
        return self.keep_by(
            "social_id",
            "profile", lambda: enrich.user_profile(self.src.profiles, self.users, self.src.company)
        )

    @property
    def economics(self) -> DataFrame:
        return enrich.economics(self.facts.transactions, self.keys, owner=self.owner)

    @property
    def coupons(self) -> DataFrame:
        return enrich.coupon_use(self.facts.discounts, self.keys, owner=self.owner)

    @property
    def cabins(self) -> DataFrame:
        return enrich.flight_class_list(self.facts.segments, self.detail, owner=self.owner)

    @property
    def passengers(self) -> DataFrame:
        return enrich.passengers(self.facts.products, self.detail, owner=self.owner)

    @property
    def media_path(self) -> DataFrame:
        return enrich.media_path_totals(self.facts.attribution, self.keys, owner=self.owner)

    @property
    def clicks(self) -> DataFrame:
        return enrich.first_last_click(self.facts.attribution, self.keys, owner=self.owner)

    @property
    def loyalty(self) -> DataFrame:
        return enrich.loyalty_redemption(self.facts.redemptions, self.keys, owner=self.owner)

    @property
    def service(self) -> DataFrame:
        return enrich.customer_service(self.facts.contacts, self.keys, owner=self.owner)

    @cached_property
    def economics_table(self) -> DataFrame:
        return self.keep_side("economics", lambda: self.economics)

    @cached_property
    def coupons_table(self) -> DataFrame:
        return self.keep_side("coupons", lambda: self.coupons)

    @cached_property
    def cabins_table(self) -> DataFrame:
        return self.keep_side("cabins", lambda: self.cabins)

    @cached_property
    def passengers_table(self) -> DataFrame:
        return self.keep_side("passengers", lambda: self.passengers)

    def build_sides(self) -> None:
        """Writes the side tables that do not depend on each other at the same time."""
        names = ("payments", "app", "profile", "economics_table", "coupons_table", "cabins_table", "passengers_table")
        _ = self.keys
        with ThreadPoolExecutor(max_workers=len(names)) as pool:
            list(pool.map(lambda name: getattr(self, name), names))

    def wide_parts(self) -> dict[str, DataFrame]:
        self.build_sides()
        return {
            "purchase_lists": trips.purchase_lists_per_trip(self.detail),
            "products": trips.products_per_trip(self.detail),
            "trip2": enrich.trip2_features(
                self.detail, self.economics_table, self.coupons_table, self.cabins_table, owner=self.owner
            ),
            "activity": trips.activity_between_trips(self.src.visits, self.users, self.src.company),
            "app": self.app,
            "profile": self.profile,
            "travellers": enrich.traveller_type(self.detail, self.passengers_table, owner=self.owner),
            "cabins": self.cabins_table,
            "media_path": self.media_path,
            "coupons": self.coupons_table,
            "clicks": self.clicks,
            "economics": self.economics_table,
            "loyalty": enrich.loyalty_per_transaction(self.loyalty, owner=self.owner),
            "service": self.service,
            "payments": self.payments,
            "passengers": self.passengers_table,
        }

    @cached_property
    def wide(self) -> DataFrame:
        keep = None if self.owner is None else self.keep_by
        return self.keep_by("social_id", "wide", lambda: wide.final_wide(self.detail, self.wide_parts(), self.bucketed, keep))

    @property
    def monthly_rows(self) -> DataFrame:
        """The wide table as monthly exports: each row carries the year and month of its file."""
        return self.wide.select(
            *grain.EXPORT_COLUMNS,
            F.year("reservation_date").alias("archivo_anio"),
            F.month("reservation_date").alias("archivo_mes"),
        )

    @cached_property
    def tx_level(self) -> DataFrame:
        return self.keep_by("social_id", "tx_level", lambda: grain.tx_level(self.wide, "social_id" if self.bucketed else None))

    @cached_property
    def user_level(self) -> DataFrame:
        return self.keep_by("social_id", "user_level", lambda: grain.user_level(self.wide))

    def build_modeling_view(self) -> DataFrame:
        return targets.modeling_view(self.user_level, grain.trip1_agg(self.tx_level), **self.src.cohort_dates)

    @cached_property
    def modeling_view(self) -> DataFrame:
        return self.store.keep("modeling_view", self.build_modeling_view)

    @cached_property
    def user_grain(self) -> DataFrame:
        return self.store.keep("user_grain", lambda: grain.user_grain_latest_file(self.monthly_rows))

    @cached_property
    def knn_users(self) -> DataFrame:
        return self.store.keep(
            "knn_users", lambda: lookups.with_destination_types(lookups.impute_and_log(self.user_grain))
        )

    @cached_property
    def model_rows(self) -> DataFrame:
        return self.store.keep(
            "model_rows",
            lambda: propensity.collapse_rare(propensity.model_features(self.modeling_view), min_count=self.modelling.rare),
        )

    @property
    def model_split(self) -> tuple[DataFrame, DataFrame]:
        return propensity.temporal_split(self.model_rows, self.modelling.cutoff)

    @cached_property
    def booster(self) -> propensity.Booster:
        return propensity.model_bundle(*self.model_split, repeats=self.modelling.repeats, **self.modelling.trees)

    @property
    def scored(self) -> DataFrame:
        score = propensity.logistic_score(self.modelling.coefficients, self.modelling.intercept)
        return propensity.model_features(self.modeling_view).withColumn("score", score)

    @property
    def rounded_scores(self) -> DataFrame:
        return self.scored.select("social_id", "label", F.bround("score", 4).alias("score"))

    @property
    def audience_scored(self) -> DataFrame:
        rows = propensity.feature_columns(actions.load_audience(self.modeling_view))
        return rows.withColumn("score", propensity.logistic_score(self.modelling.coefficients, self.modelling.intercept))

    @property
    def knn_groups(self) -> tuple[DataFrame, DataFrame]:
        return neighbours.split_reference_target(self.knn_users)

    def build_neighbours(self) -> DataFrame:
        reference, target = self.knn_groups
        return neighbours.nearest_users(target, reference)

    @cached_property
    def neighbours(self) -> DataFrame:
        return self.store.keep("neighbours", self.build_neighbours)

    def build_knn_table(self) -> DataFrame:
        reference, target = self.knn_groups
        return neighbours.knn_table(target, neighbours.recommend(self.neighbours, reference))

    @cached_property
    def knn_table(self) -> DataFrame:
        return self.store.keep("knn_table", self.build_knn_table)
