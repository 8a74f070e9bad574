"""Monthly exports as they arrive.

Each new file is reduced to one row per user and merged into the user table: the newest file wins. A run reads
what has arrived since the last one and stops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.grain import EXPORT_COLUMNS, user_grain_latest_file
from ..sources.files import CORRUPT, CSV_OPTIONS, with_file_period

PERIOD = ("archivo_anio", "archivo_mes")


def export_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A stream over a folder of monthly CSV exports with the period of each file.

    Everything is read as text and cast as in the batch path: a number that cannot be read becomes null and the row
    stays. Records with the wrong number of fields keep their text in ``_corrupt_record``, to be counted.
    """
    as_text = T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema.fields), T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.readStream.options(**CSV_OPTIONS)
        .options(header=True, mode="PERMISSIVE", multiLine=True, columnPruning=False, columnNameOfCorruptRecord=CORRUPT)
        .schema(as_text)
        .csv(folder)
    )
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields if f.dataType != T.StringType()}
    return with_file_period(rows.withColumn("archivo", F.col("_metadata.file_name")).withColumns(typed))


def latest_per_user(rows: DataFrame) -> DataFrame:
    """One row per user with the period of the file it came from."""
    newest = rows.filter("nro_trip = 1 AND social_id IS NOT NULL").groupBy("social_id").agg(
        F.max(F.struct(*PERIOD)).alias("p")
    )
    return user_grain_latest_file(rows).join(newest.select("social_id", "p.*"), "social_id")


def merge_latest(current: DataFrame | None, arrived: DataFrame) -> DataFrame:
    """Both tables by user, newer file first; on equal periods the later arrival."""
    fresh = arrived.withColumn("_turn", F.lit(1))
    both = fresh if current is None else current.withColumn("_turn", F.lit(0)).unionByName(fresh)
    names = [c for c in both.columns if c != "_turn"]
    return (
        both.groupBy("social_id")
        .agg(F.max_by(F.struct(*[c for c in names if c != "social_id"]), F.struct(*PERIOD, "_turn")).alias("row"))
        .select("social_id", "row.*")
        .select(*names)
    )


class UserTable:
    """The user table as numbered versions in one folder; a version is written once and never changed.

    A version's name tells which batch of which intake wrote it. An intake that starts over without its progress goes
    on from the newest version, and repeating a batch replaces only what that batch wrote. All but the last ``keep``
    versions are removed. Counts of dropped records lie beside the versions.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.keep = keep

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, str, str]]:
        """(number, writer, folder) of the versions there are, oldest first."""
        path, system = self._files()
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        parts = [n.removeprefix("version=").split("-", 1) for n in names if n.startswith("version=")]
        return sorted((int(n), writer, f"{self.folder}/version={n}-{writer}") for n, writer in parts)

    def read(self) -> DataFrame:
        """The newest version."""
        return self.spark.read.parquet(self.versions()[-1][2])

    def dropped(self) -> DataFrame:
        """(writer, records) that could not be read, by batch."""
        return self.spark.read.parquet(f"{self.folder}/dropped")

    def upsert(self, arrived: DataFrame, batch: int, intake: str = "0") -> None:
        """Writes the next version from the newest one; repeating a batch gives the same version."""
        writer = f"{intake}-{batch}"
        before = [v for v in self.versions() if v[1] != writer]
        current = self.spark.read.parquet(before[-1][2]) if before else None
        number = before[-1][0] + 1 if before else 0
        if CORRUPT in arrived.columns:
            bad = arrived.agg(F.count(CORRUPT).alias("records")).withColumn("writer", F.lit(writer))
            bad.write.mode("overwrite").parquet(f"{self.folder}/dropped/writer={writer}")
            arrived = arrived.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
        merged = merge_latest(current, latest_per_user(arrived))
        merged.write.mode("overwrite").parquet(f"{self.folder}/version={number}-{writer}")
        _, system = self._files()
        for _, _, old in self.versions()[: -self.keep]:
            system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)


def _intake_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives as long as the progress does."""
    path = f"{checkpoint.rstrip('/')}/intake-name"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([(uuid.uuid4().hex[:12],)], "name string").coalesce(1).write.text(path)
    return spark.read.text(path).first()[0]


def run_intake(stream: DataFrame, table: UserTable, checkpoint: str):
    """Takes in everything that has arrived, then stops; progress is kept in ``checkpoint``."""
    name = _intake_name(table.spark, checkpoint)
    return (
        stream.writeStream.foreachBatch(lambda rows, batch: table.upsert(rows, batch, name))
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/progress")
        .trigger(availableNow=True)
        .start()
    )


EXPORT_NUMBERS = (
    "nro_trip", "gross_bookings_usd", "gross_bookings_usd_2", "duracion_viaje_dias", "dias_anticipacion_compra_checkin",
    "duracion_viaje_dias_2", "dias_anticipacion_compra_2", "flg_uso_cupon", "flg_tarjeta_credito", "flg_transferencia",
    "flg_puntos_loyalty_pago", "flg_uso_cupon_2", "flg_mismo_producto_trip_1_2",
)


def export_schema() -> T.StructType:
    """Columns of an export; amounts and flags as numbers, the rest as text."""
    names = dict.fromkeys(EXPORT_COLUMNS)
    kind = lambda c: T.DoubleType() if c in EXPORT_NUMBERS else T.StringType()
    return T.StructType([T.StructField(c, kind(c)) for c in names])
