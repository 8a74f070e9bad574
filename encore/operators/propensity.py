"""Propensity to buy again: features, split, logistic regression, boosted trees, importance."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import unwrap_udt

from ..functions.aggregates import as_col
from ..functions.ranking import HASH_DIGITS, exact_quantiles, global_row_number, seeded_hash, seeded_sample
from ..functions.text import first_item
from ..session import remove_folder, shared_dir, written
from .bootstrap import bootstrap_fits
from .evaluation import auc_of_counts, grouped_auc
from .targets import leakage_guard

# The model's features by kind.
CATEGORIES = (
    "pais", "purchase_type", "plataforma_principal", "canal_principal", "flight_class_simple", "cohort_year",
    "tipo_viaje", "rango_edad_primer_trip", "income", "bucket_anticipacion_compra", "bucket_duracion_viaje",
)
FLAGS = (
    "flg_uso_cupon", "flg_uso_puntos", "flg_tarjeta_credito", "flg_transferencia", "flg_deposito_bancario",
    "flg_cash", "flg_multi_instrumento_pago", "flg_multi_tipo_pago", "flg_app_90d_antes_trip1", "tiene_vuelo",
)
NUMBERS = (
    "log_gross_bookings", "visitas_app_90d_antes_trip1", "n_transacciones_trip1",
    "antiguedad_usuario_dias_al_trip1",
)
FEATURES = (*CATEGORIES, *FLAGS, *NUMBERS)
COLLAPSED = tuple(c for c in CATEGORIES if c != "cohort_year")
FILLED = (
    "tipo_viaje", "rango_edad_primer_trip", "income", "bucket_anticipacion_compra", "bucket_duracion_viaje",
)
NO_DATA = "Sin dato"
OTHERS = "Otros"
# Stands for a missing category inside the pipelines; it never gets a column of its own.
NO_LEVEL = "(null)"
CUTOFF_MONTH = "2024-08"
ACCOUNT_AGE = "antiguedad_usuario_dias_al_trip1"


# --- features ---------------------------------------------------------------------------------------------------


def account_age_median(rows: DataFrame) -> Column:
    """Exact median account age as one scalar."""
    return exact_quantiles(rows, ACCOUNT_AGE, [0.5]).select("value").scalar()


def feature_columns(rows: DataFrame, median: Column | float | None = None) -> DataFrame:
    """The input rows with every model feature; a given median is used for missing account ages."""
    if median is None:
        median = account_age_median(rows)
    elif not isinstance(median, Column):
        median = F.lit(float(median))
    money = F.greatest(F.coalesce("gross_bookings_usd", F.lit(0.0)), F.lit(0.0))
    return rows.withColumns(
        {
            "plataforma_principal": first_item("plataforma_trip_1"),
            "canal_principal": first_item("canales_compra_trip_1"),
            "flight_class_simple": F.when(F.col("flight_class").isNull(), "Sin vuelo").otherwise(
                F.coalesce(F.nullif(first_item("flight_class"), F.lit("")), F.lit("Otro"))
            ),
            "log_gross_bookings": F.log1p(money),
            "visitas_app_90d_antes_trip1": F.coalesce(F.col("visitas_app_90d_antes_trip1").cast("double"), F.lit(0.0)),
            "n_transacciones_trip1": F.col("n_transacciones_trip1").cast("double"),
            ACCOUNT_AGE: F.coalesce(F.col(ACCOUNT_AGE).cast("double"), median),
            **{c: F.coalesce(c, F.lit(NO_DATA)) for c in FILLED},
            **{c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in FLAGS},
        }
    )


def model_features(view: DataFrame, horizon: int = 18, keys: Sequence[str] = ("social_id", "cohort_month")) -> DataFrame:
    """Features and 0/1 label of the eligible users; refuses any column that could reveal the target."""
    leakage_guard(FEATURES)
    rows = view.filter(F.col(f"eligible_{horizon}m") & F.col("n_transacciones_trip1").isNotNull())
    label = F.col(f"rebuy_{horizon}m").cast("int").alias("label")
    return feature_columns(rows).select(*keys, *FEATURES, label)


#: Most category levels that are sent by broadcast or held by the driver.
MOST_LEVELS = 100_000


def collapse_rare(rows: DataFrame, columns: Sequence[str] = COLLAPSED, min_count: int = 1000) -> DataFrame:
    """Values with fewer than ``min_count`` rows become 'Otros'; nulls stay null.

    The kept values are written and counted. They are joined by broadcast while they are few; beyond that the joins are
    left to adaptive execution.
    """
    entries = [F.struct(F.lit(c).alias("columna"), F.col(c).alias("valor")) for c in columns]
    counts = (
        rows.select(F.explode(F.array(*entries)).alias("e"))
        .filter("e.valor IS NOT NULL")
        .groupBy("e.columna", "e.valor")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )
    kept = written(counts.select("columna", "valor"), "levels")
    few = kept.count() <= MOST_LEVELS
    names = rows.columns
    for i, c in enumerate(columns):
        known = kept.filter(F.col("columna") == c).select(F.col("valor").alias(f"_kept{i}"))
        rows = rows.join(F.broadcast(known) if few else known, F.col(c) == F.col(f"_kept{i}"), "left")
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.col(c)).otherwise(F.coalesce(f"_kept{i}", F.lit(OTHERS)))).select(*names)
    return rows


def temporal_split(rows: DataFrame, cutoff: str = CUTOFF_MONTH) -> tuple[DataFrame, DataFrame]:
    """Train on cohorts before the cut-off month, test on the rest."""
    before = F.col("cohort_month") < cutoff
    return rows.filter(before), rows.filter(~before)


def train_sample(train: DataFrame, n: int = 1_500_000, seed: int = 42) -> DataFrame:
    return seeded_sample(train, n, "social_id", seed)


# --- design matrix ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Design:
    """A fitted design: the pipeline that makes the ``features`` vector, and the name of each position."""

    model: PipelineModel
    names: tuple[str, ...]


def number_stats(rows: DataFrame, numbers: Sequence[str] = NUMBERS) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 if zero) of each number, in one aggregate."""
    stats = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in numbers], *[F.stddev_pop(c).alias(f"s_{c}") for c in numbers]
    ).first()
    return {c: (stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 1.0) for c in numbers}


def design_matrix(
    rows: DataFrame,
    categories: Sequence[str] = CATEGORIES,
    flags: Sequence[str] = FLAGS,
    numbers: Sequence[str] = NUMBERS,
) -> Design:
    """One-hot categories without their first level, flags as they are, numbers scaled by population deviation.

    Levels are indexed in descending order so that the alphabetical first sits last and can be sliced off;
    levels not seen here become all zeros.
    """
    stats = number_stats(rows, numbers)
    scaled = ", ".join(f"(`{c}` - {m!r}D) / {s!r}D AS `{c}_z`" for c, (m, s) in stats.items())
    if not categories:
        inputs = [*flags, *[f"{c}_z" for c in numbers]]
        plain = [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"), VectorAssembler(inputCols=inputs, outputCol="features")]
        return Design(Pipeline(stages=plain).fit(rows), (*flags, *numbers))
    present = [F.coalesce(c, F.lit(NO_LEVEL)).alias(c) for c in categories]
    indexer = StringIndexer(
        inputCols=list(categories),
        outputCols=[f"{c}_i" for c in categories],
        stringOrderType="alphabetDesc",
        handleInvalid="keep",
    ).fit(rows.select(*present))
    encoder = OneHotEncoder(
        inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_o" for c in categories], dropLast=True
    )
    stages: list = [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")]
    fill = ", ".join(f"coalesce(`{c}`, '{NO_LEVEL}') AS `{c}`" for c in categories)
    others = f"* EXCEPT ({', '.join(f'`{c}`' for c in categories)})"
    stages += [SQLTransformer(statement=f"SELECT {others}, {fill} FROM __THIS__"), indexer, encoder]
    inputs, names = [], []
    for c, labels in zip(categories, indexer.labelsArray):
        kept = [v for v in labels if v != NO_LEVEL][:-1]
        positions = [list(labels).index(v) for v in kept]
        if not kept:
            continue
        stages.append(VectorSlicer(inputCol=f"{c}_o", outputCol=f"{c}_v", indices=positions))
        inputs.append(f"{c}_v")
        names += [f"{c}_{v}" for v in kept]
    inputs += [*flags, *[f"{c}_z" for c in numbers]]
    names += [*flags, *numbers]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Design(Pipeline(stages=stages).fit(rows), tuple(names))


def design_rows(design: Design, rows: DataFrame, key: str = "social_id") -> DataFrame:
    """The non-zero cells of the design in long form (key, feature, value)."""
    x = unwrap_udt(F.col("features"))
    sparse = F.arrays_zip(x["indices"].alias("i"), x["values"].alias("value"))
    dense = F.transform(x["values"], lambda v, i: F.struct(i.alias("i"), v.alias("value")))
    cells = design.model.transform(rows).select(key, F.explode(F.when(x["type"] == 0, sparse).otherwise(dense)).alias("c"))
    names = F.array(*[F.lit(n) for n in design.names])
    return cells.filter("c.value <> 0").select(key, F.get(names, F.col("c.i")).alias("feature"), "c.value")


# --- logistic regression ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Logistic:
    design: Design
    model: object
    coefficients: dict[str, float]
    intercept: float


def _fitted(rows: DataFrame, c: float, max_iter: int):
    """The fit over rows that hold ``features`` and ``label``."""
    return LogisticRegression(
        regParam=1.0 / (c * rows.count()),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-9,
        family="binomial",
    ).fit(rows)


def _matrix(design: Design, rows: DataFrame, *keys: str) -> DataFrame:
    return design.model.transform(rows).select(*keys, "features", F.col("label").cast("double").alias("label"))


def fit_rows(design: Design, rows: DataFrame) -> DataFrame:
    """(social_id, features, label) as the fits take them."""
    return _matrix(design, rows, "social_id")


def logistic_l2(train: DataFrame, c: float = 1.0, max_iter: int = 200, design: Design | None = None) -> Logistic:
    """L2 logistic regression with the penalty of inverse strength ``c`` on the summed loss."""
    design = design or design_matrix(train)
    rows = _matrix(design, train).persist()
    try:
        fit = _fitted(rows, c, max_iter)
    finally:
        rows.unpersist()
    names = dict(zip(design.names, (float(v) for v in fit.coefficients.toArray())))
    return Logistic(design, fit, names, float(fit.intercept))


def logistic_gradient(fit: Logistic, train: DataFrame, c: float = 1.0) -> DataFrame:
    """Slope of the penalised loss for each feature: zero at the optimum."""
    scored = fit.model.transform(_matrix(fit.design, train, "social_id"))
    rest = scored.select("social_id", (vector_to_array("probability")[1] - F.col("label")).alias("rest"))
    pulls = design_rows(fit.design, train).join(rest, "social_id").groupBy("feature").agg(F.sum(F.col("value") * F.col("rest")).alias("pull"))
    betas = odds_ratios(train.sparkSession, fit)
    return betas.join(pulls, "feature", "left").select(
        "feature", (F.coalesce("pull", F.lit(0.0)) + F.col("coef") / c).alias("gradient")
    )


def odds_ratios(spark: SparkSession, fit: Logistic) -> DataFrame:
    rows = [(name, beta) for name, beta in fit.coefficients.items()]
    return spark.createDataFrame(rows, "feature string, coef double").withColumn("odds_ratio", F.exp("coef"))


def bootstrap_samples(ids: DataFrame, n: int, size: int, first_seed: int = 1000) -> DataFrame:
    """(muestra, social_id): ``n`` samples of ``size`` users without replacement."""
    parts = [
        seeded_sample(ids.select("social_id"), size, "social_id", first_seed + i).withColumn("muestra", F.lit(i)) for i in range(n)
    ]
    return reduce(DataFrame.unionByName, parts).select("muestra", "social_id")


def bootstrap_interval(fits: DataFrame, n: int) -> DataFrame:
    """Percentile interval of each odds ratio over the drawn (muestra, feature, beta), with a sign-crossing p-value."""
    ends = F.percentile("beta", F.array(F.lit(0.025), F.lit(0.975)))
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    crossing = 2 * F.least(share(F.col("beta") > 0), share(F.col("beta") < 0))
    return fits.groupBy("feature").agg(
        F.exp(ends[0]).alias("or_low"),
        F.exp(ends[1]).alias("or_high"),
        F.least(F.lit(1.0), F.greatest(crossing, F.lit(1.0 / n))).alias("p_value"),
    )


def bootstrap_ci(
    train: DataFrame,
    point: Logistic,
    n: int = 100,
    size: int | None = None,
    replacement: bool | None = None,
    first_seed: int = 1000,
    c: float = 1.0,
) -> DataFrame:
    """Each coefficient and odds ratio with its interval over repeated fits.

    By default a true bootstrap: every draw is as large as the table, with replacement. With a ``size`` rows are drawn without
    replacement unless asked for, the rows of ``bootstrap_samples``. All fits share their scans, see :mod:`.bootstrap`.
    """
    replacement = size is None if replacement is None else replacement
    fits = bootstrap_fits(fit_rows(point.design, train), point.design.names, n, size, replacement, first_seed, c)
    table = odds_ratios(train.sparkSession, point).withColumnRenamed("odds_ratio", "or")
    return table.join(F.broadcast(bootstrap_interval(fits, n)), "feature").orderBy(F.desc("or"), "feature")


def logistic_terms(coefficients: Mapping[str, float], scaling: Mapping[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """What each column adds to the log-odds.

    A name is a numeric column or ``column=level``; ``scaling`` gives mean and deviation of scaled columns.
    """
    scaling = scaling or {}
    terms: dict[str, Column] = {}
    for name, beta in coefficients.items():
        column, _, level = name.partition("=")
        if level:
            term = F.when(F.col(column) == level, float(beta)).otherwise(0.0)
        else:
            value = F.col(name).cast("double")
            if name in scaling:
                mean, deviation = scaling[name]
                value = (value - mean) / deviation
            term = value * float(beta)
        terms[column] = terms[column] + term if column in terms else term
    return terms


def logistic_score(
    coefficients: Mapping[str, float],
    intercept: float,
    scaling: Mapping[str, tuple[float, float]] | None = None,
) -> Column:
    """Probability from given coefficients as one column expression, see :func:`logistic_terms`."""
    total = F.lit(float(intercept))
    for term in logistic_terms(coefficients, scaling).values():
        total = total + term
    return 1 / (1 + F.exp(-total))


@dataclass(frozen=True)
class Additive:
    """A scorer whose log-odds are a sum of one term per column; scores are rounded to ``places``."""

    coefficients: Mapping[str, float]
    intercept: float
    scaling: Mapping[str, tuple[float, float]] | None = None
    places: int = 4

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", F.bround(logistic_score(self.coefficients, self.intercept, self.scaling), self.places))


# --- boosted trees ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Booster:
    """A fitted pipeline with the side data that scoring needs."""

    model: PipelineModel
    median_account_age: float
    levels: dict[str, list[str]]
    importance: dict[str, float] = field(default_factory=dict)


#: Bins of a number in the trees.
BINS = 32
#: Spark looks for thresholds among ``maxBins`` squared rows; beyond this many bins that number is no longer an int.
MOST_BINS = 46_340


def bin_edges(rows: DataFrame, numbers: Sequence[str] = NUMBERS, bins: int = BINS) -> dict[str, list[float]]:
    """Inner edges of at most ``bins`` bins of each number, from all rows: every value if they are few, else exact quantiles."""
    entries = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("number")) for c in numbers]
    long = rows.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter(F.col("number").isNotNull() & ~F.isnan("number"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("number"))
    few = long.distinct().withColumn("rank", rank).filter(F.col("rank") <= bins + 1).collect()
    values = {c: sorted(r["number"] for r in few if r["name"] == c) for c in numbers}
    many = [c for c in numbers if len(values[c]) > bins]
    edges = {c: values[c][1:] for c in numbers if c not in many}
    if many:
        cuts = exact_quantiles(long.filter(F.col("name").isin(many)), "number", [i / bins for i in range(1, bins)], ["name"]).collect()
        edges |= {c: sorted({r["value"] for r in cuts if r["name"] == c}) for c in many}
    return edges


def boosted_trees(
    train: DataFrame,
    max_depth: int = 6,
    max_iter: int = 200,
    step: float = 0.08,
    validation_share: float = 0.1,
    seed: int = 42,
) -> Booster:
    """Gradient-boosted trees on indexed categories and binned numbers, stopping early on a held-out share.

    All rows of ``train`` are fitted or held out. Edges of the bins come from all of them too, and ``maxBins`` is large enough for
    Spark to look for thresholds in every row: a feature has no more bins than levels or edges whatever it is.
    """
    rows = train
    share = F.conv(F.substring(seeded_hash("social_id", seed + 1), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("validation", share < validation_share).withColumn("label", F.col("label").cast("double"))
    indexer = StringIndexer(
        inputCols=list(CATEGORIES), outputCols=[f"{c}_i" for c in CATEGORIES], handleInvalid="keep"
    ).fit(rows.select(*CATEGORIES).na.fill(NO_LEVEL))
    edges = bin_edges(rows)
    binner = Bucketizer(
        inputCols=list(NUMBERS),
        outputCols=[f"{c}_b" for c in NUMBERS],
        splitsArray=[[-math.inf, *(edges[c] or [0.0]), math.inf] for c in NUMBERS],
    )
    # A bucket comes labelled as a category; a plain number keeps its order in the trees.
    ordered = SQLTransformer(statement=f"SELECT *, {', '.join(f'`{c}_b` + 0D AS `{c}_n`' for c in NUMBERS)} FROM __THIS__")
    assembler = VectorAssembler(
        inputCols=[*[f"{c}_i" for c in CATEGORIES], *FLAGS, *[f"{c}_n" for c in NUMBERS]], outputCol="features"
    )
    widest = max(len(labels) for labels in indexer.labelsArray) + 1
    every = min(MOST_BINS, math.isqrt(rows.count()) + 1)
    trees = GBTClassifier(
        maxDepth=max_depth,
        maxIter=max_iter,
        stepSize=step,
        validationIndicatorCol="validation",
        maxBins=max(BINS, widest, every),
        seed=seed,
    )
    prepared = Pipeline(stages=[indexer, binner, ordered, assembler]).fit(rows)
    matrix = prepared.transform(rows).select("features", "label", "validation").persist()
    try:
        fitted = trees.fit(matrix)
    finally:
        matrix.unpersist()
    levels = {c: [v for v in labels if v != NO_LEVEL] for c, labels in zip(CATEGORIES, indexer.labelsArray)}
    median = exact_quantiles(rows, ACCOUNT_AGE, [0.5]).first()
    return Booster(PipelineModel(stages=[*prepared.stages, fitted]), float(median["value"]) if median else 0.0, levels)


def _filled(rows: DataFrame) -> DataFrame:
    return rows.na.fill(NO_LEVEL, list(CATEGORIES))


def predict(model: PipelineModel, rows: DataFrame, name: str = "score") -> DataFrame:
    """The rows with the model's probability of buying again."""
    filled = _filled(rows)
    scored = model.transform(filled).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*rows.columns, name)


Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Trees:
    """Nodes of fitted trees as arrays, one row a tree: for rows of the model's features, what each tree says."""

    feature: np.ndarray
    threshold: np.ndarray
    level: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    lefts: np.ndarray
    weights: np.ndarray

    def outputs(self, x: np.ndarray, trees: Sequence[int]) -> np.ndarray:
        """One column for each of ``trees``."""
        out, rows = np.empty((len(x), len(trees))), np.arange(len(x))
        for column, t in enumerate(trees):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, at]
                if (f < 0).all():
                    break
                v = x[rows, np.maximum(f, 0)]
                kind = self.level[t, at]
                # Leaves lead to themselves.
                goes = np.where(kind < 0, v <= self.threshold[t, at], self.lefts[np.maximum(kind, 0), np.where(kind < 0, 0, v).astype(np.int64)])
                at = np.where(goes, self.left[t, at], self.right[t, at])
            out[:, column] = self.value[t, at]
        return out

    def scores(self, outputs: np.ndarray) -> np.ndarray:
        """Probabilities from the outputs of all trees, added in one order so that equal outputs give equal scores."""
        margin = np.zeros(len(outputs))
        for t, weight in enumerate(self.weights):
            margin += weight * outputs[:, t]
        return 1 / (1 + np.exp(-2 * margin))


def trees_of(spark: SparkSession, model: GBTClassificationModel) -> Trees:
    """The nodes of all trees, as the saved model lists them: bounded by depth and rounds."""
    folder = f"{shared_dir(spark)}/encore-tables/trees-{uuid.uuid4().hex[:12]}"
    model.write().save(folder)
    nodes = [(r["treeID"], r["nodeData"]) for r in spark.read.parquet(f"{folder}/data").collect()]
    remove_folder(spark, folder)
    weights = np.array(model.treeWeights)
    shape = (len(weights), max(n["id"] for _, n in nodes) + 1)
    feature, level = np.full(shape, -1), np.full(shape, -1)
    threshold, value = np.zeros(shape), np.zeros(shape)
    left, right = np.tile(np.arange(shape[1]), (shape[0], 1)), np.tile(np.arange(shape[1]), (shape[0], 1))
    sets, widest = [], max([1, *[n["split"]["numCategories"] for _, n in nodes]])
    for t, n in nodes:
        i, split = n["id"], n["split"]
        value[t, i] = n["prediction"]
        if n["leftChild"] < 0:
            continue
        feature[t, i], left[t, i], right[t, i] = split["featureIndex"], n["leftChild"], n["rightChild"]
        if split["numCategories"] < 0:
            threshold[t, i] = split["leftCategoriesOrThreshold"][0]
        else:
            level[t, i] = len(sets)
            sets.append(np.isin(np.arange(widest), np.array(split["leftCategoriesOrThreshold"])))
    return Trees(feature, threshold, level, left, right, value, np.array(sets or [np.zeros(widest, bool)]), weights)


@dataclass(frozen=True)
class Fitted:
    """A fitted model as a function that adds ``score``; any such function can be examined below."""

    model: PipelineModel

    def __call__(self, rows: DataFrame) -> DataFrame:
        return predict(self.model, rows)


def scorer(model: PipelineModel) -> Scorer:
    return Fitted(model)


def _places(rows: DataFrame, seed: int, turn: int, name: str) -> DataFrame:
    """Row numbers by a seeded hash, counted over hash buckets so that no task orders all rows."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), F.col("social_id")).cast("binary"))
    hashed = rows.withColumn("_mark", mark)
    return global_row_number(hashed, ["_mark", "social_id"], F.substring("_mark", 1, HASH_DIGITS), name).drop("_mark")


def _lent(rows: DataFrame, own: Column, repeats: int, seed: int) -> DataFrame:
    """(label, own, lent): each row's array and, one after another, those of its donors of all repeats."""
    placed = _places(rows.select("social_id", F.col("label").cast("int").alias("label"), own.alias("own")), seed, 0, "_place")
    lent = [_places(rows.select("social_id", own.alias("lent")), seed, r, "_place").select("_place", "lent", F.lit(r).alias("r")) for r in range(1, repeats + 1)]
    donors = reduce(DataFrame.unionByName, lent).groupBy("_place").agg(F.array_sort(F.collect_list(F.struct("r", "lent")))["lent"].alias("lent"))
    # Terms repeat and shrink to little when shuffled, so adaptive execution would take millions of rows for few and broadcast them.
    return placed.join(donors.hint("merge"), "_place").select("label", "own", F.flatten("lent").alias("lent"))


def _shuffled_counts(score: Additive, rows: DataFrame, features: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """(feature, _repeat, _score, pos, neg): rows by score when a feature's term comes from the donor of a repeat.

    Only terms move, one array a row and repeat; what is shuffled after that is one row per distinct score and task.
    """
    terms = logistic_terms(score.coefficients, score.scaling)
    moving = [c for c in features if c in terms]
    fixed = sum((t for c, t in terms.items() if c not in moving), F.lit(float(score.intercept)))
    own = F.array(*[terms[c].cast("double") for c in moving], fixed)
    pairs = _lent(rows, own, repeats, seed)
    width, grid, places = len(moving) + 1, 10**score.places, score.places

    def count(batches):
        seen = np.zeros((len(features), repeats, 2, grid + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            mine = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            theirs = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, repeats, width)
            total = mine.sum(axis=1)
            for i, name in enumerate(features):
                for r in range(repeats):
                    odds = total if name not in moving else total - mine[:, moving.index(name)] + theirs[:, r, moving.index(name)]
                    code = np.rint(np.round(1 / (1 + np.exp(-odds)), places) * grid).astype(np.int64)
                    seen[i, r] += np.bincount(label * (grid + 1) + code, minlength=2 * (grid + 1)).reshape(2, grid + 1)
        i, r, code = np.nonzero(seen.sum(axis=2))
        names = pa.array(list(features)).take(pa.array(i))
        cells = [pa.array((r + 1).astype(np.int32)), pa.array(code), pa.array(seen[i, r, 1, code]), pa.array(seen[i, r, 0, code])]
        yield pa.RecordBatch.from_arrays([names, *cells], ["feature", "_repeat", "code", "pos", "neg"])

    counted = pairs.mapInArrow(count, "feature string, _repeat int, code long, pos long, neg long")
    return counted.groupBy("feature", "_repeat", (F.col("code") / grid).alias("_score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


#: Rows whose scores a task counts before it passes the counts on, and rows of a set of scores that one task ranks, about.
COUNTED_ROWS = 50_000
RANKED_ROWS = 2_000_000


def _ranked(table: pa.Table) -> pa.Table:
    """Of one set of scores and one range of them: positives, negatives, and how often a positive is above a negative, ties half."""
    blobs = table.column("data").to_pylist()
    value = np.concatenate([np.frombuffer(b, "<f8", len(b) // 16) for b in blobs])
    pos, neg = (np.concatenate([np.frombuffer(b, "<u4", len(b) // 16, len(b) // 16 * at) for b in blobs]).astype(np.int64) for at in (8, 12))
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    pos, neg = np.add.reduceat(pos[order], first), np.add.reduceat(neg[order], first)
    wins = float((pos * (np.cumsum(neg) - neg + neg / 2)).sum())
    sums = [pa.array([int(x)]) for x in (pos.sum(), neg.sum())]
    return pa.table([table.column("turn")[:1], table.column("part")[:1], *sums, pa.array([wins])], ["turn", "part", "pos", "neg", "wins"])


def _tree_areas(score: Fitted, rows: DataFrame, features: Sequence[str], repeats: int, seed: int) -> dict[tuple[str, int], float | None]:
    """ROC-AUC by feature and repeat (from 1) when a feature comes from the donor, and of the plain scores under ("", 0).

    A row meets its donors once. Trees are walked in numpy, for a feature only those that ask for it; one that no tree asks for changes
    nothing and is left out. Scores are packed by range; what reaches the driver is a row for each set of scores and range.
    """
    model, trees = score.model, trees_of(rows.sparkSession, score.model.stages[-1])
    prepared = PipelineModel(stages=model.stages[:-1]).transform(_filled(rows))
    names = [*CATEGORIES, *FLAGS, *NUMBERS]
    asks = {c: np.flatnonzero((trees.feature == names.index(c)).any(axis=1)).tolist() for c in features if c in names}
    turns = [("", 0), *[(c, r) for c, t in asks.items() if t for r in range(1, repeats + 1)]]
    pairs = _lent(prepared, vector_to_array("features"), repeats, seed)
    width, every = len(names), list(range(len(trees.weights)))
    parts = -(-rows.count() // RANKED_ROWS)
    cuts = [] if parts < 2 else exact_quantiles(score(rows), "score", [i / parts for i in range(1, parts)]).select("value").collect()
    edges = np.unique([r["value"] for r in cuts])

    def counted(held):
        label, x, lent = (np.concatenate(p) for p in zip(*held, strict=True))
        plain = trees.outputs(x, every)
        for turn, (name, r) in enumerate(turns):
            said = plain
            if name:
                i, own = names.index(name), asks[name]
                shuffled, said = x.copy(), plain.copy()
                shuffled[:, i] = lent[:, r - 1, i]
                said[:, own] = trees.outputs(shuffled, own)
            value, back = np.unique(trees.scores(said), return_inverse=True)
            pos, n = np.bincount(back, label, len(value)).astype("<u4"), np.bincount(back, minlength=len(value)).astype("<u4")
            ends = [0, *np.searchsorted(value, edges).tolist(), len(value)]
            for part, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
                if high > low:
                    own = slice(low, high)
                    yield turn, part, b"".join([value[own].astype("<f8").tobytes(), pos[own].tobytes(), (n - pos)[own].tobytes()])

    def batched(cells):
        for turn, part, data in cells:
            yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["turn", "part", "data"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            lent = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, repeats, width)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), x, lent))
            size += batch.num_rows
            if size >= COUNTED_ROWS:
                yield from batched(counted(held))
                held, size = [], 0
        if held:
            yield from batched(counted(held))

    packed = pairs.mapInArrow(count, "turn int, part int, data binary")
    found = packed.groupBy("turn", "part").applyInArrow(_ranked, "turn int, part int, pos long, neg long, wins double").collect()
    areas = {}
    for turn, key in enumerate(turns):
        own = sorted((r["part"], r["pos"], r["neg"], r["wins"]) for r in found if r["turn"] == turn)
        wins, below = 0.0, 0
        for _, pos, neg, inside in own:
            wins += inside + pos * below
            below += neg
        total = sum(r[1] for r in own) * below
        areas[key] = wins / total if total else None
    return areas


def permutation_importance(
    score: Scorer, test: DataFrame, features: Sequence[str] = FEATURES, repeats: int = 5, seed: int = 42
) -> DataFrame:
    """Mean fall in ROC-AUC when one column is shuffled over all test rows, floored at zero.

    Each repeat pairs every row with another one by the order of their hashes. For an :class:`Additive` scorer and for boosted trees
    no row is copied: a row carries the terms or features of its donors, and tasks count scores.
    """
    if isinstance(score, Fitted) and isinstance(score.model.stages[-1], GBTClassificationModel) and set(FEATURES) <= set(test.columns):
        areas = _tree_areas(score, test.select("social_id", "label", *FEATURES), features, repeats, seed)
        plain, falls = areas["", 0], []
        for c in features:
            shuffled = [areas.get((c, r), plain) for r in range(1, repeats + 1)]
            falls.append((c, 0.0 if plain is None else max(0.0, plain - sum(shuffled) / repeats)))
        return test.sparkSession.createDataFrame(falls, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    rows = test.select("social_id", "label", *features)
    if isinstance(score, Additive):
        reference = grouped_auc(score(rows).withColumn("feature", F.lit("none")), ["feature"]).select("roc_auc").scalar()
        return _falls(auc_of_counts(_shuffled_counts(score, rows, features, repeats, seed), ["feature", "_repeat"]), reference)
    own = _places(rows, seed, 0, "_place")
    donors = [
        _places(rows.select("social_id", *[F.col(c).alias(f"{c}__d") for c in features]), seed, turn, "_place")
        .drop("social_id")
        .withColumn("_repeat", F.lit(turn))
        for turn in range(1, repeats + 1)
    ]
    pairs = own.join(reduce(DataFrame.unionByName, donors).hint("merge"), "_place")
    each = pairs.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in features])))
    shuffled = each.select(
        "feature",
        "_repeat",
        "social_id",
        "label",
        *[F.when(F.col("feature") == c, F.col(f"{c}__d")).otherwise(F.col(c)).alias(c) for c in features],
    )
    base = rows.withColumns({"feature": F.lit("none"), "_repeat": F.lit(0)})
    worse = grouped_auc(score(shuffled), ["feature", "_repeat"])
    reference = grouped_auc(score(base), ["feature"]).select("roc_auc").scalar()
    return _falls(worse, reference)


def _falls(worse: DataFrame, reference: Column) -> DataFrame:
    return (
        worse.groupBy("feature")
        .agg(F.avg("roc_auc").alias("shuffled"))
        .select("feature", F.greatest(F.lit(0.0), reference - F.col("shuffled")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def grid_values(rows: DataFrame, column: str, resolution: int = 30) -> list[float]:
    """All values of a column if they are few, else equal steps between its 5th and 95th percentile."""
    distinct = rows.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").distinct()
    few = [r["v"] for r in distinct.limit(resolution).collect()]
    if len(few) < resolution:
        return sorted(few)
    ends = {r["probability"]: r["value"] for r in exact_quantiles(rows, column, [0.05, 0.95]).collect()}
    low, high = ends[0.05], ends[0.95]
    return [low + (high - low) * i / (resolution - 1) for i in range(resolution)]


def partial_dependence(score: Scorer, rows: DataFrame, column: str, resolution: int = 30) -> DataFrame:
    """Mean score of all rows with one column fixed at each grid value."""
    grid = grid_values(rows, column, resolution)
    fixed = rows.withColumn(column, F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    return (
        score(fixed)
        .groupBy(as_col(column).alias("grid"))
        .agg(F.avg("score").alias("avg_pred"))
        .select(F.lit(column).alias("feature"), "grid", "avg_pred")
        .orderBy("grid")
    )


def category_levels(rows: DataFrame, categories: Sequence[str] = CATEGORIES) -> dict[str, list[str]]:
    """Levels of each category. More than ``MOST_LEVELS`` in all are refused: collapse rare ones first."""
    entries = [F.struct(F.lit(c).alias("columna"), F.col(c).alias("valor")) for c in categories]
    found = rows.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter("valor IS NOT NULL").distinct()
    levels: dict[str, list[str]] = {c: [] for c in categories}
    listed = found.limit(MOST_LEVELS + 1).collect()
    if len(listed) > MOST_LEVELS:
        raise ValueError("too many category levels; call collapse_rare first")
    for row in listed:
        levels[row["columna"]].append(row["valor"])
    return {c: sorted(values) for c, values in levels.items()}


def model_bundle(train: DataFrame, test: DataFrame, repeats: int = 5, **settings) -> Booster:
    """Boosted trees with their levels, median and the permutation importance that ranks the levers."""
    booster = boosted_trees(train, **settings)
    found = permutation_importance(scorer(booster.model), test, repeats=repeats).collect()
    return replace(booster, importance={row["feature"]: row["importance"] for row in found})


def save_model(spark: SparkSession, booster: Booster, path: str) -> None:
    """The pipeline, and a small table with levels, importance and the training median."""
    booster.model.write().overwrite().save(f"{path}/model")
    rows = [("level", c, v, None) for c, values in booster.levels.items() for v in values]
    rows += [("importance", c, None, float(v)) for c, v in booster.importance.items()]
    rows.append(("median", ACCOUNT_AGE, None, booster.median_account_age))
    spark.createDataFrame(rows, "kind string, name string, text string, number double").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/side")


def load_model(spark: SparkSession, path: str) -> Booster:
    side = spark.read.parquet(f"{path}/side").collect()
    levels: dict[str, list[str]] = {c: [] for c in CATEGORIES}
    for row in side:
        if row["kind"] == "level":
            levels[row["name"]].append(row["text"])
    importance = {r["name"]: r["number"] for r in side if r["kind"] == "importance"}
    median = next(r["number"] for r in side if r["kind"] == "median")
    return Booster(PipelineModel.load(f"{path}/model"), median, levels, importance)
