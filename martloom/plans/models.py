"""Model competitions on MLlib: fit on TRAIN, choose on VALIDATION, report on TEST."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martloom.config import SplitDates
from martloom.functions.dates import split_label
from martloom.functions.numeric import finite, fixed, ratio
from martloom.plans.features import CHURN_FEATURES, DEMAND_FEATURES, WASTE_LAG_FEATURES
from martloom.sources.staging import stage

SEED = 42
# fixed values: segment names, best first
SEGMENTS = ("Champions", "Loyal", "At Risk", "Lost")


@dataclass(frozen=True)
class Candidate:
    name: str
    estimator: Estimator | OneClassEstimator
    settings: dict[str, float]


@dataclass(frozen=True)
class Entry:
    name: str
    settings: dict[str, float]
    validation: dict[str, float]
    seconds: float
    model: Model | OneClass


@dataclass(frozen=True)
class Verdict:
    """The champion, every candidate's validation scores and the champion's test scores."""

    champion: Entry
    entries: list[Entry]
    test: dict[str, float]
    predictions: DataFrame = field(repr=False)

    def metadata(self, spark: SparkSession, task: str) -> DataFrame:
        """One row per candidate."""
        rows = [
            (
                task,
                e.name,
                e is self.champion,
                {k: float(v) for k, v in e.settings.items()},
                {k: float(v) for k, v in e.validation.items()},
                {k: float(v) for k, v in self.test.items()} if e is self.champion else None,
                e.seconds,
            )
            for e in self.entries
        ]
        return spark.createDataFrame(
            rows,
            "task string, algorithm string, is_champion boolean, hyperparameters map<string,double>, "
            "validation_metrics map<string,double>, test_metrics map<string,double>, "
            "training_duration_sec double",
        )


Scorer = Callable[[DataFrame], dict[str, float]]


def best(entries: list[Entry], metric: str, tie: str, larger: bool) -> Entry:
    """First by the metric, then by the tie metric, then in the given order."""
    sign = -1.0 if larger else 1.0
    return min(entries, key=lambda e: (sign * e.validation[metric], sign * e.validation.get(tie, 0)))


def tournament(
    candidates: list[Candidate],
    prepared: DataFrame,
    score: Scorer,
    *,
    metric: str,
    tie: str,
    larger: bool,
) -> Verdict:
    """`prepared` holds features, label and split; it should be a stored table."""
    parts = {s: prepared.filter(F.col("split") == s) for s in ("TRAIN", "VALIDATION", "TEST")}
    entries = []
    for c in candidates:
        started = time.monotonic()
        model = c.estimator.fit(parts["TRAIN"])
        seconds = round(time.monotonic() - started, 2)
        scores = score(model.transform(parts["VALIDATION"]))
        entries.append(Entry(c.name, c.settings, scores, seconds, model))
    champion = best(entries, metric, tie, larger)
    return Verdict(
        champion,
        entries,
        score(champion.model.transform(parts["TEST"])),
        champion.model.transform(prepared),
    )


PRIOR_ROWS = 20.0
"""How many rows of the overall mean are added to every category's own."""


def _category_means(typed: DataFrame, train: DataFrame, category: str, label: str, overall: float) -> DataFrame:
    """Add the category's mean label in TRAIN, drawn to the overall one; unseen ones get that."""
    own = train.groupBy(F.col(category).alias("_category")).agg(
        ((F.sum(F.col(label).cast("double")) + PRIOR_ROWS * overall) / (F.count(label) + PRIOR_ROWS)).alias("_mean")
    )
    joined = typed.join(own, F.col(category).eqNullSafe(F.col("_category")), "left")
    mean = F.coalesce("_mean", F.lit(overall))
    return joined.withColumn(f"{category}_mean", mean).drop("_category", "_mean")


def prepare(features: DataFrame, numeric: list[str], categories: list[str], label: str) -> DataFrame:
    """Encode categories, fill gaps, assemble and store; every row is kept.

    A category becomes the mean label of its TRAIN rows, so any number of categories is one
    column. A missing number becomes its TRAIN mean, or 0 where TRAIN has none.
    """
    train = features.filter(F.col("split") == "TRAIN")
    means = train.agg(
        F.avg(F.col(label).cast("double")).alias("_label"),
        *[F.avg(finite(F.col(c).cast("double"))).alias(c) for c in numeric],
    ).first()
    typed = features.withColumns(
        {c: F.coalesce(finite(F.col(c).cast("double")), F.lit(float(means[c] or 0.0))) for c in numeric}
    )
    for category in categories:
        typed = _category_means(typed, train, category, label, float(means["_label"] or 0.0))
    encoded = [f"{c}_mean" for c in categories]
    assembler = VectorAssembler(inputCols=[*numeric, *encoded], outputCol="features", handleInvalid="error")
    return stage(assembler.transform(typed).drop(*encoded), "features")


def regression_scores(label: str) -> Scorer:
    """RMSE, MAE, R2 and MAPE (rows with a zero label left out) in one aggregate."""
    error = F.col("prediction") - F.col(label)

    def score(df: DataFrame) -> dict[str, float]:
        row = df.agg(
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(F.abs(error)).alias("mae"),
            (F.lit(1.0) - ratio(F.sum(error * error), F.var_pop(label) * F.count(label))).alias("r2"),
            F.avg(F.abs(ratio(error, F.col(label)))).alias("mape"),
        ).first()
        return {k: round(float(v), 6) for k, v in row.asDict().items() if v is not None}

    return score


def classification_scores(label: str) -> Scorer:
    """ROC-AUC, and F1, precision, recall and accuracy weighted by class from one confusion matrix."""

    def score(df: DataFrame) -> dict[str, float]:
        scored = df.select(label, "rawPrediction", "prediction")
        auc = BinaryClassificationEvaluator(
            labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderROC"
        ).evaluate(scored)
        cells = {
            (float(r[0]), float(r[1])): r[2]
            for r in scored.groupBy(label, "prediction").agg(F.count(F.lit(1))).collect()
        }
        return {"roc_auc": round(auc, 6), **weighted_scores(cells)}

    return score


def weighted_scores(cells: dict[tuple[float, float], int]) -> dict[str, float]:
    """Scores from counts per (label, prediction)."""
    total = sum(cells.values())
    out = {"f1": 0.0, "precision": 0.0, "recall": 0.0}
    for c in {label for label, _ in cells}:
        hit = cells.get((c, c), 0)
        held = sum(n for (label, _), n in cells.items() if label == c)
        called = sum(n for (_, predicted), n in cells.items() if predicted == c)
        precision, recall = hit / called if called else 0.0, hit / held
        f1 = 2 * precision * recall / (precision + recall) if hit else 0.0
        for name, value in (("f1", f1), ("precision", precision), ("recall", recall)):
            out[name] += value * held / total
    out["accuracy"] = sum(n for (label, predicted), n in cells.items() if label == predicted) / max(total, 1)
    return {name: round(value, 6) for name, value in out.items()}


def regressors(label: str) -> list[Candidate]:
    # fixed values: the candidates' settings
    common = {"featuresCol": "features", "labelCol": label}
    return [
        Candidate(
            "LinearRegression",
            LinearRegression(regParam=0.1, maxIter=50, **common),
            {"regParam": 0.1, "maxIter": 50},
        ),
        Candidate(
            "RandomForestRegressor",
            RandomForestRegressor(numTrees=20, maxDepth=5, seed=SEED, **common),
            {"numTrees": 20, "maxDepth": 5},
        ),
        Candidate(
            "GBTRegressor",
            GBTRegressor(maxIter=25, maxDepth=4, stepSize=0.1, seed=SEED, **common),
            {"maxIter": 25, "maxDepth": 4, "stepSize": 0.1},
        ),
    ]


def classifiers(label: str, boosting_rounds: int) -> list[Candidate]:
    # fixed values: the candidates' settings
    common = {"featuresCol": "features", "labelCol": label}
    return [
        Candidate(
            "LogisticRegression",
            LogisticRegression(maxIter=50, regParam=0.01, **common),
            {"maxIter": 50, "regParam": 0.01},
        ),
        Candidate(
            "RandomForestClassifier",
            RandomForestClassifier(numTrees=20, maxDepth=5, seed=SEED, **common),
            {"numTrees": 20, "maxDepth": 5},
        ),
        Candidate(
            "GBTClassifier",
            GBTClassifier(maxIter=boosting_rounds, maxDepth=4, stepSize=0.1, seed=SEED, **common),
            {"maxIter": boosting_rounds, "maxDepth": 4, "stepSize": 0.1},
        ),
    ]


def _classes(prepared: DataFrame, label: str) -> tuple[int | None, int | None]:
    """The least and the greatest label in TRAIN; None where it has none."""
    low, high = prepared.filter(F.col("split") == "TRAIN").agg(F.min(label), F.max(label)).first()
    return low, high


def _require_two_classes(prepared: DataFrame, label: str) -> None:
    low, high = _classes(prepared, label)
    if low == high:
        raise ValueError(f"the training window holds one class of {label} only: {low}")


@dataclass(frozen=True)
class OneClass:
    """What is learnt from labels that are all alike: that label, for certain."""

    label: int

    def transform(self, df: DataFrame) -> DataFrame:
        shares = array_to_vector(F.array(F.lit(1.0 - self.label), F.lit(float(self.label))))
        return df.withColumns(
            {"rawPrediction": shares, "probability": shares, "prediction": F.lit(float(self.label))}
        )


@dataclass(frozen=True)
class OneClassEstimator:
    """Fits a `OneClass`; labels are 0 and 1."""

    label: int

    def fit(self, train: DataFrame) -> OneClass:
        return OneClass(self.label)


def demand_contest(features: DataFrame, splits: SplitDates = SplitDates()) -> Verdict:
    """Lowest validation RMSE wins, ties by MAE. Negative forecasts become 0."""
    label = "weekly_quantity"
    labelled = features.withColumn("split", split_label("week_start_date", splits)).withColumn(
        label, F.col(label).cast("double")
    )
    prepared = prepare(labelled, DEMAND_FEATURES, ["category_id", "restaurant_id"], label)
    v = tournament(
        regressors(label), prepared, regression_scores(label), metric="rmse", tie="mae", larger=False
    )
    predicted = v.predictions.select(
        "week_start_date",
        "menu_item_id",
        "restaurant_id",
        F.col(label).alias("actual_quantity"),
        fixed(F.greatest(F.col("prediction"), F.lit(0.0)), 2).alias("predicted_quantity"),
        fixed(F.abs(F.col(label) - F.col("prediction")), 2).alias("absolute_error"),
        "split",
        F.lit("spark").alias("pipeline"),
    )
    return Verdict(v.champion, v.entries, v.test, predicted)


def _risk_columns(label: str, probability: str) -> list:
    return [
        F.col(label).alias("actual_label"),
        F.col("prediction").cast("int").alias("predicted_label"),
        fixed(vector_to_array("probability")[1], 4).alias(probability),
        "split",
        F.lit("spark").alias("pipeline"),
    ]


def waste_contest(features: DataFrame, splits: SplitDates = SplitDates()) -> Verdict:
    """Next week's risk from lagged ratios; highest validation ROC-AUC wins, ties by F1.

    Over many sales the weekly ratios draw close to their mean, and a whole training window
    may be without risk, or with nothing else. All candidates would then learn that one
    label, so it alone takes part.
    """
    label = "next_week_wastage_risk"
    labelled = features.withColumn("split", split_label("week_start_date", splits))
    prepared = prepare(labelled, WASTE_LAG_FEATURES, ["category_id", "restaurant_id"], label)
    low, high = _classes(prepared, label)
    if low is None:
        raise ValueError(f"the training window holds no {label}")
    only = [Candidate("OneClass", OneClassEstimator(low), {"label": low})]
    v = tournament(
        only if low == high else classifiers(label, 25),
        prepared,
        classification_scores(label),
        metric="roc_auc",
        tie="f1",
        larger=True,
    )
    predicted = v.predictions.select(
        "week_start_date",
        "menu_item_id",
        "restaurant_id",
        *_risk_columns(label, "risk_probability"),
    )
    return Verdict(v.champion, v.entries, v.test, predicted)


def churn_contest(panel: DataFrame) -> Verdict:
    """On the cutoff panel; highest validation ROC-AUC wins, ties by F1."""
    label = "churn_label"
    prepared = prepare(panel, CHURN_FEATURES, [], label)
    _require_two_classes(prepared, label)
    v = tournament(
        classifiers(label, 30),
        prepared,
        classification_scores(label),
        metric="roc_auc",
        tie="f1",
        larger=True,
    )
    predicted = v.predictions.select(
        "customer_id", "cutoff", *_risk_columns(label, "churn_probability")
    )
    return Verdict(v.champion, v.entries, v.test, predicted)


def label_clusters(clustered: DataFrame) -> DataFrame:
    """Name clusters by mean recency (low first), then frequency and money (high first).

    The table of clusters has k rows, so its ordering is a window over k rows.
    """
    means = clustered.groupBy("cluster_id").agg(
        F.avg("recency_days").alias("r"),
        F.avg("frequency").alias("f"),
        F.avg("monetary_total").alias("m"),
    )
    place = F.row_number().over(Window.orderBy("r", F.desc("f"), F.desc("m"), "cluster_id"))
    names = F.array(*[F.lit(s) for s in SEGMENTS])
    label = F.when(place <= len(SEGMENTS), F.get(names, place - 1)).otherwise(
        F.format_string("Segment_%d", place - 1)
    )
    named = means.select("cluster_id", label.alias("segment_label"))
    return clustered.join(named, "cluster_id", "left")


def segment_contest(customers: DataFrame, k: int = 4, with_mixture: bool = False) -> Verdict:
    """Scaled recency, frequency and money; highest silhouette wins."""
    columns = ["recency_days", "frequency", "monetary_total"]
    known = customers.agg(*[F.avg(finite(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    # a missing number becomes the mean: every customer gets a segment
    filled = [F.coalesce(finite(F.col(c).cast("double")), F.lit(float(known[c] or 0.0))).alias(c) for c in columns]
    typed = customers.select("customer_id", *filled)
    scale = Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="error"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        ]
    )
    prepared = stage(scale.fit(typed).transform(typed).drop("raw"), "segments")
    common = {"featuresCol": "features", "k": k, "maxIter": 50, "seed": SEED}
    candidates = [
        Candidate("KMeans", KMeans(**common), {"k": k, "maxIter": 50}),
        Candidate("BisectingKMeans", BisectingKMeans(**common), {"k": k, "maxIter": 50}),
    ]
    if with_mixture:
        candidates.append(
            Candidate("GaussianMixture", GaussianMixture(**common), {"k": k, "maxIter": 50})
        )
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    entries = []
    for c in candidates:
        started = time.monotonic()
        model = c.estimator.fit(prepared)
        seconds = round(time.monotonic() - started, 2)
        clustered = model.transform(prepared)
        used = clustered.agg(F.count_distinct("prediction")).first()[0]
        # one cluster has no silhouette; it is the worst possible outcome
        silhouette = evaluator.evaluate(clustered) if used > 1 else -1.0
        entries.append(
            Entry(c.name, c.settings, {"silhouette_score": round(silhouette, 6)}, seconds, model)
        )
    champion = best(entries, "silhouette_score", "silhouette_score", True)
    clustered = champion.model.transform(prepared).withColumnRenamed("prediction", "cluster_id")
    predicted = label_clusters(clustered).select(
        "customer_id", "cluster_id", "segment_label", *columns, F.lit("spark").alias("pipeline")
    )
    return Verdict(champion, entries, dict(champion.validation), predicted)


def run_tasks(tasks: dict[str, Callable[[], Verdict]]) -> tuple[dict[str, Verdict], dict[str, str]]:
    """Run every task; one that fails does not stop the others. Returns (verdicts, errors)."""
    done: dict[str, Verdict] = {}
    errors: dict[str, str] = {}
    for name, task in tasks.items():
        try:
            done[name] = task()
        except Exception as err:  # isolation between tasks is the point
            errors[name] = f"{type(err).__name__}: {err}"
    return done, errors


def run_status(done: dict[str, Verdict], errors: dict[str, str]) -> str:
    if not errors:
        return "SUCCESS"
    return "PARTIAL" if done else "FAILED"
