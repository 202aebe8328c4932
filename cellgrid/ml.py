"""Models on cell attributes with pyspark.ml, and fire models on the automaton."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.automata import run

#: Temperature, humidity and wind of the fire scenarios; an unknown one counts as normal.
SCENARIOS = {"normal": (25, 50, 10), "dry": (35, 20, 15), "extreme": (40, 10, 30)}


KINDS = ("linear_regression", "random_forest", "gbt")


def train(wide: DataFrame, features: list[str], target: str, kind: str = "linear_regression", test_share: float = 0.2, split_tid: int | None = None):
    """(model, metrics) of a regression of `target` on `features`; rows with nulls don't count.

    Rows are dealt to test by a hash of the cell, or, with `split_tid`, by time: all from that time on. Kinds that Spark has
    no learner for (xgboost, lstm, cnn) are refused, not replaced by another.
    """
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    if kind not in KINDS:
        raise ValueError(f"{kind} is not supported; there are {', '.join(KINDS)}")
    own = {"featuresCol": "features", "labelCol": target}
    makers = {
        "linear_regression": lambda: LinearRegression(**own),
        "random_forest": lambda: RandomForestRegressor(**own, seed=7),
        "gbt": lambda: GBTRegressor(**own, seed=7, maxIter=20),
    }
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(wide.dropna(subset=[*features, target]))
    test = F.pmod(F.xxhash64("dggid"), F.lit(1000)) < int(1000 * test_share) if split_tid is None else F.col("tid") >= split_tid
    model = makers[kind]().fit(rows.where(~test))
    held = model.transform(rows.where(test))
    metrics = {m: RegressionEvaluator(labelCol=target, metricName=m).evaluate(held) for m in ("rmse", "mae", "r2")}
    return model, metrics


MODELS = "model_id string, kind string, target string, features array<string>, metrics map<string,double>, path string, created_at timestamp"


def save_model(model, spark: SparkSession, folder: str, kind: str, target: str, features: list[str], metrics: dict[str, float]) -> str:
    """Saves a model under `folder` with a row that describes it; its id."""
    model_id = str(uuid.uuid4())
    model.save(f"{folder}/{model_id}")
    row = (model_id, kind, target, features, {k: float(v) for k, v in metrics.items()}, f"{folder}/{model_id}", datetime.now(UTC).replace(tzinfo=None))
    spark.createDataFrame([row], MODELS).write.mode("append").parquet(f"{folder}/models")
    return model_id


def list_models(spark: SparkSession, folder: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    """The saved models, newest first."""
    x = spark.read.schema(MODELS).parquet(f"{folder}/models")
    return (x if kind is None else x.where(F.col("kind") == kind)).orderBy(F.desc("created_at"), "model_id").limit(limit)


def model_info(spark: SparkSession, folder: str, model_id: str) -> DataFrame:
    """The row of one model; none if there is no such model."""
    return spark.read.schema(MODELS).parquet(f"{folder}/models").where(F.col("model_id") == model_id)


def load_model(spark: SparkSession, folder: str, model_id: str):
    """A saved model."""
    from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel

    row = model_info(spark, folder, model_id).first()
    if row is None:
        raise ValueError(f"no model {model_id}")
    return {"linear_regression": LinearRegressionModel, "random_forest": RandomForestRegressionModel, "gbt": GBTRegressionModel}[row.kind].load(row.path)


def predict(model, wide: DataFrame, features: list[str], key: str = "prediction") -> DataFrame:
    """Predictions as cell objects."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(wide.dropna(subset=features))
    return model.transform(rows).select("dggid", "tid", F.lit(key).alias("attr_key"), F.col("prediction").alias("value_num"))


def fire_spread(fuel: DataFrame, ignition: DataFrame, topo: DataFrame, steps: int = 5, least_fuel: float = 0.0) -> DataFrame:
    """The state of every fuelled cell after so many steps of fire from the ignition cells; cells with too little fuel don't burn."""
    cells = fuel.where(F.col("value_num") > least_fuel).select("dggid")
    state = cells.join(ignition.select("dggid").distinct().withColumn("lit", F.lit(True)), "dggid", "left").select("dggid", F.when(F.col("lit"), "burning").otherwise("unburned").alias("state"))
    return run(state, topo, steps)


def fire_risk(cells: DataFrame, scenario: str = "normal") -> DataFrame:
    """A score from 0 to 1 by the scenario's weather and the cell's fuel (value_num, 0 to 1), and its class."""
    t, h, w = SCENARIOS.get(scenario, SCENARIOS["normal"])
    weather = (t / 40 + (100 - h) / 100 + w / 30) / 3
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(weather) * F.col("value_num")))
    return cells.select("dggid", score.alias("score"), F.when(score >= 0.75, "extreme").when(score >= 0.5, "high").when(score >= 0.25, "moderate").otherwise("low").alias("risk"))


def services(spark: SparkSession) -> DataFrame:
    """The registry of services."""
    row = ("fire-spread", "ANALYTIC", "Fire spread over fuelled cells", '{"type":"object","properties":{"dataset_id":{"type":"string"},"steps":{"type":"integer"}}}')
    return spark.createDataFrame([row], "id string, kind string, description string, input_schema string")
