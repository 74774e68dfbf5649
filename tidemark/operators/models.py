"""Models with Spark ML: life regressors, monthly ridge, search, importance, recursive forecast, PCA."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, SQLTransformer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import staged
from .demand import with_lags, with_trend
from .ordering import medians
from .retrieval import unit
from .trees import ExtraTrees, Forest, flattened


def life_regressors(seed: int = 42) -> dict[str, Estimator]:
    """M1: tree regressors of total life."""
    shared = {"featuresCol": "features", "labelCol": "target", "seed": seed}
    return {"forest": RandomForestRegressor(numTrees=20, maxDepth=6, **shared), "boosted": GBTRegressor(maxIter=20, maxDepth=4, **shared), "extra": ExtraTrees(trees=20, depth=8, share=0.85, seed=seed)}


def with_imputed(df: DataFrame, columns: Sequence[str]) -> tuple[list, list[str]]:
    """M7: stages that fill nulls and NaN with the exact medians of df, 0 without values, and the names of their columns."""
    names = [f"{c}__f" for c in columns]
    fills = ", ".join(f"coalesce(nanvl(cast(`{c}` AS double), cast(NULL AS double)), {m!r}D) AS `{n}`" for (c, m), n in zip(medians(df, columns).items(), names))
    return [SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__")], names


def fit_model(df: DataFrame, columns: Sequence[str], estimator: Estimator) -> PipelineModel:
    """M7: fit on complete rows if there are any, else on rows filled with medians."""
    full = df.na.drop(subset=[*columns, "target"])
    rows = df.filter("target is not null") if full.isEmpty() else full
    stages, names = with_imputed(rows, columns)
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"), estimator]).fit(rows)


def fit_ridge(df: DataFrame, columns: Sequence[str], alpha: float) -> PipelineModel:
    """M2: scaled ridge regression; alpha is divided by the rows, as Spark averages the loss."""
    rows = df.na.drop(subset=[*columns, "target"])
    stages, names = with_imputed(rows, columns)
    regression = LinearRegression(featuresCol="features", labelCol="target", elasticNetParam=0.0, regParam=alpha / max(1, rows.count()), standardization=False)
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), regression]).fit(rows)


def score(model, df: DataFrame) -> dict[str, float]:
    """RMSE, MAE and R2 of a fitted model."""
    out = model.transform(df)
    return {m: RegressionEvaluator(labelCol="target", metricName=m).evaluate(out) for m in ("rmse", "mae", "r2")}


def assembled(df: DataFrame, columns: Sequence[str], fit_on: Column) -> DataFrame:
    """(split, target, all, gaps): every column in one vector, gaps filled with the medians of the rows it is fitted on, and the numbers of the columns that had them.

    Written once, as every candidate of a search reads slices of it.
    """
    stages, names = with_imputed(df.filter(fit_on), columns)
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(True)), F.lit(i)) for i, c in enumerate(columns)]))
    filled = stages[0].transform(df.filter("target is not null").withColumn("gaps", missing))
    return staged(VectorAssembler(inputCols=names, outputCol="all").transform(filled).select("split", F.col("target").cast("double").alias("target"), "all", "gaps"), "assembled")


def fit_slice(rows: DataFrame, places: Sequence[int], estimator: Estimator) -> PipelineModel:
    """M7 on an assembled table: fit some of its columns on the rows that had all of them, else on all rows."""
    full = rows.filter(F.size(F.array_intersect("gaps", F.array(*[F.lit(i) for i in places]))) == 0)
    return Pipeline(stages=[VectorSlicer(inputCol="all", outputCol="features", indices=list(places)), estimator]).fit(rows if full.isEmpty() else full)


def metrics(model, rows: DataFrame) -> dict[str, float]:
    """RMSE, MAE and R2 of a fitted model, in one pass; R2 is None for a constant target."""
    off = F.col("target") - F.col("prediction")
    r = model.transform(rows).agg(F.avg(off * off).alias("mse"), F.avg(F.abs(off)).alias("mae"), F.var_pop("target").alias("var")).first()
    return {"rmse": math.sqrt(r["mse"]), "mae": r["mae"], "r2": 1 - r["mse"] / r["var"] if r["var"] else None}


def search(rows: DataFrame, columns: Sequence[str], feature_sets: dict[str, Sequence[str]], estimators: dict[str, Estimator], keep: int = 12, parallelism: int = 4, fitted: dict[tuple[str, str], PipelineModel] | None = None) -> list[dict]:
    """M3: fit each set and model on Train, rank on Valid, refit the best on Train and Valid, score on Test, rank again.

    rows: an assembled table of the columns. Feature sets with the same columns count once (U6).
    fitted: (set, model) pairs that fit_slice has fitted on Train already, such as a selector of
    features. Candidates are fitted side by side, those of the last estimator last; the loop is
    over candidates, not rows.
    """
    train, valid, test = (rows.filter(F.col("split") == x) for x in ("Train", "Valid", "Test"))
    both, place = rows.filter(F.col("split").isin("Train", "Valid")), {c: i for i, c in enumerate(columns)}
    sets = {name: sorted(place[c] for c in own) for name, own in unique_sets(feature_sets).items()}

    def tried(candidate: tuple[str, str]) -> tuple[float, str, str]:
        name, kind = candidate
        model = (fitted or {}).get(candidate) or fit_slice(train, sets[name], estimators[kind].copy())
        return metrics(model, valid)["rmse"], name, kind

    def scored(found: tuple[float, str, str]) -> dict:
        rmse, name, kind = found
        return {"features": name, "n_features": len(sets[name]), "model": kind, "valid_rmse": rmse, **metrics(fit_slice(both, sets[name], estimators[kind].copy()), test)}

    with ThreadPoolExecutor(parallelism) as pool:
        best = sorted(pool.map(inheritable_thread_target(tried), [(n, k) for k in estimators for n in sets]))[:keep]
        out = list(pool.map(inheritable_thread_target(scored), best))
    return sorted(out, key=lambda r: (r["rmse"], r["features"], r["model"]))


def unique_sets(feature_sets: dict[str, Sequence[str]], least: int = 3) -> dict[str, Sequence[str]]:
    """The first of sets with the same columns, of at least `least` columns."""
    seen, out = set(), {}
    for name, columns in feature_sets.items():
        if len(set(columns)) >= least and frozenset(columns) not in seen:
            seen.add(frozenset(columns))
            out[name] = columns
    return out


def distinct_sets(rows: DataFrame, name: str, columns: str, least: int = 3) -> DataFrame:
    """U6 on a table: of rows with the same set of columns (an array) the one with the smallest name, with the set in order; sets under `least` go."""
    sets = rows.select(F.col(name), F.array_sort(F.array_distinct(F.array_compact(F.col(columns)))).alias(columns)).filter(F.size(columns) >= least)
    return sets.groupBy(columns).agg(F.min(name).alias(name)).select(name, columns)


def grid_search(df: DataFrame, columns: Sequence[str], folds: int = 5, depths: Sequence[int] = (4, 6), trees: Sequence[int] = (10, 20), parallelism: int = 2):
    """M4: best forest of a grid by cross-validated RMSE."""
    stages, names = with_imputed(df, columns)
    forest = RandomForestRegressor(featuresCol="features", labelCol="target", seed=42)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(trees)).build()
    pipe = Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"), forest])
    return CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="target", metricName="rmse"), numFolds=folds, parallelism=parallelism, seed=42).fit(df.filter("target is not null"))


def grid_scores(df: DataFrame, columns: Sequence[str], folds: int = 5, depths: Sequence[int] = (4, 6), trees: Sequence[int] = (10, 20), parallelism: int = 2) -> list[tuple[dict, float]]:
    """M4: (point, cross-validated RMSE) of a grid of forests, as grid_search has them, without refitting the best on all rows.

    Rows are assembled and dealt to folds once, and all pairs of a fold and a point share them.
    """
    stages, names = with_imputed(df, columns)
    forest = RandomForestRegressor(featuresCol="features", labelCol="target", seed=42)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(trees)).build()
    filled = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(stages[0].transform(df.filter("target is not null")))
    rows = filled.select("target", "features", F.floor(F.rand(42) * folds).alias("fold")).persist()
    evaluator = RegressionEvaluator(labelCol="target", metricName="rmse")

    def scored(pair: tuple[int, dict]) -> float:
        fold, point = pair
        return evaluator.evaluate(forest.fit(rows.filter(F.col("fold") != fold), point).transform(rows.filter(F.col("fold") == fold)))

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            found = list(pool.map(inheritable_thread_target(scored), [(f, p) for f in range(folds) for p in grid]))
    finally:
        rows.unpersist()
    return list(zip(grid, map(float, np.mean(np.reshape(found, (folds, len(grid))), axis=0))))


def importance(model: PipelineModel, columns: Sequence[str]) -> list[tuple[str, float]]:
    """M5: features by importance, largest first."""
    return sorted(zip(columns, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def top_sets(ranking: Sequence[tuple[str, float]], sizes: Sequence[int] = (10, 15, 20, 25)) -> dict[str, list[str]]:
    """M5: sets of the most important features."""
    return {f"top_{n}": [c for c, _ in ranking[:n]] for n in sizes if n <= len(ranking)}


def ranked_features(rows: DataFrame, columns: Sequence[str], selector: Estimator) -> list[tuple[str, float]]:
    """M5: columns of an assembled table by their importance for a selector fitted on Train, largest first."""
    return importance(fit_slice(rows.filter("split = 'Train'"), range(len(columns)), selector), columns)


def prune(rows: DataFrame, columns: Sequence[str], own: Sequence[str], estimator: Estimator, drop: int = 2, slack: float = 1.05, rounds: int = 1, score_on: str = "Valid") -> list[dict]:
    """M5: rounds of leaving out the `drop` least important features, each kept if RMSE stays within `slack` times that of all; the first that isn't kept ends them.

    rows: an assembled table of the columns, fitted on Train. Returns a record for the whole
    set and for each round: features, n_features, rmse, kept.
    """
    train, held, place = rows.filter("split = 'Train'"), rows.filter(F.col("split") == score_on), {c: i for i, c in enumerate(columns)}

    def fitted(names: Sequence[str]):
        model = fit_slice(train, [place[c] for c in names], estimator)
        return model, metrics(model, held)["rmse"]

    now = list(own)
    model, first = fitted(now)
    out = [{"features": now, "n_features": len(now), "rmse": first, "kept": True}]
    for _ in range(rounds):
        fewer = [c for c, _ in importance(model, now)[:-drop]]
        if not fewer:
            break
        model, rmse = fitted(fewer)
        out.append({"features": fewer, "n_features": len(fewer), "rmse": rmse, "kept": rmse <= slack * first})
        if not out[-1]["kept"]:
            break
        now = fewer
    return out


LAGS = (1, 2, 3, 6, 12)


def lag_row(values: Sequence[float], month: int) -> list[float]:
    """Features of the month that follows the values; NaN where the series is too short."""
    lags = [values[-k] if len(values) >= k else math.nan for k in LAGS]
    mean = [float(np.mean(values[-k:])) if len(values) >= k else math.nan for k in (3, 6)]
    return [*lags, *mean, math.sin(2 * math.pi * month / 12), math.cos(2 * math.pi * month / 12)]


def recursive_forecast(series: DataFrame, key: str, horizon: int, alpha: float = 1.0) -> DataFrame:
    """M6: (key, month, forecast) of the next months of each series; each forecast becomes a lag of the next.

    One group is one monthly series, of a few hundred rows at most. A ridge is fitted to its
    complete rows; missing features take the medians of the fit; forecasts are not under 0.
    Series without a complete row repeat their mean.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("month")
        values, months = frame["actual"].astype(float).tolist(), pd.to_datetime(frame["month"])
        rows = np.array([lag_row(values[:i], months.iloc[i].month) for i in range(1, len(values))]).reshape(-1, len(LAGS) + 4)
        y, full = np.array(values[1:]), ~np.isnan(rows).any(axis=1)
        out = []
        if full.any():
            x, middle = rows[full], np.median(rows[full], axis=0)
            mean, dev = x.mean(axis=0), np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
            z = (x - mean) / dev
            w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y[full] - y[full].mean()))
        for step in range(1, horizon + 1):
            at = months.iloc[-1] + pd.DateOffset(months=step)
            if full.any():
                row = np.array(lag_row(values, at.month))
                guess = float(((np.where(np.isnan(row), middle, row) - mean) / dev) @ w + y[full].mean())
            else:
                guess = float(np.mean(values))
            values.append(max(0.0, guess))
            out.append((frame[key].iloc[0], at.date(), values[-1]))
        return pd.DataFrame(out, columns=[key, "month", "forecast"])

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, "month", "actual").groupBy(key).applyInPandas(run, f"{key} {kind}, month date, forecast double")


FORECAST_FEATURES = ("trend", "month_sin", "month_cos", *(f"lag_{k}" for k in LAGS), "mean_3", "mean_6", "std_6")


@dataclass(frozen=True)
class Linear:
    """A scaled linear model: z = (x - mean) * scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.weights + self.intercept


@dataclass(frozen=True)
class SharedForecast:
    """What a group function needs of one model for all series: its arrays, the fills of missing features, and the fitted pipeline for the driver."""

    model: Forest | Linear
    fills: np.ndarray
    pipeline: PipelineModel


def fit_shared(series: DataFrame, keys: Sequence[str] = (), estimator: Estimator | None = None, alpha: float = 10.0) -> SharedForecast:
    """M6: one model over all series (keys, month, actual), a ridge or a tree ensemble; features as in FORECAST_FEATURES.

    Fitted on complete rows, else on filled ones, as in M7.
    """
    lagged = with_lags(with_trend(series, keys), keys).withColumn("target", F.col("actual").cast("double"))
    rows = staged(lagged.select("target", *[F.col(c).cast("double").alias(c) for c in FORECAST_FEATURES]), "lagged")
    full = rows.na.drop()
    ready = rows if full.isEmpty() else full
    fills = medians(rows, FORECAST_FEATURES)
    imputer, names = with_imputed(rows, FORECAST_FEATURES)
    if estimator is not None:
        pipeline = Pipeline(stages=[*imputer, VectorAssembler(inputCols=names, outputCol="features"), estimator]).fit(ready)
        model = flattened(pipeline.stages[-1])
    else:
        # deviations of constant columns are 0, which the scaler leaves at 0
        regression = LinearRegression(featuresCol="features", labelCol="target", elasticNetParam=0.0, regParam=alpha / max(1, ready.count()), standardization=False)
        pipeline = Pipeline(stages=[*imputer, VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), regression]).fit(ready)
        scaler, fitted = pipeline.stages[-2:]
        std = scaler.std.toArray()
        model = Linear(scaler.mean.toArray(), np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0), fitted.coefficients.toArray(), float(fitted.intercept))
    return SharedForecast(model, np.array([fills[c] for c in FORECAST_FEATURES]), pipeline)


def forecast_row(values: Sequence[float], month: int) -> list[float]:
    """FORECAST_FEATURES of the month that follows the values; NaN where the series is too short."""
    angle = month * (2 * math.pi) / 12
    lags = [values[-k] if len(values) >= k else math.nan for k in LAGS]
    return [float(len(values)), math.sin(angle), math.cos(angle), *lags, *(float(np.mean(values[-k:])) if len(values) >= k else math.nan for k in (3, 6)), float(np.std(values[-6:], ddof=1)) if len(values) >= 6 else math.nan]


def shared_forecast(series: DataFrame, key: str, horizon: int, fitted: SharedForecast) -> DataFrame:
    """M6: (key, month, forecast) of the next months of each series by one model; each forecast becomes a lag of the next.

    One group is one monthly series, of a few hundred rows at most; the model's arrays go to it.
    Missing features take the medians of the fit; forecasts are not under 0.
    """
    model, fills = fitted.model, fitted.fills

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("month")
        values, last, out = frame["actual"].astype(float).tolist(), pd.to_datetime(frame["month"]).iloc[-1], []
        for step in range(1, horizon + 1):
            at = last + pd.DateOffset(months=step)
            row = np.array([forecast_row(values, at.month)])
            values.append(max(0.0, float(model.predict(np.where(np.isnan(row), fills, row))[0])))
            out.append((frame[key].iloc[0], at.date(), values[-1]))
        return pd.DataFrame(out, columns=[key, "month", "forecast"])

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, "month", "actual").groupBy(key).applyInPandas(run, f"{key} {kind}, month date, forecast double")


def projected(vectors: DataFrame) -> DataFrame:
    """M9: two principal components of unit vectors, centred."""
    own = vectors.withColumn("raw", array_to_vector(unit(F.col("embedding"))))
    model = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False), PCA(k=2, inputCol="centred", outputCol="pc")]).fit(own)
    xy = vector_to_array(F.col("pc"))
    return model.transform(own).select("id", xy[0].alias("x"), xy[1].alias("y"))


def metadata(features: Sequence[str], metrics: dict[str, float], sizes: dict[str, int], guarded: bool) -> str:
    """One JSON record of a model; what is no finite number is null."""
    plain = {k: v if isinstance(v, (int, float)) and math.isfinite(v) else None for k, v in metrics.items()}
    return json.dumps({"features": list(features), "metrics": plain, "rows": sizes, "leak_guard": guarded}, sort_keys=True)


def write_record(spark: SparkSession, path: str, record: str) -> None:
    """The record of a model as one JSON line."""
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """(value) the record of a saved model."""
    return spark.read.text(f"{path}/record")


def save_model(model: PipelineModel, path: str, record: str) -> None:
    """The fitted pipeline and its record side by side."""
    model.write().overwrite().save(f"{path}/model")
    write_record(SparkSession.getActiveSession(), path, record)
