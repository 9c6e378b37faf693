"""Fitted models behind fit and predict, walk-forward evaluation, and fits from sufficient statistics.

Gradient-boosted trees are MLlib's: it has no monotone constraints, native categories or quantile loss, so categories are
indexed, missing values imputed, and quantiles taken from empirical errors. Predictions stay with their row's keys.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship


def model_version(features: Sequence[str], parameters: Mapping, cutoff: str, code: str = "") -> str:
    """Twelve digits of what a model was fitted on and how."""
    said = json.dumps([sorted(features), dict(sorted(parameters.items())), cutoff, code], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:12]


def before_and_at(df: DataFrame, season: str, week: str, at: tuple[int, int], first_season: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows strictly before a period (from a first season on), and the period's rows."""
    s, w = at
    earlier = (F.col(season) < s) | (F.col(season) == s) & (F.col(week) < w)
    if first_season is not None:
        earlier &= F.col(season) >= first_season
    return df.filter(earlier), df.filter((F.col(season) == s) & (F.col(week) == w))


@dataclass
class Fitted:
    """A fitted pipeline and the column its predictions go to."""

    transform: Callable[[DataFrame], DataFrame]
    out: str

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.transform(rows)


def _prepared(features: Sequence[str], categories: Sequence[str]) -> list:
    from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler

    stages: list = []
    if features:
        stages.append(Imputer(inputCols=list(features), outputCols=[f"__{f}" for f in features], strategy="median"))
    if categories:
        stages += [StringIndexer(inputCols=list(categories), outputCols=[f"__i_{c}" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"__i_{c}" for c in categories], outputCols=[f"__o_{c}" for c in categories], handleInvalid="keep")]
    return [*stages, VectorAssembler(inputCols=[*(f"__{f}" for f in features), *(f"__o_{c}" for c in categories)], outputCol="__x", handleInvalid="keep")]


def _clean(df: DataFrame, keep: Sequence[str], out: str) -> DataFrame:
    return df.select(*keep, out)


def fit_regression(train: DataFrame, target: str, features: Sequence[str], categories: Sequence[str] = (), out: str = "prediction", trees: int = 20, depth: int = 4, seed: int = 7, base: str | None = None) -> Fitted:
    """Boosted regression trees; with ``base``, of the target's residual, added to the base again (null stays null)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor

    rows = train.withColumn("__y", F.col(target).cast("double") - (F.col(base) if base else F.lit(0.0))).dropna(subset=["__y"])
    model = Pipeline(stages=[*_prepared(features, categories), GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="__p", maxIter=trees, maxDepth=depth, seed=seed)]).fit(rows)

    def transform(df: DataFrame) -> DataFrame:
        value = F.col("__p") + (F.col(base) if base else F.lit(0.0))
        return _clean(model.transform(df).withColumn(out, value), df.columns, out)

    return Fitted(transform, out)


def fit_classifier(train: DataFrame, target: str, features: Sequence[str], categories: Sequence[str] = (), out: str = "p", calibrate: Column | None = None, trees: int = 15, depth: int = 3, seed: int = 7) -> Fitted:
    """Boosted classification trees; with ``calibrate``, the rows it holds for are left out and fit an isotonic curve."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = train.withColumn("__y", F.col(target).cast("double")).dropna(subset=["__y"])
    fit_rows = rows.filter(~calibrate) if calibrate is not None else rows
    model = Pipeline(stages=[*_prepared(features, categories), GBTClassifier(featuresCol="__x", labelCol="__y", predictionCol="__c", maxIter=trees, maxDepth=depth, seed=seed).setProbabilityCol("__q").setRawPredictionCol("__r")]).fit(fit_rows)
    raw = lambda df: model.transform(df).withColumn("__p", vector_to_array("__q")[1])
    curve = IsotonicRegression(featuresCol="__p", labelCol="__y", predictionCol="__iso").fit(raw(rows.filter(calibrate)).select("__p", "__y")) if calibrate is not None else None

    def transform(df: DataFrame) -> DataFrame:
        scored = raw(df)
        value = F.col("__p")
        if curve is not None:
            scored, value = curve.transform(scored), F.col("__iso")
        return _clean(scored.withColumn(out, value), df.columns, out)

    return Fitted(transform, out)


def fit_logistic(train: DataFrame, target: str, features: Sequence[str], categories: Sequence[str] = (), out: str = "p") -> Fitted:
    """Impute, scale, one-hot, logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows = train.withColumn("__y", F.col(target).cast("double")).dropna(subset=["__y"])
    model = Pipeline(stages=[*_prepared(features, categories), LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__c", probabilityCol="__q", rawPredictionCol="__r", maxIter=50, regParam=1e-6)]).fit(rows)
    return Fitted(lambda df: _clean(model.transform(df).withColumn(out, vector_to_array("__q")[1]), df.columns, out), out)


def over_expectation(df: DataFrame, season: str, keys: Sequence[str], target: str, features: Sequence[str], out: str) -> DataFrame:
    """Mean of outcome less the chance fitted on the season before only: an action a season, of which there are tens. No row
    where no season follows another."""
    empty = df.limit(0).groupBy(*keys).agg(F.avg(F.lit(0.0)).alias(out))
    found: DataFrame | None = None
    seasons = [r[0] for r in df.select(season).distinct().orderBy(season).collect()]
    for before, now in zip(seasons, seasons[1:], strict=False):
        if now != before + 1:
            continue
        train = df.filter(F.col(season) == before)
        if train.agg(F.count_distinct(target)).first()[0] < 2:
            continue
        rows = fit_logistic(train, target, features).predict(df.filter(F.col(season) == now))
        part = rows.groupBy(*keys).agg(F.avg(F.col(target).cast("double") - F.col("p")).alias(out))
        found = part if found is None else found.unionByName(part)
    return empty if found is None else found


#: Values of a side whose square matrix a group's task holds in :func:`ridge_strengths`; it needs one side within this.
DENSE = 2048


def ridge_strengths(df: DataFrame, groups: Sequence[str], unit: str, other: str, value: str, weight: Column, strength: float = 20.0) -> DataFrame:
    """Adjusted strength of each unit against each opponent, by weighted ridge regression on both sides' dummies. Rows without a
    unit, opponent, value or weight have no part.

    Rows are first summed to pairs (unit, opponent) of each group, which is all that the normal equations need. In these a unit
    meets no other unit, so the side with more values is eliminated where its rows are, in parts: a group's task solves for the
    other side only. Where both sides are beyond ``DENSE`` a group's task gets its pairs and solves by conjugate gradients, so its
    memory grows with the pairs and not with their squares."""
    ship(df.sparkSession)
    rows = df.withColumn("__w", weight.cast("double")).dropna(subset=[unit, other, value, "__w"])
    sums = F.sum("__w").alias("__w"), F.sum(F.col(value) * F.col("__w")).cast("double").alias("__wy"), F.count(F.lit(1)).alias("__n")
    pairs = rows.groupBy(*groups, unit, other).agg(*sums)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    units, others = rows.agg(F.approx_count_distinct(unit), F.approx_count_distinct(other)).first()
    of_group = [f"`{g}` {kinds[g]}" for g in groups]
    schema = ", ".join([*of_group, f"`{unit}` {kinds[unit]}", "mean double", "strength double", "n long"])
    if min(units, others) > DENSE:
        return pairs.groupBy(*groups).applyInPandas(lambda r: _ridge_by_gradients(r, groups, unit, other, strength), schema)
    held, gone = (unit, other) if units < others else (other, unit)
    parts = pairs.groupBy(*groups, gone).agg(F.collect_list(F.struct(F.col(held).alias("k"), "__w", "__wy", F.col("__n").cast("double").alias("n"))).alias("__parts"))
    names = [f"g{k}" for k in range(len(groups))]
    renamed = ", ".join([*(f"{c} {kinds[g]}" for c, g in zip(names, groups, strict=True)), f"k {kinds[held]}", f"l {kinds[held]}", *(f"{c} double" for c in _CELLS)])
    cells = parts.select(*(F.col(g).alias(c) for c, g in zip(names, groups, strict=True)), "__parts").mapInArrow(lambda b: _ridge_cells(b, len(names), strength), renamed)
    cells = cells.groupBy(*names, "k", "l").agg(*(F.sum(c).alias(c) for c in _CELLS))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["k"] == rows["l"]].sort_values("k", ignore_index=True)
        place = pd.Index(own["k"])
        a = np.diag(own["w"].to_numpy() + strength)
        a[place.get_indexer(rows["k"]), place.get_indexer(rows["l"])] -= rows["s"].to_numpy()
        mean = own["wy"].sum() / own["w"].sum()
        x = np.linalg.solve(a, (own["wy"] - own["ry"] - mean * (own["w"] - own["rw"])).to_numpy())
        return pd.DataFrame({**{c: rows[c].iloc[:1].repeat(len(own)).to_numpy() for c in names}, "k": own["k"], "mean": mean, "strength": x, "n": own["n"].round().astype("int64")})

    solved = cells.groupBy(*names).applyInPandas(solve, ", ".join([*renamed.split(", ")[: len(names) + 1], "mean double", "strength double", "n long"]))
    if held == unit:
        return solved.toDF(*groups, unit, "mean", "strength", "n")
    same = [F.col(g).eqNullSafe(F.col(c)) for c, g in zip(names, groups, strict=True)]
    met = pairs.join(solved.drop("n"), [*same, F.col(other) == F.col("k")]).groupBy(*groups, unit)
    w, left = F.sum("__w"), F.sum(F.col("__wy") - F.col("__w") * (F.col("mean") + F.col("strength")))
    found = met.agg(F.first("mean").alias("mean"), F.try_divide(left, w + strength).alias("strength"), F.sum("__n").alias("n"))
    return found.select(*groups, unit, "mean", "strength", "n")


#: Sums by pair of values of the side that is solved for; all but ``s`` are on the diagonal.
_CELLS = ["s", "w", "wy", "rw", "ry", "n"]


def _ridge_cells(batches: Iterator[pa.RecordBatch], depth: int, strength: float) -> Iterator[pa.RecordBatch]:
    """Sums for the equations that remain of rows (groups, parts), a row for each value of the side that is eliminated."""
    for batch in batches:
        codes: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(depth)), strict=True) if depth else [()] * batch.num_rows):
            codes.setdefault(key, []).append(i)
        for places in codes.values():
            for first in range(0, len(places), 1024):
                own = batch.take(pa.array(places[first : first + 1024]))
                lists = own.column(depth)
                flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                coded = pc.dictionary_encode(flat.field(0))
                at, values = coded.indices.to_numpy(), coded.dictionary
                w, y, n = np.zeros((len(lists), len(values))), np.zeros((len(lists), len(values))), np.zeros(len(values))
                w[row, at], y[row, at] = flat.field(1).to_numpy(), flat.field(2).to_numpy()
                np.add.at(n, at, flat.field(3).to_numpy())
                scaled = w / (w.sum(1) + strength)[:, None]
                s, hit = scaled.T @ w, (w != 0).T.astype(float) @ (w != 0) > 0
                np.fill_diagonal(hit, True)
                i, j = np.nonzero(hit)
                on = i == j
                sums = [s[i, j], *(np.where(on, x[i], 0.0) for x in (w.sum(0), y.sum(0), scaled.T @ w.sum(1), scaled.T @ y.sum(1), n))]
                keys = [own.column(k).take(pa.array(np.zeros(len(i), np.int64))) for k in range(depth)]
                names = [*(f"g{k}" for k in range(depth)), "k", "l", *_CELLS]
                yield pa.RecordBatch.from_arrays([*keys, values.take(pa.array(i)), values.take(pa.array(j)), *map(pa.array, sums)], names=names)


def _ridge_by_gradients(rows: pd.DataFrame, groups: Sequence[str], unit: str, other: str, strength: float) -> pd.DataFrame:
    """The same from a group's pairs, by conjugate gradients scaled by the diagonal."""
    u, units = pd.factorize(rows[unit], sort=True)
    o, others = pd.factorize(rows[other], sort=True)
    w, wy = rows["__w"].to_numpy(float), rows["__wy"].to_numpy(float)
    mean, size = wy.sum() / w.sum(), len(units)
    both = lambda x, y: np.concatenate([np.bincount(u, x, size), np.bincount(o, y, len(others))])
    scale = both(w, w) + strength
    x, left = np.zeros(len(scale)), both(wy - mean * w, wy - mean * w)
    z = p = left / scale
    enough, now = 1e-26 * float(left @ z), float(left @ z)
    for _ in range(10 * len(scale)):
        if not now > enough:
            break
        ap = scale * p + both(w * p[size + o], w * p[u])
        step = now / float(p @ ap)
        x, left = x + step * p, left - step * ap
        z = left / scale
        now, before = float(left @ z), now
        p = z + now / before * p
    n = np.bincount(u, rows["__n"].to_numpy(float), size).astype(int)
    return pd.DataFrame({**{g: rows[g].iloc[:1].repeat(size).to_numpy() for g in groups}, unit: units, "mean": mean, "strength": x[:size], "n": n})


def recency(week: Column, last: Column, span: float) -> Column:
    """Weight by age: (1 - alpha) ^ weeks ago."""
    return F.pow(F.lit(1 - 2.0 / (span + 1)), (last - week).cast("double"))


def walk_forward(df: DataFrame, season: str, week: str, predictors: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]], periods: Sequence[tuple[int, int]], keys: Sequence[str], target: str, least: int = 50) -> DataFrame:
    """For each period every predictor, given the strictly earlier rows and the period's, returns keys and prediction."""
    found: DataFrame | None = None
    for at in periods:
        train, rows = before_and_at(df, season, week, at)
        if train.filter(F.col(target).isNotNull()).limit(least).count() < least:
            continue
        for name, predict in predictors.items():
            part = predict(train, rows.drop(target)).select(*keys, "prediction").join(rows.select(*keys, target), list(keys))
            part = part.withColumn("predictor", F.lit(name))
            found = part if found is None else found.unionByName(part)
    return found


def rolled_column(df: DataFrame, keys: Sequence[str], target: str, columns: Mapping[str, str]) -> DataFrame:
    """The same for predictors that are columns already known before their period: one pass, no loop."""
    items = F.array(*(F.struct(F.lit(n).alias("predictor"), F.col(c).cast("double").alias("prediction")) for n, c in columns.items()))
    return df.select(*keys, target, F.inline(items)).filter(F.col("prediction").isNotNull())


def best_weight(df: DataFrame, group: str, actual: str, a: str, b: str, step: float = 0.1) -> DataFrame:
    """The blend weight of ``a`` against ``b`` with the least mean absolute error, the smallest of equals."""
    grid = F.explode(F.array(*(F.lit(round(k * step, 6)) for k in range(int(round(1 / step)) + 1)))).alias("weight")
    rows = df.select(group, actual, a, b, grid)
    blend = F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b)
    errors = rows.groupBy(group, "weight").agg(F.avg(F.abs(blend - F.col(actual))).alias("mae"))
    return errors.groupBy(group).agg(F.min_by("weight", F.struct(F.round("mae", 9), "weight")).alias("weight"), F.min("mae").alias("mae"))


def width_scale(coverage: Callable[[float], float], nominal: float, low: float = 0.2, high: float = 5.0, tolerance: float = 0.005, most: int = 40) -> float:
    """The factor at which intervals reach a coverage, by bisection over an aggregate."""
    for _ in range(most):
        middle = (low + high) / 2
        now = coverage(middle)
        if abs(now - nominal) <= tolerance:
            break
        low, high = (middle, high) if now < nominal else (low, middle)
    return middle


def promoted_source(performance: DataFrame, source: str, mae: str, rho: str, current: str, margin: float = 0.02) -> DataFrame:
    """The best source by error, then rank correlation, if it beats the current one by a margin, else the current one."""
    best = performance.orderBy(F.asc(mae), F.desc(rho), source).limit(1).select(F.col(source).alias("best"), F.col(mae).alias("best_mae"))
    now = performance.filter(F.col(source) == current).agg(F.min(mae).alias("current_mae"))
    better = F.col("current_mae").isNull() | (F.col("best_mae") <= F.col("current_mae") * (1 - margin))
    return best.join(now).select(F.when(better, F.col("best")).otherwise(F.lit(current)).alias("source"), "best", "best_mae", "current_mae")


def previous_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("row_before", F.lag(F.struct(*df.columns)).over(w))
