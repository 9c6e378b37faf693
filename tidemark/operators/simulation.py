"""Seeded Monte Carlo. Draws come from a generator seeded by (seed, block), or from hashes, so reruns and retries agree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.session import ship


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) for each combination of keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal variate for each combination of keys (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 7919, *keys))


def simulations(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).withColumnRenamed("id", "sim")


def nearest_positive_definite(matrix: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Negative eigenvalues clipped, the diagonal scaled back to one."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    fixed = vectors @ np.diag(np.maximum(values, least)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return fixed / np.outer(scale, scale)


def correlation_matrix(teams: Sequence, groups: Sequence, rule: Callable[[object, object, bool], float]) -> np.ndarray:
    """Pair correlations by a rule of both groups and whether the team is the same."""
    n = len(teams)
    out = np.eye(n)
    for i in range(n):
        for j in range(i):
            out[i, j] = out[j, i] = rule(groups[i], groups[j], teams[i] == teams[j])
    return out


def inverse_marginal(u: np.ndarray, alphas: Sequence[float], quantiles: Sequence[float]) -> np.ndarray:
    """Piecewise-linear inverse distribution through quantiles, from 0 below and with an exponential tail above."""
    a, q = np.asarray(alphas, float), np.asarray(quantiles, float)
    out = np.interp(u, np.concatenate([[0.0], a]), np.concatenate([[min(0.0, q[0])], q]))
    over = u > a[-1]
    scale = max((q[-1] - q[len(q) // 2]) / max(math.log((1 - a[len(q) // 2]) / (1 - a[-1])), 1e-9), 0.0)
    out[over] = q[-1] - scale * np.log((1 - u[over]) / (1 - a[-1]))
    return out


def _cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))


def gaussian_scores(rng: np.random.Generator, matrix: np.ndarray, quantiles: Sequence[Sequence[float]], alphas: Sequence[float], n: int) -> np.ndarray:
    """n draws of correlated players by a Gaussian copula and their own marginals."""
    u = _cdf(rng.standard_normal((n, len(quantiles))) @ np.linalg.cholesky(matrix).T)
    return np.stack([inverse_marginal(u[:, k], alphas, q) for k, q in enumerate(quantiles)], 1)


def slate_draws(players: DataFrame, slate: str, player: str, team: str, group: str, quantiles: str, alphas: Sequence[float], rule: Callable[[object, object, bool], float], n: int = 1000, seed: int = 0) -> DataFrame:
    """Gaussian copula draws of each slate's players: slate, player, mean, sd, and its chance of the slate's top score.

    A slate is a game day's players, so its correlation matrix is small; slates are spread over tasks."""
    ship(players.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in players.schema}

    def simulate(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(player, ignore_index=True)
        key = int(pd.util.hash_array(np.array([str(rows[slate][0])], dtype=object))[0])
        rng = np.random.default_rng([seed, key])
        matrix = nearest_positive_definite(correlation_matrix(rows[team].tolist(), rows[group].tolist(), rule))
        points = gaussian_scores(rng, matrix, rows[quantiles].tolist(), alphas, n)
        top = np.bincount(points.argmax(1), minlength=len(rows)) / n
        return pd.DataFrame({slate: rows[slate], player: rows[player], "mean": points.mean(0), "sd": points.std(0), "p_top": top})

    return players.groupBy(slate).applyInPandas(simulate, f"`{slate}` {kinds[slate]}, `{player}` {kinds[player]}, mean double, sd double, p_top double")


def survival(players: DataFrame, mean: str, entity: str, n: int = 20_000, seed: int = 2026, noise: float = 0.3, least: float = 2.5) -> DataFrame:
    """How often each entity has the lowest noisy total: rows are made simulation by simulation and reduced at once.

    Entities are a league's rosters (tens), so entities x simulations is bounded by the caller."""
    sd = F.greatest(F.lit(least), noise * F.col(mean))
    entities = F.broadcast(players.select(entity, mean))  # a league's rosters
    draws = simulations(players.sparkSession, n).crossJoin(entities)
    draws = draws.withColumn("__total", F.col(mean) + sd * normal(seed, F.col("sim"), F.col(entity)))
    lowest = draws.groupBy("sim").agg(F.min_by(entity, "__total").alias(entity))
    return lowest.groupBy(entity).agg((F.count(F.lit(1)) / F.lit(float(n))).alias("p_out"))


#: Most teams of a season table.
LEAGUE = 64


def season_table(teams: DataFrame, team: str, mean: str, sd: str, weeks: int, n: int = 3000, seed: int = 0, playoffs: int = 4) -> DataFrame:
    """Seasons of weekly pairings by rotation: expected wins, points, and the chance of a playoff seat and of the first
    seed. Seeds order by wins, then points. Teams are a league's (tens); more than ``LEAGUE`` raise ValueError."""
    ship(teams.sparkSession)
    found = teams.select(team, mean, sd).limit(LEAGUE + 1).collect()
    if len(found) > LEAGUE:
        raise ValueError(f"season_table: more than {LEAGUE} teams")
    rows = sorted(((r[0], float(r[1]), float(r[2])) for r in found), key=lambda r: str(r[0]))
    names, mu, spread = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    kind = teams.schema[team].dataType.simpleString()
    kind_of = to_arrow_type(teams.schema[team].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for b in batches:
            out = {"wins": np.zeros(k), "points": np.zeros(k), "seat": np.zeros(k), "first": np.zeros(k)}
            sims = b.column(0).to_pylist()
            for s in sims:
                rng = np.random.default_rng([seed, s])
                scores = mu + spread * rng.standard_normal((weeks, k))
                wins = np.zeros(k)
                for w in range(weeks):
                    order = [0, *(1 + (np.arange(k - 1) + w) % (k - 1))] if k > 1 else [0]
                    for i in range(k // 2):
                        x, y = order[i], order[k - 1 - i]
                        wins[x if scores[w, x] >= scores[w, y] else y] += 1
                total = scores.sum(0)
                seeds = np.lexsort((-total, -wins))
                out["wins"] += wins
                out["points"] += total
                out["seat"][seeds[:playoffs]] += 1
                out["first"][seeds[0]] += 1
            columns = [pa.array(names, kind_of), pa.array([len(sims)] * k, pa.int64()), *map(pa.array, out.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[team, "sims", *out])

    parts = simulations(teams.sparkSession, n).mapInArrow(run, f"`{team}` {kind}, sims long, wins double, points double, seat double, first double")
    total = F.sum("sims")
    return parts.groupBy(team).agg(*((F.sum(c) / total).alias(c) for c in ("wins", "points", "seat", "first")))


def rest_of_season(players: DataFrame, player: str, mean: str, sd: str, p_miss: str, weeks: int, recovery: float, correlation: float, n: int = 500, seed: int = 0) -> DataFrame:
    """Totals over the weeks left with absences (in by ``p_miss``, back by ``recovery``) and weeks correlated by a common
    factor: mean, p10, p50, p90, games. Players are spread over tasks; each player's simulations stay in one batch."""
    ship(players.sparkSession)
    kind = players.schema[player].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, m, s, p in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                key = int(pd.util.hash_array(np.array([str(name)], dtype=object))[0])
                rng = np.random.default_rng([seed, key])
                factor = rng.standard_normal((n, 1))
                noise = math.sqrt(correlation) * factor + math.sqrt(1 - correlation) * rng.standard_normal((n, weeks))
                points = np.maximum(m + s * noise, 0.0)
                absent, active = rng.random(n) < p, np.zeros((n, weeks), bool)
                for w in range(weeks):
                    active[:, w] = ~absent
                    absent = np.where(absent, rng.random(n) >= recovery, rng.random(n) < p)
                total = (points * active).sum(1)
                out.append((name, total.mean(), *np.quantile(total, [0.1, 0.5, 0.9]), active.sum(1).mean()))
            names = [player, "mean", "p10", "p50", "p90", "games"]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), *(pa.array(c, pa.float64()) for c in columns[1:])], names=names)

    return players.select(player, mean, sd, p_miss).mapInArrow(run, f"`{player}` {kind}, mean double, p10 double, p50 double, p90 double, games double")


def weighted_choice(df: DataFrame, keys: Sequence[str], weight: Column, tie: str, seed: int) -> DataFrame:
    """One row of each key with a chance in proportion to its weight: the first of exponential races."""
    race = F.when(weight > 0, -F.log(uniform(seed, *map(F.col, keys), F.col(tie))) / weight)
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__race"), tie)
    return df.withColumn("__race", race).filter("__race is not null").withColumn("__row", F.row_number().over(w)).filter("__row = 1").drop("__race", "__row")


def pick_weight(adp: Column, pick: Column, temperature: float, need: Column) -> Column:
    """How likely a bot takes a player near a pick."""
    return F.exp(-F.abs(adp - pick) / F.lit(temperature)) * need


def mixture_quantiles(quantiles: Sequence[float], alphas: Sequence[float], p_active: float) -> list[float]:
    """Quantiles of a value that is 0 with the chance 1 - p_active."""
    out = []
    for a in alphas:
        inner = (a - (1 - p_active)) / p_active if p_active > 0 else -1.0
        out.append(0.0 if inner <= 0 else float(np.interp(inner, alphas, quantiles)))
    return out
