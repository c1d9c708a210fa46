"""Latent factors of the alterations (probabilistic PCA) as stand-ins for unseen confounders, beside which the effects are fitted."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal, uniform
from ..sources.scratch import stored
from .design import gram
from .linear import ALPHAS, penalised


@dataclass
class Factors:
    """Maximum-likelihood factors: loadings w (features x k), noise, feature means, and the matrix that maps centred rows to scores."""

    names: list[str]
    w: np.ndarray
    noise: float
    means: np.ndarray
    project: np.ndarray
    score_covariance: np.ndarray
    loading_covariance: np.ndarray


def covariance(alts: DataFrame, samples: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str], int]:
    """Covariance and means of the 0/1 features over all samples, from the Gram matrix: p^2 numbers reach the driver."""
    used = alts.select("sample", "feature").distinct().join(samples.select("sample").distinct(), "sample", "left_semi")
    cells = gram(used).collect()
    names = sorted({r["f1"] for r in cells})
    at, n = {f: i for i, f in enumerate(names)}, samples.select("sample").distinct().count()
    g = np.zeros((len(names), len(names)))
    for r in cells:
        g[at[r["f1"]], at[r["f2"]]] = r["value"]
    means = np.diag(g) / max(n, 1)
    return g / max(n, 1) - np.outer(means, means), means, names, n


def ppca(cov: np.ndarray, means: np.ndarray, names: list[str], k: int, eigen: tuple[np.ndarray, np.ndarray] | None = None) -> Factors:
    """k factors; the noise is the mean of the other eigenvalues. ValueError unless k is smaller than the number of features."""
    d = len(names)
    if not 0 < k < d:
        raise ValueError(f"{k} factors of {d} features")
    values, vectors = eigen or np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    noise = float(max(values[k:].mean(), 1e-12))
    w = vectors[:, :k] * np.sqrt(np.maximum(values[:k] - noise, 0.0))
    m = w.T @ w + noise * np.eye(k)
    inverse = np.linalg.pinv(m, rcond=1e-3)
    return Factors(names, w, noise, means, inverse @ w.T, noise * m, noise * inverse)


def scores(alts: DataFrame, samples: DataFrame, factors: Factors) -> DataFrame:
    """(sample, feature, value): latent_1 ... of every sample, as a sparse product with the loadings."""
    spark = alts.sparkSession
    k = factors.w.shape[1]
    rows = [(f, j, float(factors.project[j, i])) for i, f in enumerate(factors.names) for j in range(k)]
    weights = F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=["feature", "j", "w"]), "feature string, j int, w double"))  # features x k
    shift = (factors.project @ factors.means).tolist()
    sums = alts.select("sample", "feature").distinct().join(weights, "feature").groupBy("sample", "j").agg(F.sum("w").alias("s"))
    base = spark.createDataFrame([(j, float(v)) for j, v in enumerate(shift)], "j int, shift double")
    grid = samples.select("sample").distinct().crossJoin(F.broadcast(base))  # k rows
    return grid.join(sums, ["sample", "j"], "left").select("sample", F.concat(F.lit("latent_"), F.col("j") + 1).alias("feature"), (F.coalesce("s", F.lit(0.0)) - F.col("shift")).alias("value"))


def generate(samples: DataFrame, factors: Factors, seed: int = 44) -> DataFrame:
    """(sample, feature, value) drawn from the model: loadings times standard normal scores, plus the means."""
    spark = samples.sparkSession
    k = factors.w.shape[1]
    z = samples.select("sample").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("z", normal(seed, "z", F.col("sample"), F.col("j")))
    rows = [(f, j, float(factors.w[i, j]), float(factors.means[i])) for i, f in enumerate(factors.names) for j in range(k)]
    weights = F.broadcast(spark.createDataFrame(rows, "feature string, j int, w double, mean double"))  # features x k
    return z.join(weights, "j").groupBy("sample", "feature").agg((F.sum(F.col("w") * F.col("z")) + F.max("mean")).alias("value"))


def holdout(samples: DataFrame, features: DataFrame, share: float = 0.2, seed: int = 44) -> DataFrame:
    """(sample, feature) of the cells that are held out, each once."""
    grid = samples.select("sample").distinct().crossJoin(features.select("feature").distinct())
    return grid.where(uniform(seed, "holdout", F.col("sample"), F.col("feature")) < share)


def predictive_check(alts: DataFrame, samples: DataFrame, factors: Factors, share: float = 0.2, draws: int = 100, sd: float = 0.1, seed: int = 44) -> float:
    """Mean over samples of the share of replicates that are less likely than the held-out cells, given the scores of the others.

    A block of samples is checked at a time; a value near one half says that the factors describe the alterations.
    """
    names, w, means, project, noise = factors.names, factors.w, factors.means, factors.project, factors.noise
    at = {f: i for i, f in enumerate(names)}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(rows["sample"].unique())
        place = {s: i for i, s in enumerate(ids)}
        x = np.zeros((len(ids), len(names)))
        known = rows[rows["feature"].notna()]
        x[known["sample"].map(place), known["feature"].map(at)] = 1
        rng = np.random.default_rng([seed, int(key[0])])
        hidden = rng.random(x.shape) < share
        seen = np.where(hidden, means, x)
        z = (seen - means) @ project.T
        mean = z @ w.T + means
        density = lambda v: -0.5 * (((v - mean) / sd) ** 2 * hidden).sum(axis=1)
        obs, less = density(x), np.zeros(len(ids))
        for _ in range(draws):
            less += density(mean + rng.normal(0, np.sqrt(noise), x.shape)) < obs
        used = hidden.any(axis=1)
        return pd.DataFrame({"total": [float((less[used] / draws).sum())], "n": [int(used.sum())]})

    base = samples.select("sample").distinct().join(alts.select("sample", "feature").distinct().where(F.col("feature").isin(names)), "sample", "left")
    blocks = base.withColumn("block", F.pmod(F.xxhash64("sample"), F.lit(max(1, samples.count() // 500)))).groupBy("block").applyInPandas(run, "total double, n long")
    r = blocks.agg(F.sum("total").alias("t"), F.sum("n").alias("n")).first()
    return float(r["t"] / r["n"]) if r["n"] else 0.0


def choose_factors(alts: DataFrame, samples: DataFrame, candidates: Iterable[int] = range(2, 99), cutoff: float = 0.1, seed: int = 44) -> tuple[int, Factors | None]:
    """The first number of factors whose check reaches the cutoff, else the last; 1 without a valid candidate. One eigendecomposition serves all."""
    cov, means, names, _ = covariance(alts, samples)
    valid = [k for k in candidates if 0 < k < len(names)]
    if not valid:
        return 1, ppca(cov, means, names, 1) if len(names) > 1 else None
    eigen = np.linalg.eigh(cov)
    for k in valid:
        found = ppca(cov, means, names, k, eigen)
        if predictive_check(alts, samples, found, seed=seed) >= cutoff:
            break
    return k, found


def deconfounded(alts: DataFrame, cells: DataFrame, samples: DataFrame, candidates: Iterable[int] = range(2, 99), cutoff: float = 0.1, alphas=ALPHAS, seed: int = 44) -> DataFrame:
    """(gene, alt, weight): lasso coefficients of the alterations beside the latent factors, whose part in expression is taken out of it first.

    The factors enter as regressors by partialling out: expression less its least-squares fit on the scores. cells: sample, gene, u. Scores are linear in the
    alterations, so that fit, too, follows from X'X and X'y, and no dense table of samples and genes is made.
    """
    alts, cells, samples = stored(alts.select("sample", "feature").distinct()), stored(cells.select("sample", "gene", "u")), stored(samples.select("sample").distinct())  # each is read many times
    _, factors = choose_factors(alts, samples, candidates, cutoff, seed)

    def linear_scores(names: list[str]) -> np.ndarray:
        at = {f: i for i, f in enumerate(factors.names)}
        rows = [factors.project[:, at[f]] if f in at else np.zeros(len(factors.project)) for f in names]
        return np.stack([*rows, -factors.project @ factors.means])

    return penalised(alts, cells, samples, alphas=alphas, seed=seed, scores=None if factors is None else linear_scores).select("gene", "alt", "weight")
