"""Pairs of alterations: co-occurrence, contingency tables, odds ratios and Fisher's exact test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite, odds, odds_smooth


def frequencies(alts: DataFrame) -> DataFrame:
    """(feature, ones)."""
    return alts.groupBy("feature").agg(F.count_distinct("sample").alias("ones"))


def pair_counts(alts: DataFrame) -> DataFrame:
    """(alt1, alt2, co_count) of the pairs that some sample has, alt1 before alt2: one self-join on the sample, summed map-side."""
    a = alts.select("sample", F.col("feature").alias("alt1"))
    b = alts.select("sample", F.col("feature").alias("alt2"))
    return a.join(b, "sample").where("alt1 < alt2").groupBy("alt1", "alt2").agg(F.count("*").alias("co_count"))


def contingency(alts: DataFrame, samples: DataFrame) -> DataFrame:
    """(alt1, alt2, a, b, c, d, n) of all pairs: both, first only, second only, neither. Margins make up the cells, so samples are not read again for each pair."""
    freq = frequencies(alts)
    n = F.broadcast(samples.agg(F.count_distinct("sample").alias("n")))  # one row
    left = freq.select(F.col("feature").alias("alt1"), F.col("ones").alias("f1"))
    right = freq.select(F.col("feature").alias("alt2"), F.col("ones").alias("f2"))
    pairs = left.join(right, F.col("alt1") < F.col("alt2")).join(pair_counts(alts), ["alt1", "alt2"], "left").crossJoin(n)  # the features are a dimension
    a = F.coalesce("co_count", F.lit(0))
    return pairs.select("alt1", "alt2", a.alias("a"), (F.col("f1") - a).alias("b"), (F.col("f2") - a).alias("c"), (F.col("n") - F.col("f1") - F.col("f2") + a).alias("d"), "n")


def expected(alts: DataFrame, samples: DataFrame) -> DataFrame:
    """(alt1, alt2, obs, exp, diff): co-occurrence, and what independence would give."""
    t = contingency(alts, samples)
    exp = (F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) / F.col("n")
    return t.select("alt1", "alt2", F.col("a").alias("obs"), exp.alias("exp"), (F.col("a") - exp).alias("diff"))


def _exact_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a table. The hypergeometric weights over its support come from the ratios of neighbours, as running sums of logarithms."""
    row, col, n = a + b, a + c, a + b + c + d
    first = max(0, row + col - n)
    k = np.arange(first + 1, min(row, col) + 1, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log((row - k + 1) * (col - k + 1) / (k * (n - row - col + k))))])
    w = np.exp(logs - logs.max())
    return min(1.0, float(w[w <= w[a - first] * (1 + 1e-7)].sum() / w.sum()))


def _exact_ps(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    return pd.Series([known[t] if t in known else known.setdefault(t, _exact_p(*map(int, t))) for t in zip(a, b, c, d, strict=True)], dtype=float)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of Fisher's exact test, in Arrow batches: weights up to the observed one, with a tolerance of 1e-7, add up to it."""
    return F.pandas_udf(_exact_ps, "double")(*(x.cast("long") for x in (a, b, c, d)))


def fisher(tables: DataFrame, *keys: str) -> DataFrame:
    """(keys, p): two-sided exact p of the tables (a, b, c, d)."""
    return tables.select(*keys, fisher_p(*(F.col(x) for x in "abcd")).alias("p"))


def fisher_pairs(alts: DataFrame, samples: DataFrame) -> DataFrame:
    """(alt1, alt2, co_count, co_percent, odds_ratio, odds_smooth, p) of all pairs; empty with fewer than two features."""
    t = contingency(alts, samples)
    cells = [F.col(x) for x in "abcd"]
    share = F.col("a") / F.col("n")
    return t.select("alt1", "alt2", F.col("a").alias("co_count"), share.alias("co_percent"), odds(*cells).alias("odds_ratio"), odds_smooth(*cells).alias("odds_smooth"), fisher_p(*cells).alias("p"))


def by_member(pairs: DataFrame) -> DataFrame:
    """The pairs once for each of their two alterations, as query_alteration: an equi-join key in place of 'alt1 = x or alt2 = x'."""
    return pairs.withColumn("query_alteration", F.explode(F.array("alt1", "alt2")))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Per alteration: number of its pairs, mean and largest absolute log odds, co-occurrence count and share."""
    size = F.abs(finite(F.ln("odds_smooth")))
    return by_member(pairs).groupBy(F.col("query_alteration").alias("alteration")).agg(
        F.count("*").alias("n_pairs"),
        F.avg(size).alias("mean_abs_log_or"),
        F.max(size).alias("max_abs_log_or"),
        F.avg("co_count").alias("mean_co_count"),
        F.max("co_count").alias("max_co_count"),
        F.avg("co_percent").alias("mean_co_percent"),
        F.max("co_percent").alias("max_co_percent"),
    )
