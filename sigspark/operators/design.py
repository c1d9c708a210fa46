"""A binary design matrix of full rank, as linear models need it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns whose Gram matrix the driver takes for the rank test.
MAX_COLUMNS = 3000


def column_report(alts: DataFrame, samples: DataFrame, features: DataFrame, min_group: int = 5, keywords: Sequence[str] = ("GOF", "LOF", "FUSION")) -> DataFrame:
    """(feature, ones, reason, place): reason is constant, imbalanced, duplicate or NULL; place orders the rest by keyword, prevalence and name.

    Equal columns are found by sums of two hashes of their samples, so no column is gathered in one place.
    """
    n = F.broadcast(samples.agg(F.count_distinct("sample").alias("n")))  # one row
    marks = alts.select("sample", "feature").distinct().join(samples.select("sample").distinct(), "sample", "left_semi")
    sums = marks.groupBy("feature").agg(F.count("*").alias("ones"), *(F.sum(F.xxhash64(F.lit(seed), "sample").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)))
    rows = features.select("feature").distinct().join(sums, "feature", "left").fillna(0, subset=["ones"]).crossJoin(n)
    ones, zeros = F.col("ones"), F.col("n") - F.col("ones")
    rows = rows.withColumn("reason", F.when((ones == 0) | (zeros == 0), "constant").when((ones < min_group) | (zeros < min_group), "imbalanced"))
    same = Window.partitionBy(F.col("reason").isNull(), "ones", "h1", "h2").orderBy("feature")
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(same) > 1), "duplicate").otherwise(F.col("reason")))
    prior = F.lit(False)
    for k in keywords:
        prior = prior | F.contains(F.upper("feature"), F.lit(k))
    place = F.row_number().over(Window.partitionBy(F.col("reason").isNull()).orderBy(prior.desc(), ones.desc(), "feature"))
    return rows.select("feature", "ones", "reason", F.when(F.col("reason").isNull(), place).alias("place"))


def independent(gram: np.ndarray, ones: np.ndarray, n: int, most: int) -> tuple[list[int], list[int], list[int]]:
    """Columns kept, dependent and over capacity, taken greedily beside an intercept: a column is dependent if the kept ones leave nothing of it."""
    kept: list[int] = []
    dependent: list[int] = []
    over: list[int] = []
    basis = np.zeros((0, len(ones)))  # rows: products of an orthonormal basis with every column
    basis = np.vstack([basis, ones / np.sqrt(max(n, 1))])
    for j in range(len(ones)):
        if len(kept) >= most:
            over.append(j)
            continue
        left = gram[j, j] - float((basis[:, j] ** 2).sum())
        if left > 1e-7 * max(1.0, gram[j, j]):
            basis = np.vstack([basis, (gram[j] - basis[:, j] @ basis) / np.sqrt(left)])
            kept.append(j)
        else:
            dependent.append(j)
    return kept, dependent, over


def gram(alts: DataFrame) -> DataFrame:
    """(f1, f2, value): samples with both features, for every ordered pair that any sample has."""
    a, b = (alts.select("sample", F.col("feature").alias(f)) for f in ("f1", "f2"))
    return a.join(b, "sample").groupBy("f1", "f2").agg(F.count("*").alias("value"))


def sanitised(alts: DataFrame, samples: DataFrame, features: DataFrame, min_group: int = 5, keywords: Sequence[str] = ("GOF", "LOF", "FUSION"), min_residual: int = 5) -> DataFrame:
    """(feature, fate): kept, constant, imbalanced, duplicate, dependent or capacity. The rank test takes the Gram matrix of the candidates to the driver."""
    spark = alts.sparkSession
    report = column_report(alts, samples, features, min_group, keywords)
    rows = report.collect()  # one row per feature
    order = [r["feature"] for r in sorted((r for r in rows if r["place"]), key=lambda r: r["place"])]
    if len(order) > MAX_COLUMNS:
        raise ValueError(f"{len(order)} candidate columns; the rank test takes {MAX_COLUMNS}")
    at = {f: i for i, f in enumerate(order)}
    n = samples.select("sample").distinct().count()
    g = np.zeros((len(order), len(order)))
    wanted = spark.createDataFrame([(f,) for f in order], "feature string")
    used = alts.select("sample", "feature").distinct().join(samples.select("sample").distinct(), "sample", "left_semi").join(wanted, "feature", "left_semi")
    for r in gram(used).collect():  # at most MAX_COLUMNS squared
        g[at[r["f1"]], at[r["f2"]]] = r["value"]
    kept, dependent, over = independent(g, np.diag(g).copy(), n, max(0, n - 1 - min_residual))
    fate = {order[j]: name for name, js in (("kept", kept), ("dependent", dependent), ("capacity", over)) for j in js}
    out = [(r["feature"], r["reason"] or fate[r["feature"]], at.get(r["feature"])) for r in rows]
    return spark.createDataFrame(out, "feature string, fate string, place int")
