"""What a single-variable model sees of an effect it shares with a correlated variable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import theory_c1, uniform
from .simulate import nb_counts


def design(spark: SparkSession, n0: int, n1: int, p: float, q: float, reps: int = 1) -> DataFrame:
    """(rep, i, x, z): x is 0 in the first n0 rows and 1 in the others; z is 1 with probability p where x is 1, q elsewhere."""
    rows = spark.range(n0 + n1).withColumnRenamed("id", "i").withColumn("x", (F.col("i") >= n0).cast("int"))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return rows.select("rep", "i", "x", (uniform(F.col("rep"), "z", F.col("i")) < F.when(F.col("x") == 1, p).otherwise(q)).cast("int").alias("z"))


def expression(rows: DataFrame, mu0: float = 100.0, log_fc: float = 1.0, dispersion: float = 0.1, seed: int = 44) -> DataFrame:
    """design with y: negative binomial counts with mean mu0 * exp(log_fc * x)."""
    named = rows.select(F.concat_ws("|", "rep", "i").alias("sample"), F.lit("y").alias("gene"), F.lit(mu0) * F.exp(log_fc * F.col("x")), *rows.columns).toDF("sample", "gene", "mu", *rows.columns)
    one = rows.sparkSession.createDataFrame([("y", float(dispersion))], "gene string, dispersion double")
    drawn = nb_counts(named.select("sample", "gene", "mu"), one, seed=seed)
    return named.join(drawn, ["sample", "gene"]).select(*rows.columns, F.col("count").alias("y"))


def single_slope(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, slope) of a log-linear model with one binary variable: it is saturated, so the slope is the difference of the logarithms of two means, whatever the dispersion."""
    mean = lambda v: F.avg(F.when(F.col(x) == v, F.col(y)))
    return rows.groupBy(by).agg((F.ln(mean(1)) - F.ln(mean(0))).alias("slope"))


def slopes_by_alteration(alts: DataFrame, y: DataFrame) -> DataFrame:
    """(alt, slope) of the same model for each alteration (sample, feature) and y (sample, y): the samples without it are the total less those with it."""
    total = F.broadcast(y.agg(F.count("*").alias("n"), F.sum("y").alias("s")))  # one row
    mine = alts.select("sample", F.col("feature").alias("alt")).distinct().join(y, "sample", "left").groupBy("alt").agg(F.count("y").alias("n1"), F.sum("y").alias("s1"))
    mean1, mean0 = F.try_divide("s1", "n1"), F.try_divide(F.col("s") - F.col("s1"), F.col("n") - F.col("n1"))
    return mine.crossJoin(total).select("alt", (F.ln(mean1) - F.ln(mean0)).alias("slope"))


def replicates(spark: SparkSession, n0: int = 1000, n1: int = 1000, p: float = 0.8, q: float = 0.2, mu0: float = 100.0, log_fc: float = 1.0, dispersion: float = 0.1, reps: int = 100, seed: int = 44) -> DataFrame:
    """(rep, slope_x, slope_z, theory_z): fitted slopes of all replicates at once, and the expected one of z alone."""
    from math import exp

    rows = expression(design(spark, n0, n1, p, q, reps), mu0, log_fc, dispersion, seed)
    x = single_slope(rows, "rep", "x", "y").withColumnRenamed("slope", "slope_x")
    z = single_slope(rows, "rep", "z", "y").withColumnRenamed("slope", "slope_z")
    return x.join(z, "rep").withColumn("theory_z", F.lit(theory_c1(mu0 * exp(log_fc), mu0, n1, n0, p, q)))


def replicate_means(rows: DataFrame) -> DataFrame:
    """(replicates, mean_slope_x, mean_slope_z, theory_z, bias_z): means over the replicates, and how far the slope of z alone is from the expected one."""
    out = rows.agg(F.count("*").alias("replicates"), F.avg("slope_x").alias("mean_slope_x"), F.avg("slope_z").alias("mean_slope_z"), F.avg("theory_z").alias("theory_z"))
    return out.withColumn("bias_z", F.col("mean_slope_z") - F.col("theory_z"))
