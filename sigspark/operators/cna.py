"""Copy-number states: GISTIC values -2 .. 2 per (sample, gene)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clipped, half_even, number


def state(value: Column) -> Column:
    """The whole state that a value stands for; what is no number is neutral."""
    return clipped(half_even(number(value)), -2, 2).cast("int")


def collapsed(cna: DataFrame) -> DataFrame:
    """(sample, gene, value): repeats of a cell become the state of their mean."""
    states = cna.groupBy("sample", "gene").agg(F.avg(state(F.col("value"))).alias("value"))
    return states.select("sample", "gene", clipped(half_even(F.col("value")), -2, 2).cast("int").alias("value"))


def event_params(cna: DataFrame, samples: DataFrame) -> DataFrame:
    """Per gene: shares of amplified, deleted and neutral samples, and of deep events among each. Samples without a cell are neutral."""
    v = F.col("value")
    counts = collapsed(cna).groupBy("gene").agg(*(F.count_if(c).alias(n) for n, c in (("amp", v > 0), ("del", v < 0), ("amp2", v == 2), ("del2", v == -2))))
    counts = counts.crossJoin(F.broadcast(samples.agg(F.count_distinct("sample").alias("n"))))  # one row
    deep = lambda two, one: F.coalesce(F.try_divide(F.col(two), F.col(one)), F.lit(0.0))
    return counts.select(
        "gene",
        (F.col("amp") / F.col("n")).alias("p_amp"),
        (F.col("del") / F.col("n")).alias("p_del"),
        ((F.col("n") - F.col("amp") - F.col("del")) / F.col("n")).alias("p_neu"),
        deep("amp2", "amp").alias("q_amp2"),
        deep("del2", "del").alias("q_del2"),
    )


def amp_del(cna: DataFrame) -> DataFrame:
    """(sample, feature, value): GENE_AMP and GENE_DEL, 1 where the state is above or below neutral, else 0."""
    rows = cna.select("sample", "gene", state(F.col("value")).alias("v"))
    views = F.array(*(F.struct(F.concat("gene", F.lit(f"_{k}")).alias("feature"), (sign * F.col("v") > 0).cast("int").alias("value")) for k, sign in (("AMP", 1), ("DEL", -1))))
    return rows.select("sample", F.explode(views).alias("x")).select("sample", "x.feature", "x.value")


def dosage(cna: DataFrame) -> DataFrame:
    """(sample, feature, value): GENE__AMP_LVL and GENE__DEL_LVL, how far the mean of a cell's repeats lies above and below neutral."""
    rows = cna.groupBy("sample", "gene").agg(F.avg(number(F.col("value"))).alias("v"))
    views = F.array(*(F.struct(F.concat("gene", F.lit(f"__{k}_LVL")).alias("feature"), F.greatest(sign * F.col("v"), F.lit(0.0)).alias("value")) for k, sign in (("AMP", 1), ("DEL", -1))))
    return rows.select("sample", F.explode(views).alias("x")).select("sample", "x.feature", "x.value")


def with_severity(alterations: DataFrame, cna: DataFrame) -> DataFrame:
    """(sample, feature, value): in GENE_AMP and GENE_DEL the value becomes how strongly the gene is gained or lost; without a state it stays."""
    rows = alterations.withColumn("_gene", F.when(F.col("feature").rlike("_(AMP|DEL)$"), F.regexp_replace("feature", "_(AMP|DEL)$", "")))
    states = cna.select(F.col("sample"), F.col("gene").alias("_gene"), F.col("value").alias("_state"))
    sign = F.when(F.col("feature").endswith("_AMP"), 1).otherwise(-1)
    strength = F.when(F.col("_state").isNotNull(), F.greatest(sign * F.col("_state"), F.lit(0)))  # greatest() alone would pass over a null
    return rows.join(states, ["sample", "_gene"], "left").select("sample", "feature", F.coalesce(strength.cast("double"), F.col("value").cast("double")).alias("value"))
