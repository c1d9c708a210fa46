"""Alignment of modalities by sample: semi-joins, so that repeated samples never multiply rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patient_id, patient_index


def mapped(df: DataFrame, study: str, column: str = "sample") -> DataFrame:
    """df with patient ids; rows without one drop out, repeats stay."""
    out = df.withColumn(column, patient_id(F.upper(F.col(column)), study)).where(F.col(column).isNotNull())
    return out.withColumn(column, patient_index(F.col(column), study))


def common_samples(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """(sample) that every block has; blocks without rows are passed over."""
    ids = [b.select("sample").distinct() for b in blocks.values() if not b.isEmpty()]
    if not ids:
        raise ValueError("no block has samples")
    return reduce(DataFrame.intersect, ids)


def overlaps(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """(left, right, common): how many samples each pair of blocks shares."""
    ids = reduce(DataFrame.unionByName, (b.select("sample", F.lit(n).alias("block")).distinct() for n, b in blocks.items()))
    other = ids.withColumnRenamed("block", "right")
    return ids.withColumnRenamed("block", "left").join(other, "sample").where("left < right").groupBy("left", "right").agg(F.count("*").alias("common"))


def aligned(blocks: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Each block's rows of the common samples; ValueError if there are none."""
    from ..sources.scratch import stored

    ids = stored(common_samples(blocks))  # every block is joined with them
    if ids.isEmpty():
        raise ValueError(f"no sample is common to {sorted(blocks)}: {[tuple(r) for r in overlaps(blocks).collect()]}")
    return {n: b.join(ids, "sample", "left_semi") for n, b in blocks.items()}


def align_pair(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    return x.join(y.select("sample").distinct(), "sample", "left_semi"), y.join(x.select("sample").distinct(), "sample", "left_semi")


def dense(rows: DataFrame, samples: DataFrame, features: DataFrame, column: str = "feature", value: str = "value") -> DataFrame:
    """Every (sample, feature) with its value or 0. Only for operators that need explicit zeros: quantiles, medians, ranks."""
    grid = samples.select("sample").distinct().crossJoin(features.select(column).distinct())
    return grid.join(rows, ["sample", column], "left").select("sample", column, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value))
