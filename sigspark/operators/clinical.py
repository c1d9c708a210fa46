"""Clinical tables: one row per sample, few columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import config
from ..functions import finite, header

#: Columns that may hold the subtype, the first one present is taken; and columns that are numbers.
SUBTYPES = ("CANCER_SUBTYPE_CURATED", "ONCOTREE_CODE", "ONCOTREE", "SUBTYPE", "DISEASE_SUBTYPE", "DISEASE", "CANCER_TYPE", "CANCER_TYPE_DETAILED")
NUMERIC = ("DIAGNOSIS_AGE", "TMB", "MSISENSOR_SCORE", "MSI_MANTIS_SCORE", "AGE", "ANEUPLOIDY_SCORE", "TUMOR_BREAK_LOAD", "TMB_(NONSYNONYMOUS)")


def subtypes(samples: DataFrame, min_samples: int = 5) -> DataFrame:
    """(sample, subtype) of the subtypes that at least min_samples rows have."""
    names = {header(c): c for c in reversed(samples.columns)}
    column = next((names[c] for c in SUBTYPES if c in names), None)
    if column is None:
        raise ValueError(f"no subtype column among {samples.columns}")
    rows = samples.select("sample", F.col(f"`{column}`").alias("subtype")).where("subtype is not null")
    large = rows.groupBy("subtype").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples)
    return rows.join(F.broadcast(large.select("subtype")), "subtype", "left_semi").select("sample", "subtype")  # a row per subtype


def known_columns(df: DataFrame, cancer: str) -> list[str]:
    """Names of columns, sorted, in which a pattern of the cancer is found, whatever the case."""
    if cancer not in config.CLINICAL:
        raise ValueError(f"unknown cancer {cancer!r}; known: {sorted(config.CLINICAL)}")
    return sorted(c for c in df.columns if any(re.search(p, c, re.IGNORECASE) for p in config.CLINICAL[cancer]))


def missing_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share) of nulls, in one pass."""
    one = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in columns))
    return one.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "share")


def without_missing(df: DataFrame, columns: Sequence[str], most: float = 0.25) -> DataFrame:
    """sample and the columns with a share of nulls of at most `most`; null text becomes Unknown."""
    kept = {r["column"] for r in missing_shares(df, columns).where(F.col("share") <= most).collect()}  # a row per column
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name in kept]
    return df.select("sample", *(F.col(f"`{c}`") for c in columns if c in kept)).fillna("Unknown", subset=texts)


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(sample, feature, value): COLUMN_level with 1.0 for the level that a sample has."""
    long = df.unpivot(["sample"], [F.col(f"`{c}`") for c in columns], "column", "level")
    return long.where("level is not null").select("sample", F.concat_ws("_", "column", "level").alias("feature"), F.lit(1.0).alias("value"))


def standardised(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, feature, value) as z-scores over all samples (population deviation, 0 for constants). Absent cells are 0 before scaling."""
    n = F.broadcast(samples.agg(F.count_distinct("sample").alias("n")))  # one row
    v = F.col("value")
    moments = rows.groupBy("feature").agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss")).crossJoin(n).select("feature", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))).alias("sd"))
    grid = samples.select("sample").distinct().crossJoin(moments)
    z = F.when(F.col("sd") > 1e-12, (F.coalesce(v, F.lit(0.0)) - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return grid.join(rows, ["sample", "feature"], "left").select("sample", "feature", z.alias("value"))


def encode(alterations: DataFrame, clinical: DataFrame, rna_samples: DataFrame, cancer: str, most_missing: float = 0.25) -> DataFrame:
    """(sample, feature, value): alterations and known clinical columns of the samples that all three have, one-hot and standardised.

    A null number is 0 after scaling: the mean and deviation are over the numbers there are.
    """
    columns = known_columns(clinical, cancer)
    table = without_missing(clinical, columns, most_missing)
    samples = alterations.select("sample").distinct().intersect(table.select("sample").distinct()).intersect(rna_samples.select("sample").distinct())
    table = table.join(samples, "sample", "left_semi")
    numeric = [f.name for f in table.schema.fields if f.name != "sample" and (header(f.name) in NUMERIC or isinstance(f.dataType, NumericType))]
    levels = [c for c in table.columns if c != "sample" and c not in numeric]
    parts = [alterations.join(samples, "sample", "left_semi").select("sample", "feature", F.col("value").cast("double").alias("value"))]
    if levels:
        parts.append(one_hot(table, levels))
    out = standardised(reduce(DataFrame.unionByName, parts), samples)
    if numeric:
        long = table.select("sample", *(finite(F.col(f"`{c}`").try_cast("double")).alias(c) for c in numeric)).unpivot(["sample"], [F.col(f"`{c}`") for c in numeric], "feature", "value")
        over = Window.partitionBy("feature")
        sd = F.stddev_pop("value").over(over)
        out = out.unionByName(long.select("sample", "feature", F.coalesce(F.when(sd > 0, (F.col("value") - F.avg("value").over(over)) / sd), F.lit(0.0)).alias("value")))
    return out
