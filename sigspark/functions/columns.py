"""Scalar functions on columns. NaN never passes: missing is NULL."""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

AMP_DEL = ("AMP", "DEL")


# ---- identifiers -------------------------------------------------------------------------------------------------


def patient_id(sample: Column, study: str) -> Column:
    """The patient part of a sample id, NULL where the id has none; other studies keep the trimmed id."""
    pattern = {"TCGA": r"TCGA-\w{2}-\w{4}", "TARGET": r"TARGET-\d{2}-[A-Z0-9]{6}"}.get(study.upper())
    trimmed = F.trim(sample)
    return F.regexp_substr(trimmed, F.lit(pattern)) if pattern else trimmed


def patient_index(sample: Column, study: str | None = None) -> Column:
    """Trimmed and upper-cased; TCGA ids are cut to the 12 characters that name the patient."""
    name = F.upper(F.trim(sample))
    return F.substring(name, 1, 12) if (study or "").upper() == "TCGA" else name


def header(name: str) -> str:
    return name.strip().upper().replace(" ", "_")


def r_names(columns: Sequence[str]) -> list[str]:
    """Names that formula languages accept, in order; the n-th repeat of a name ends in __n."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        name = re.sub(r"[^0-9A-Za-z_]", "_", c) or "X"
        name = f"X_{name}" if name[0].isdigit() else name
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}__{seen[name]}" if seen[name] else name)
    return out


def design_name(name: Column) -> Column:
    return F.translate(name, "-:/ ", "____")


def contrast_name(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit("-"))


# ---- alteration names --------------------------------------------------------------------------------------------


def alteration_kind(alt: Column) -> Column:
    """GOF, LOF, AMP, DEL or FUSION by the suffix, else OTHER."""
    out = F.lit("OTHER")
    for kind in ("FUSION", "DEL", "AMP", "LOF", "GOF"):
        out = F.when(alt.endswith(f"_{kind}"), kind).otherwise(out)
    return out


def _fusion_partners(alt: Column) -> Column:
    body = F.regexp_replace(alt, "_FUSION$", "")
    return F.when(F.contains(body, F.lit("--")), F.split(body, "--")).otherwise(F.split(body, "-"))


def alteration_partners(alt: Column) -> Column:
    """Genes of a fusion; empty for other kinds."""
    return F.when(alt.endswith("_FUSION"), _fusion_partners(alt)).otherwise(F.array().cast("array<string>"))


def alteration_gene(alt: Column) -> Column:
    """The gene that an alteration is named for; the first partner of a fusion; NULL for OTHER."""
    cut = F.regexp_replace(alt, "_(GOF|LOF|AMP|DEL)$", "")
    return F.when(alt.endswith("_FUSION"), F.element_at(_fusion_partners(alt), 1)).when(alteration_kind(alt) != "OTHER", cut)


def simulated_genes(alt: Column) -> Column:
    """Genes that a simulation must contain: fusion names are split at every hyphen, _MUT and others give none."""
    fusion = F.split(F.regexp_replace(alt, "_FUSION", ""), "-")
    single = F.array(F.regexp_replace(alt, "_[^_]*$", ""))
    kind = alteration_kind(alt)
    return F.when(kind == "FUSION", fusion).when(kind != "OTHER", single).otherwise(F.array().cast("array<string>"))


def gene_prefix(feature: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(feature, "_", 1)


def block_of(feature: Column) -> Column:
    """The block a simulated feature belongs to, by its name: mut, fusion, cna, subtype or clinical."""
    return (
        F.when(feature.rlike("_(MUT|GOF|LOF)$"), "mut")
        .when(feature.rlike("_FUS(ION)?"), "fusion")
        .when(feature.rlike("_(CNA|AMP|DEL|AMP_LVL|DEL_LVL)$"), "cna")
        .when(F.lower(feature) == "subtype", "subtype")
        .otherwise("clinical")
    )


def as_list(text: Column) -> Column:
    """Items of a text that separates them by ';', else by ','; blanks are left out; NULL gives none."""
    by = F.when(F.contains(text, F.lit(";")), F.split(text, ";")).otherwise(F.split(text, ","))
    return F.coalesce(F.filter(F.transform(by, lambda x: F.trim(x)), lambda x: F.length(x) > 0), F.array().cast("array<string>"))


# ---- arithmetic --------------------------------------------------------------------------------------------------


def number(x: Column) -> Column:
    """The number that a column holds or spells, else 0."""
    return F.coalesce(finite(x.try_cast("double")), F.lit(0.0))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def half_even(x: Column) -> Column:
    return F.rint(x)


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def odds_smooth(a: Column, b: Column, c: Column, d: Column) -> Column:
    return ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))


def odds(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Odds ratio: infinite where only the denominator is 0, NULL where a margin is empty."""
    empty = (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)
    return F.when(empty, None).when(b * c == 0, float("inf")).otherwise(a * d / F.when(b * c != 0, b * c))


def lognormal_mu(mean: Column, median: Column) -> Column:
    return F.when(_spread(mean, median), F.ln(median))


def lognormal_sigma(mean: Column, median: Column) -> Column:
    """Scale of the lognormal law with this mean and median."""
    return F.when(_spread(mean, median), F.sqrt(F.greatest(2 * (F.ln(mean) - F.ln(median)), F.lit(1e-6))))


def _spread(mean: Column, median: Column) -> Column:
    return (finite(mean) > 0) & (finite(median) > 0)


def effect_cap(mean: Column, largest: Column, k: float = 8.0, most: float = 12.0) -> Column:
    """Cap on absolute effects: the larger of the largest seen and k means, at most `most`; `most` unless both are positive."""
    known = (finite(mean) > 0) & (finite(largest) > 0)
    return F.coalesce(F.when(known, F.least(F.greatest(largest, k * mean), F.lit(most))), F.lit(most))


def theory_c1(mu1: float, mu0: float, n1: float, n0: float, p: float, q: float) -> float:
    """Expected slope of z alone when only x has an effect: x is 1 in n1 rows and 0 in n0, z is 1 in a share p of the first and q of the others."""
    with_z = (n1 * p * mu1 + n0 * q * mu0) / (n1 * p + n0 * q)
    without = (n1 * (1 - p) * mu1 + n0 * (1 - q) * mu0) / (n1 * (1 - p) + n0 * (1 - q))
    return log(with_z) - log(without)


def nonempty(df) -> bool:
    """Whether a frame has a column and a row."""
    return bool(df.columns) and not df.isEmpty()
