"""Variants to alteration features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


def classify_variant(gene: Column, disease: str, variant: Column) -> Column:
    """GOF, LOF, Unclear or Drop, by the first rule that fits. Gene and disease are compared in upper case, the variant class as it is."""
    gene, disease = F.upper(gene), disease.upper()
    truncating, missense = variant.isin(*config.TRUNCATING), variant.isin(*config.MISSENSE)
    oncogene, suppressor = gene.isin(*config.oncogenes(disease)), gene.isin(*config.suppressors(disease))
    rules = [(variant.isin(*config.DROPPED), "Drop")]
    if disease in ("ALL", "T-ALL"):
        rules.append((gene == "NOTCH1", "GOF"))
    if disease == "AML":
        rules.append(((gene == "NPM1") & truncating, "GOF"))
    rules += [
        (gene.isin(*config.MISSENSE_DRIVERS) & missense, "GOF"),
        (oncogene & (missense | variant.isin(*config.INFRAME)), "GOF"),
        (oncogene & truncating, "Unclear"),  # before the suppressor rules: such a gene is not lost
        (suppressor & (truncating | variant.isin(*config.SPLICE)), "LOF"),
    ]
    out = F.lit("Unclear")
    for fits, label in reversed(rules):
        out = F.when(fits, label).otherwise(out)
    return out


def functional_features(maf: DataFrame) -> DataFrame:
    """(sample, feature): GENE_GOF and GENE_LOF wherever a variant with that label stands. maf: sample, gene, label."""
    return maf.where(F.col("label").isin("GOF", "LOF")).select("sample", F.concat_ws("_", "gene", "label").alias("feature")).distinct()


def uncertain_frequency(maf: DataFrame, labels: Sequence[str] = ("Unclear",)) -> DataFrame:
    """(gene, freq): uncertain variants of the gene per sample that has any uncertain variant."""
    rows = maf.where(F.col("label").isin(*labels))
    carriers = rows.agg(F.count_distinct("sample").alias("carriers"))
    return rows.groupBy("gene").count().crossJoin(F.broadcast(carriers)).select("gene", (F.col("count") / F.col("carriers")).alias("freq"))  # one row


def uncertain_genes(maf: DataFrame, top_k: int | None = 100, min_freq: float = 0.02, labels: Sequence[str] = ("Unclear",)) -> DataFrame:
    """(gene, freq): the top_k genes by frequency, ties by name; without top_k those of at least min_freq. Genes with functional variants are left out afterwards."""
    freq = uncertain_frequency(maf, labels)
    picked = freq.orderBy(F.desc("freq"), "gene").limit(top_k) if top_k else freq.where(F.col("freq") >= min_freq)
    functional = maf.where(F.col("label").isin("GOF", "LOF")).select("gene").distinct()
    return picked.join(functional, "gene", "left_anti")


def maf_features(maf: DataFrame, include_uncertain: bool = True, top_k: int | None = 100, min_freq: float = 0.02, labels: Sequence[str] = ("Unclear",)) -> DataFrame:
    """(sample, feature) of every feature that some sample has: GENE_GOF, GENE_LOF and, for picked uncertain genes, GENE_MUT."""
    out = functional_features(maf)
    if include_uncertain:
        genes = uncertain_genes(maf, top_k, min_freq, labels).select("gene")
        found = maf.where(F.col("label").isin(*labels)).join(genes, "gene", "left_semi")
        out = out.unionByName(found.select("sample", F.concat("gene", F.lit("_MUT")).alias("feature")).distinct())
    return out


def fusion_counts(rows: DataFrame) -> DataFrame:
    """(sample, feature, value): how often each fusion is listed. rows: sample, site1, site2; null symbols drop out."""
    named = rows.where(F.col("site1").isNotNull() & F.col("site2").isNotNull())
    return named.groupBy("sample", F.concat(F.col("site1"), F.lit("--"), F.col("site2"), F.lit("_FUSION")).alias("feature")).agg(F.count("*").alias("value"))


def frequent_features(rows: DataFrame, samples: DataFrame, threshold: float = 0.02, least: int = 3, small: int = 100, top: int | None = None) -> DataFrame:
    """Rows of (sample, feature, value) whose feature is frequent: with fewer than `small` samples in at least `least` of them, else in a share of `threshold`, then the `top` most frequent."""
    n = F.broadcast(samples.select(F.count_distinct("sample").alias("n")))  # one row
    seen = rows.where("value <> 0").groupBy("feature").agg(F.count_distinct("sample").alias("ones")).crossJoin(n)
    kept = seen.where(F.when(F.col("n") < small, F.col("ones") >= least).otherwise(F.col("ones") / F.col("n") >= threshold))
    if top:
        kept = kept.where(F.col("n") < small).unionByName(kept.where(F.col("n") >= small).orderBy(F.desc("ones"), "feature").limit(top))
    return rows.join(kept.select("feature"), "feature", "left_semi")


def top_features(rows: DataFrame, top: int) -> DataFrame:
    """Rows of the `top` features by the number of samples with a value other than 0, ties by name."""
    seen = rows.where("value <> 0").groupBy("feature").agg(F.count_distinct("sample").alias("ones"))
    return rows.join(seen.orderBy(F.desc("ones"), "feature").limit(top).select("feature"), "feature", "left_semi")
