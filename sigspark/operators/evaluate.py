"""Scoring of predicted signatures against truth, and the signal that the truth leaves in the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, ratio
from .rna import with_factors


def orientation(pairs: DataFrame, truth_alts: DataFrame | None) -> str:
    """alt_first if enough outer keys of (outer, inner) are truth alterations (half of these, at least one), method_first otherwise, unknown without rows."""
    if pairs.isEmpty():
        return "unknown"
    if truth_alts is None:
        return "method_first"
    n = truth_alts.select("alt").distinct().count()
    hits = pairs.select(F.col("outer").alias("alt")).distinct().join(truth_alts, "alt", "left_semi").count()
    return "alt_first" if hits >= max(1, n // 2) else "method_first"


def method_first(pairs: DataFrame, truth_alts: DataFrame | None) -> DataFrame:
    """(method, alt, genes) of (outer, inner, genes), whichever is outside."""
    names = ("inner", "outer") if orientation(pairs, truth_alts) == "alt_first" else ("outer", "inner")
    return pairs.select(F.col(names[0]).alias("method"), F.col(names[1]).alias("alt"), "genes")


def restricted(predictions: DataFrame, alts: DataFrame) -> DataFrame:
    return predictions.join(alts.select("alt").distinct(), "alt", "left_semi")


#: The keys under which a signature may hold its targets, and their effects.
TARGET_KEYS = ("targets", "target_genes", "genes", "signature", "signature_genes")
EFFECT_KEYS = ("effects", "log2fc", "log2FC", "effect_sizes")


def targets_and_effects(sig: Column) -> tuple[Column, Column]:
    """Targets, and their effects in the same order (NULL where missing), of a signature read as map<string, variant JSON text>. Effects are an object by target, or a list beside the targets."""
    first = lambda names: F.coalesce(*(F.try_element_at(sig, F.lit(n)) for n in names))
    effects = first(EFFECT_KEYS)
    named, listed = F.from_json(effects, "map<string,double>"), F.from_json(F.when(F.ltrim(effects).startswith("["), effects), "array<double>")
    targets = F.coalesce(F.from_json(first(TARGET_KEYS), "array<string>"), F.map_keys(named))
    return targets, F.transform(targets, lambda g, i: F.when(listed.isNotNull(), F.get(listed, i)).otherwise(F.try_element_at(named, g)))


def effect_summary(truth: DataFrame) -> DataFrame:
    """Per alt of (alt, gene, log2fc): size, mean, mean and median and largest absolute effect, sample deviation (NULL for one)."""
    e = F.col("log2fc")
    return truth.groupBy("alt").agg(
        F.count("*").alias("n"), F.avg(e).alias("mean"), F.avg(F.abs(e)).alias("mean_abs"), F.median(F.abs(e)).alias("median_abs"), F.max(F.abs(e)).alias("max_abs"), F.stddev_samp(e).alias("sd")
    )


def jaccard(left: Column, right: Column) -> Column:
    """Shared part of two arrays as sets; NULL if both are empty."""
    return F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right)))


def overlaps(truth: DataFrame) -> DataFrame:
    """(alt1, alt2, jaccard) of the pairs of alterations that share targets: a self-join on the gene."""
    sizes = truth.groupBy("alt").agg(F.count("*").alias("n"))
    a = truth.select(F.col("alt").alias("alt1"), "gene")
    b = truth.select(F.col("alt").alias("alt2"), "gene")
    both = a.join(b, "gene").where("alt1 <> alt2").groupBy("alt1", "alt2").agg(F.count("*").alias("shared"))
    both = both.join(sizes.select(F.col("alt").alias("alt1"), F.col("n").alias("n1")), "alt1").join(sizes.select(F.col("alt").alias("alt2"), F.col("n").alias("n2")), "alt2")
    return both.select("alt1", "alt2", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("jaccard"))


def signature_metrics(predictions: DataFrame, truth: DataFrame, genes: DataFrame, check: bool = False) -> DataFrame:
    """Per method and truth alteration: tp, fp, fn, tn and the scores; a missing prediction is empty. predictions: method, alt, gene.

    outside counts predicted and true genes that `genes` lacks; with check=True they raise.
    """
    universe = genes.select("gene").distinct()
    n = F.broadcast(universe.agg(F.count("*").alias("n_genes")))  # one row
    said = predictions.select("method", "alt", "gene").distinct()
    is_true = truth.select("alt", "gene").distinct().withColumn("true", F.lit(1))
    known = universe.withColumn("known", F.lit(1))
    counted = said.join(is_true, ["alt", "gene"], "left").join(known, "gene", "left").groupBy("method", "alt").agg(F.count("true").alias("tp"), F.count("*").alias("said"), F.count_if(F.col("known").isNull()).alias("said_outside"))
    size = is_true.join(known, "gene", "left").groupBy("alt").agg(F.count("*").alias("size"), F.count_if(F.col("known").isNull()).alias("true_outside"))
    grid = predictions.select("method").distinct().crossJoin(size).crossJoin(n)
    rows = grid.join(counted, ["method", "alt"], "left").fillna(0, subset=["tp", "said", "said_outside"])
    rows = rows.withColumn("outside", F.col("said_outside") + F.col("true_outside"))
    if check:
        rows = rows.withColumn("outside", F.when(F.col("outside") > 0, F.raise_error(F.concat(F.lit("genes outside the universe: "), "method", F.lit(" "), "alt")).cast("long")).otherwise(0))
    tp, fp, fn = F.col("tp"), F.col("said") - F.col("tp"), F.col("size") - F.col("tp")
    tn = F.col("n_genes") - tp - fp - fn
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    product = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    return rows.select(
        "method", "alt", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        ratio(tp + tn, F.col("n_genes")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(tp, tp + fp + fn).alias("jaccard"),
        F.when(product > 0, (tp.cast("double") * tn - fp.cast("double") * fn) / F.sqrt(F.when(product > 0, product))).otherwise(0.0).alias("mcc"), "outside",
    )


#: What else a signature may be described by, and is averaged where it is.
DESCRIBED_BY = ("base_snr", "effective_snr", "confound_score", "n_partners_used", "mean_abs_effect", "alt_freq", "mean_abs_log_or", "mean_co_count", "max_co_count", "mean_co_percent", "max_co_percent")


def method_summary(metrics: DataFrame) -> DataFrame:
    """Mean scores per method, how many signatures they are over, and the means of those columns of DESCRIBED_BY that metrics has."""
    names = ("f1", "precision", "recall", "accuracy", "jaccard", "mcc", *(c for c in DESCRIBED_BY if c in metrics.columns))
    return metrics.groupBy("method").agg(*(F.avg(x).alias(x) for x in names), F.count("*").alias("n_signatures_evaluated"))


def _cells(rna: DataFrame, pseudo: float) -> DataFrame:
    """Normalised logarithms of counts less that of a zero count: what is absent is 0, and neither differences of means nor variances change."""
    y = F.ln(1 + pseudo + F.col("count") / F.col("size_factor")) - F.ln(F.lit(1 + pseudo))
    return with_factors(rna).select("sample", "gene", y.alias("u"))


def group_moments(alts: DataFrame, cells: DataFrame, pairs: DataFrame, samples: DataFrame, square: Column | None = None, few: bool = False) -> DataFrame:
    """Per (alt, gene) of pairs: n, sum and sum of squares of u among samples with the alteration (1) and without (0).

    cells: sample, gene, u with absent cells 0; square: what is summed as the square, if it is not u * u. The second group is the
    total less the first, so no dense matrix is made. With few, pairs are few of all alterations and genes: a cell meets the sample's alterations as one array,
    only those of its gene's pairs become rows, and cells are computed once.
    """
    n = F.broadcast(samples.agg(F.count_distinct("sample").alias("n")))  # one row
    u = F.col("u")
    square = u * u if square is None else square
    sums = (F.sum(u).alias("s"), F.sum(square).alias("ss"))
    has = alts.select("sample", F.col("feature").alias("alt")).distinct().join(samples.select("sample").distinct(), "sample", "left_semi")
    carriers = has.groupBy("alt").agg(F.count("*").alias("n1"))
    if few:
        from ..sources.scratch import stored

        none = F.array(F.lit(None).cast("string"))
        asked = F.broadcast(pairs.groupBy("gene").agg(F.concat(F.collect_set("alt"), none).alias("asked")))  # a row per gene
        held = has.groupBy("sample").agg(F.collect_list("alt").alias("held"))
        met = cells.join(held, "sample", "left").join(asked, "gene").withColumn("alt", F.explode("asked")).where(F.col("alt").isNull() | F.array_contains("held", F.col("alt")))
        met = stored(met.groupBy("alt", "gene").agg(*sums))  # the total is the row without alteration
        total, one = met.where("alt is null").drop("alt"), met.where("alt is not null")
    else:
        total = cells.groupBy("gene").agg(*sums)
        wanted = cells.join(pairs.select("gene").distinct(), "gene", "left_semi")
        one = has.join(wanted, "sample").join(pairs.select("alt", "gene").distinct(), ["alt", "gene"], "left_semi").groupBy("alt", "gene").agg(*sums)
    one = one.withColumnsRenamed({"s": "s1", "ss": "ss1"})
    rows = pairs.select("alt", "gene").distinct().join(carriers, "alt").join(total, "gene", "left").join(one, ["alt", "gene"], "left").crossJoin(n).fillna(0.0, subset=["s", "ss", "s1", "ss1"])
    return rows.select("alt", "gene", "n1", (F.col("n") - F.col("n1")).alias("n0"), "s1", (F.col("s") - F.col("s1")).alias("s0"), "ss1", (F.col("ss") - F.col("ss1")).alias("ss0"))


def sample_variance(n: str, s: str, ss: str) -> Column:
    n_, s_ = F.col(n), F.col(s)
    return F.when(n_ > 1, F.greatest((F.col(ss) - s_ * s_ / n_) / (n_ - 1), F.lit(0.0)))


def snr(alts: DataFrame, rna: DataFrame, truth: DataFrame, min_group: int = 1, pseudo: float = 1.0) -> DataFrame:
    """(alteration, snr, n_targets): mean over the targets of |difference of group means| / pooled deviation.

    Targets without variance, or in a group of one, drop out; too small groups give NULL. Scaling a gene changes nothing, so
    the z-scores are not computed. Counts are stored, as several branches read them.
    """
    from ..sources.scratch import stored

    rows = stored(rna.where("count > 0").select("sample", "gene", "count"))
    m = group_moments(alts, _cells(rows, pseudo), stored(truth.select("alt", "gene").distinct()), rows.select("sample").distinct(), few=True)
    mean = lambda g: F.col(f"s{g}") / F.when(F.col(f"n{g}") > 0, F.col(f"n{g}"))
    pooled = F.sqrt((sample_variance("n1", "s1", "ss1") + sample_variance("n0", "s0", "ss0")) / 2)
    enough = (F.col("n1") >= min_group) & (F.col("n0") >= min_group)
    value = F.when(enough & (pooled > 1e-9), F.abs(mean(1) - mean(0)) / F.when(pooled > 1e-9, pooled))
    sizes = truth.groupBy(F.col("alt").alias("alteration")).agg(F.count_distinct("gene").alias("n_targets"))
    means = m.groupBy(F.col("alt").alias("alteration")).agg(F.avg(value).alias("snr"))
    return sizes.join(means, "alteration", "left").select("alteration", "snr", "n_targets")


def confounding(pairs: DataFrame, truth: DataFrame, metric: str = "log_odds_smooth", cap: float = 6.0, min_co_count: int = 0, p_below: float | None = None) -> DataFrame:
    """(alteration, confound_score, n_partners_used): sum over partners that share targets of association times overlap."""
    if metric not in ("log_odds_smooth", "abs_log_odds_smooth"):
        raise ValueError(f"unknown association {metric!r}")
    rows = pairs.where(F.col("co_count") >= min_co_count)
    rows = rows if p_below is None else rows.where(F.col("p") < p_below)
    link = F.greatest(F.least(finite(F.ln("odds_smooth")), F.lit(cap)), F.lit(-cap))
    link = F.abs(link) if metric.startswith("abs") else link
    both = F.explode(F.array(F.struct(F.col("alt1").alias("x"), F.col("alt2").alias("y")), F.struct(F.col("alt2").alias("x"), F.col("alt1").alias("y"))))
    links = rows.select(both.alias("e"), link.alias("link")).where("link is not null").select(F.col("e.x").alias("alt1"), F.col("e.y").alias("alt2"), "link")
    return links.join(overlaps(truth), ["alt1", "alt2"]).groupBy(F.col("alt1").alias("alteration")).agg(F.sum(F.col("link") * F.col("jaccard")).alias("confound_score"), F.count("*").alias("n_partners_used"))


def effective_snr(base: DataFrame, confounded: DataFrame, mode: str = "divide", weight: float = 1.0) -> DataFrame:
    """base (alteration, snr, n_targets) with the score that confounding leaves, highest first."""
    if mode not in ("divide", "subtract"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = base.join(confounded, "alteration", "left").fillna(0, subset=["n_partners_used"]).fillna(0.0, subset=["confound_score"])
    left = F.try_divide(F.col("snr"), 1 + F.col("confound_score")) if mode == "divide" else F.col("snr") - weight * F.col("confound_score")
    return rows.select("alteration", F.col("snr").alias("snr_base"), "n_targets", "confound_score", "n_partners_used", left.alias("effective_snr")).orderBy(F.desc_nulls_last("effective_snr"), "alteration")


def robustness(alts: DataFrame, samples: DataFrame, rna: DataFrame, truth: DataFrame, pairs: DataFrame, min_group: int = 1, min_co_count: int = 0, p_below: float | None = None) -> DataFrame:
    """Per truth alteration: effects, frequency, SNR before and after confounding, and its pairs. The SNR is computed once."""
    from .cooccurrence import frequencies, pair_summary

    e = F.col("log2fc")
    meta = truth.groupBy(F.col("alt").alias("alteration")).agg(
        F.count("*").alias("sig_size"), F.avg(F.abs(e)).alias("mean_abs_effect"), F.median(F.abs(e)).alias("median_abs_effect"), F.avg(e).alias("mean_signed_effect"), F.median(e).alias("median_signed_effect")
    )
    used = pairs.where(F.col("co_count") >= min_co_count)
    used = used if p_below is None else used.where(F.col("p") < p_below)
    freq = frequencies(alts).select(F.col("feature").alias("alteration"), F.col("ones").alias("alt_freq"))
    scores = effective_snr(snr(alts, rna, truth, min_group), confounding(pairs, truth)).drop("n_targets").withColumnRenamed("snr_base", "base_snr")
    return meta.join(freq, "alteration", "left").fillna(0, subset=["alt_freq"]).join(scores, "alteration", "left").join(pair_summary(used), "alteration", "left")


def adjusted(rows: DataFrame, p: str = "pvalue", by: tuple[str, ...] = ()) -> DataFrame:
    """rows with padj, the Benjamini-Hochberg value of p within `by`, or of all rows; NULL for NULL."""
    if not by:
        return rows.join(_adjusted_values(rows.select(F.col(p).alias("_p"))), F.col(p) == F.col("_p"), "left").drop("_p")
    group = Window.partitionBy(*by)
    ranked = rows.withColumn("_rank", F.rank().over(group.orderBy(F.col(p).asc_nulls_last())) + F.count(p).over(group.orderBy(F.col(p).asc_nulls_last()).rangeBetween(0, 0)) - 1)
    ranked = ranked.withColumn("_raw", F.col(p) * F.count(p).over(group) / F.col("_rank"))
    back = group.orderBy(F.col(p).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("padj", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(back)))).drop("_rank", "_raw")


def _adjusted_values(rows: DataFrame) -> DataFrame:
    """(_p, padj) of the distinct values of _p. Ranges of them are partitions, stored once; how many values lie before a range, and the least raw value
    after it, are numbers per range that pass through the driver, so no window goes over a range's edge. Copies of a value are counted before anything is sorted."""
    from ..sources.scratch import folder

    spark = rows.sparkSession
    path = f"{folder(spark)}/ranges"
    rows.where("_p is not null").groupBy("_p").agg(F.count("*").alias("_n")).repartitionByRange("_p").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before, least, total = {}, {}, 0
    for r in dealt.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect():  # a row per range
        before[r["_part"]], total = total, total + r["n"]
    edges = lambda d, name, kind: F.broadcast(spark.createDataFrame(list(d.items()), f"_part int, {name} {kind}"))
    own = Window.partitionBy("_part")
    rank = F.col("_before") + F.sum("_n").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = dealt.join(edges(before, "_before", "long"), "_part").withColumn("_raw", F.col("_p") * F.lit(total) / rank)
    after = math.inf
    for r in sorted(ranked.groupBy("_part").agg(F.min("_raw").alias("m")).collect(), key=lambda r: -r["_part"]):  # a row per range
        least[r["_part"]], after = after, min(after, r["m"])
    back = own.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.join(edges(least, "_after", "double"), "_part").select("_p", F.least(F.lit(1.0), F.min("_raw").over(back), F.col("_after")).alias("padj"))


def significant(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    return rows.where(F.col("padj") < alpha)
