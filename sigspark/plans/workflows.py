"""The three entry points: raw files to aligned blocks, blocks to a simulated data set, predictions to scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import simulated_genes
from ..operators import align, clinical, cna, cooccurrence, design, evaluate, knn, mutations, rna, simulate
from ..sources import readers, scratch, writers


@dataclass
class Study:
    """Aligned blocks of a study."""

    mutations: DataFrame
    cna: DataFrame
    fusions: DataFrame
    subtypes: DataFrame
    clinical: DataFrame
    rna: DataFrame


def integrate(spark: SparkSession, mut_path: str, cna_path: str, fusion_path: str | None, patient_path: str, sample_path: str, rna_path: str, study: str, disease: str, cna_genes_in_rows: bool = True, rna_genes_in_rows: bool = False,
              cna_top: int = 200, min_subtype: int = 3, mut_freq: float = 0.02, fusion_freq: float = 0.02, rename: bool = True, onehot: bool = False, uncertain_top: int = 100, metadata_rows: int = 4) -> Study:
    """Reads, maps to patients, aligns by the samples that all non-empty blocks share, and keeps frequent features."""
    to_patient = lambda df: align.mapped(df, study)
    if onehot:
        features = to_patient(readers.read_alterations(spark, mut_path)).select("sample", "feature", "value")
    else:
        maf = to_patient(readers.read_maf(spark, mut_path))
        if "label" not in maf.columns:
            maf = maf.withColumn("label", mutations.classify_variant(F.col("gene"), disease, F.col("variant")))
        features = mutations.maf_features(maf, top_k=uncertain_top).withColumn("value", F.lit(1))
    copies = to_patient(readers.read_cna(spark, cna_path, cna_genes_in_rows, rename))
    listed = readers.read_fusions(spark, fusion_path) if fusion_path else spark.createDataFrame([], "sample string, site1 string, site2 string")
    fusions = mutations.fusion_counts(to_patient(listed))
    samples = to_patient(readers.read_clinical(spark, sample_path, metadata_rows))
    patients = readers.read_clinical(spark, patient_path, metadata_rows)
    subtype = clinical.subtypes(samples, min_subtype)
    counts = to_patient(readers.read_rna(spark, rna_path, rna_genes_in_rows))
    features, copies, fusions = (scratch.stored(df) for df in (features, copies, fusions))  # each is read for its samples, its features and its rows
    held = scratch.stored(to_patient(readers.rna_samples(spark, rna_path, rna_genes_in_rows)).distinct())
    found = align.aligned({"mutations": features, "cna": copies, "fusions": fusions, "subtypes": subtype, "rna": held})
    ids = found["rna"]
    return Study(
        mutations.frequent_features(found["mutations"], ids, mut_freq, top=300),
        mutations.top_features(found["cna"], cna_top),
        mutations.frequent_features(found["fusions"], ids, fusion_freq),
        found["subtypes"],
        samples.join(patients, "sample"),
        counts.join(ids, "sample", "left_semi"),
    )


@dataclass
class Simulation:
    counts: DataFrame
    alterations: DataFrame
    signatures: DataFrame
    background: DataFrame


def simulate_expression(rna_counts: DataFrame, real_alts: DataFrame, sim_alts: DataFrame, summary: DataFrame | None = None, signatures: DataFrame | None = None, cna_states: DataFrame | None = None,
                        n_genes: int = 10_000, k: int = 5, seed: int = 44, concentration: float = 1.0, residual: float = 0.0) -> Simulation:
    """Counts of simulated samples: genes, background from near real samples, signatures, their effects, and noise. Either signatures or the summary to draw them from."""
    if signatures is None and summary is None:
        raise ValueError("signatures, or a summary to draw them from, are needed")
    samples = rna_counts.select("sample").distinct()
    stats = simulate.moment_dispersions(rna_counts, samples)
    altered = sim_alts.select(F.explode(simulated_genes(F.col("feature"))).alias("gene")).distinct()
    genes = simulate.gene_set(stats, altered, n_genes)
    used = rna_counts.join(genes, "gene", "left_semi")
    features = knn.common_features(real_alts, sim_alts)
    to_vectors = lambda df: knn.vectors(df, df, features)
    near = knn.nearest(to_vectors(sim_alts), to_vectors(real_alts), max(2, k)).select(F.col("query").alias("sim"), "neighbor")
    background = simulate.mixed_background(near, used, seed, concentration, residual).withColumnRenamed("sim", "sample")
    if signatures is None:
        params = simulate.alteration_params(summary).join(sim_alts.select(F.col("feature").alias("alt")).distinct(), "alt", "left_semi")
        signatures = simulate.signatures(params, genes, seed)
    strength = sim_alts if cna_states is None else cna.with_severity(sim_alts, cna_states)
    changed = simulate.induced(background, strength, signatures)
    counts = simulate.nb_counts(changed, stats, signatures.select("gene"), seed)
    return Simulation(counts, sim_alts, signatures, background)


@dataclass
class Evaluation:
    individual: DataFrame
    overall: DataFrame
    fates: DataFrame
    diagnostics: DataFrame
    robustness: DataFrame | None = None


def diagnosed(dataset: str, alts: DataFrame, fates: DataFrame, truth: DataFrame, scores: DataFrame, genes: DataFrame, robust: DataFrame | None, **parameters) -> DataFrame:
    """One row on an evaluation: how many methods, true and kept alterations, scores and genes there are, the alterations' shape before and after
    the design was made sound, what was left out and why, and the parameters as text."""
    shape = lambda df, tag: df.agg(F.count_distinct("sample").alias(f"{tag}_samples"), F.count_distinct("feature").alias(f"{tag}_features"))
    kept = fates.where("fate = 'kept'").select("feature")
    left = fates.where("fate <> 'kept'").groupBy("fate").agg(F.array_sort(F.collect_list("feature")).alias("features"), F.count("*").alias("n"))
    out = truth.agg(F.count_distinct("alt").alias("n_true_alterations"))
    for one in (
        kept.agg(F.count("*").alias("n_kept_alterations")),
        scores.agg(F.count_distinct("method").alias("n_methods"), F.count("*").alias("n_scores")),
        genes.agg(F.count_distinct("gene").alias("n_genes")),
        shape(alts, "raw"),
        shape(alts.join(kept, "feature", "left_semi"), "clean"),
        left.agg(F.map_from_entries(F.collect_list(F.struct("fate", "n"))).alias("left_out"), F.map_from_entries(F.collect_list(F.struct("fate", "features"))).alias("left_out_features")),
        scores.limit(0).agg(F.count("*").alias("n_robust")) if robust is None else robust.agg(F.count("*").alias("n_robust")),
    ):
        out = out.crossJoin(F.broadcast(one))  # a row each
    return out.select(F.lit(dataset).alias("dataset"), "*", F.lit("off" if robust is None else "computed").alias("robustness"), *(F.lit(str(v)).alias(k) for k, v in parameters.items()))


def evaluate_predictions(dataset: str, alts: DataFrame, samples: DataFrame, rna_counts: DataFrame, truth: DataFrame, predictions: DataFrame, genes: DataFrame, filter_alts: bool = True, min_group: int = 5, min_residual: int = 5, with_robustness: bool = True) -> Evaluation:
    """Scores of (method, alt, gene) against truth (alt, gene, log2fc), over the alterations that a design matrix can hold."""
    features = alts.select("feature").distinct()
    fates = scratch.stored(design.sanitised(alts, samples, features, min_group, min_residual=min_residual) if filter_alts else features.withColumn("fate", F.lit("kept")).withColumn("place", F.lit(0)))  # a row per feature
    kept = fates.where("fate = 'kept'").select(F.col("feature").alias("alt"))
    truth = truth.join(kept, "alt", "left_semi")
    scores = evaluate.signature_metrics(evaluate.restricted(predictions, kept), truth, genes)
    individual = scores.join(evaluate.effect_summary(truth), "alt", "left").withColumn("dataset", F.lit(dataset))
    robust = None
    if with_robustness:
        used = alts.join(kept.withColumnRenamed("alt", "feature"), "feature", "left_semi")
        pairs = scratch.stored(cooccurrence.fisher_pairs(used, samples))
        robust = evaluate.robustness(used, samples, rna_counts, truth, pairs, min_group)
        individual = individual.join(robust.withColumnRenamed("alteration", "alt"), "alt", "left")
    overall = evaluate.method_summary(individual).withColumn("dataset", F.lit(dataset)).orderBy("method")
    notes = diagnosed(dataset, alts, fates, truth, scores, genes, robust, min_group=min_group, min_residual=min_residual, filtered=filter_alts)
    return Evaluation(individual, overall, fates, notes, robust)


def evaluate_dataset(spark: SparkSession, dataset: str, base_dir: str, out: str | None = None, **options) -> Evaluation:
    """Reads a data set's folder, scores its predictions by `evaluate_predictions` with the options, and writes the results."""
    at = f"{base_dir}/{dataset}"
    alts = readers.read_alterations(spark, f"{at}/alterations_{dataset}.csv")
    counts = readers.read_rna(spark, f"{at}/rna_simulated_{dataset}.csv", zeros=False)
    nested = readers.read_truth(spark, f"{at}/true_signatures_{dataset}.json")
    truth = nested.select("alt", F.explode("targets").alias("gene"), "effects").select("alt", "gene", F.try_element_at("effects", F.col("gene")).alias("log2fc"))
    said = evaluate.method_first(readers.read_predictions(spark, f"{at}/signatures_{dataset}.json"), truth).select("method", "alt", F.explode("genes").alias("gene"))
    result = evaluate_predictions(dataset, alts, counts.select("sample").distinct(), counts, truth, said, readers.gene_universe(spark, f"{at}/rna_simulated_{dataset}.csv"), **options)
    if out:
        writers.write_evaluation(out, dataset, result.individual, result.overall, said.groupBy("method", "alt").agg(F.collect_list("gene").alias("genes")), result.diagnostics)
    return result
