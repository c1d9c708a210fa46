"""Queries of readers, writers and helpers: tables are written as study files and read again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contrast_name, design_name, r_names, uniform
from ..operators import align, cooccurrence, deconfounder, evaluate, knn, linear, simulate, theory
from ..sources import readers, scratch, writers
from . import views as v
from . import workflows
from .queries import _FISHER, QUERIES, SQL, query, rounded
from .views import u_sql, with_views

__all__ = ["QUERIES", "SQL"]

# ---- readers and writers -----------------------------------------------------------------------------------------


def _written(rows: DataFrame, column: str, value: str, **options) -> str:
    path = f"{scratch.folder(rows.sparkSession)}/table.csv"
    writers.write_matrix(rows, column, value, path, **options)
    return path


@query(f"{with_views('cna')} SELECT s.sample, g.gene, g.gene || '_CNA' AS feature, coalesce(value, 0)::DOUBLE AS value FROM (SELECT DISTINCT sample FROM cna) s CROSS JOIN (SELECT DISTINCT gene FROM cna) g LEFT JOIN cna USING (sample, gene)")
def source_copy_numbers(spark, sf_dir):
    return readers.read_cna(spark, _written(v.copies(spark, sf_dir), "gene", "value"), genes_in_rows=False)


@query(f"{with_views('expr')} SELECT sample, gene, count::DOUBLE AS count FROM expr WHERE count <> 0")
def source_expression(spark, sf_dir):
    return readers.read_rna(spark, _written(v.expression(spark, sf_dir), "gene", "count", compress=True), zeros=False)


@query(f"{with_views('expr')} SELECT DISTINCT gene FROM expr")
def source_gene_universe(spark, sf_dir):
    return readers.gene_universe(spark, _written(v.expression(spark, sf_dir), "gene", "count"))


@query(f"{with_views('alt')} SELECT sample, feature, 1 AS value FROM alt")
def source_alterations(spark, sf_dir):
    return readers.read_alterations(spark, _written(v.alterations(spark, sf_dir).withColumn("value", F.lit(1)), "feature", "value"))


@query(f"{with_views('clin')} SELECT sample, c_mktsegment AS \"MARKET_SEGMENT\", n_name AS \"NATION\" FROM clin")
def source_clinical(spark, sf_dir):
    """A header, four rows that say what the columns mean, and the patients, with ids that have to be trimmed and upper-cased."""
    path = f"{scratch.folder(spark)}/clinical.txt"
    head = spark.createDataFrame([(0, "", "Patient Id\tMarket Segment\t nation"), *((1, str(i), f"#meaning {i}\tx\ty") for i in range(4))], "place int, sample string, value string")
    rows = v.customers(spark, sf_dir).select(F.lit(2).alias("place"), "sample", F.concat_ws("\t", F.concat(F.lower("sample"), F.lit(" ")), "c_mktsegment", "n_name").alias("value"))
    head.unionByName(rows).repartition(1).sortWithinPartitions("place", "sample").select("value").write.text(path)  # one file of patients, in order
    return readers.read_clinical(spark, path, metadata_rows=4)


@query(f"{with_views('maf')} SELECT sample, gene, variant FROM maf")
def source_mutations(spark, sf_dir):
    path = f"{scratch.folder(spark)}/maf.tsv"
    named = v.variants(spark, sf_dir).select(F.concat(F.lower("sample"), F.lit(" ")).alias("Tumor_Sample_Barcode"), F.col("gene").alias("Hugo_Symbol"), F.col("variant").alias("Variant_Classification"))
    named.write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_maf(spark, path).select("sample", "gene", "variant")


@query(f"{with_views('fus')} SELECT sample, site1, site2 FROM fus")
def source_fusions(spark, sf_dir):
    path = f"{scratch.folder(spark)}/fusions.csv"
    writers.write_csv(v.fusions(spark, sf_dir).select(F.col("sample").alias("sample_id"), F.concat("site1", F.lit("--"), "site2").alias("fusion_name")), path)
    return readers.read_fusions(spark, path)


def _json_object(rows: DataFrame, key: str, value: str) -> str:
    """One JSON object of all rows, a dimension."""
    path = f"{scratch.folder(rows.sparkSession)}/object.json"
    rows.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("value")).write.text(path)
    return path


def _signatures(truth: DataFrame) -> DataFrame:
    return simulate.nested(truth).select("alt", F.struct("targets", "effects").alias("sig"))


@query(f"{with_views('truth')} SELECT alt, gene, round(log2fc, 6) AS log2fc, {v.TARGETS} AS n_targets FROM truth")
def source_truth(spark, sf_dir):
    rows = readers.read_truth(spark, _json_object(_signatures(v.truth(spark, sf_dir)), "alt", "sig"))
    return rounded(rows.select("alt", F.explode("targets").alias("gene"), "effects", "n_targets").select("alt", "gene", F.try_element_at("effects", F.col("gene")).alias("log2fc"), "n_targets"))


def _predictions_file(said: DataFrame) -> str:
    by_alt = said.groupBy("alt", "method").agg(F.collect_list("gene").alias("genes")).groupBy("alt").agg(F.map_from_entries(F.collect_list(F.struct("method", "genes"))).alias("sig"))
    return _json_object(by_alt, "alt", "sig")


@query(f"{with_views('pred')} SELECT method, alt, gene FROM pred")
def source_predictions(spark, sf_dir):
    """Written with alterations outside, and turned, as the reader finds out."""
    rows = readers.read_predictions(spark, _predictions_file(v.predictions(spark, sf_dir)))
    return evaluate.method_first(rows, v.truth(spark, sf_dir)).select("method", "alt", F.explode("genes").alias("gene"))


@query(f"{with_views('pred')} SELECT 'alt_first' AS with_truth, 'method_first' AS without")
def signature_orientation(spark, sf_dir):
    rows = readers.read_predictions(spark, _predictions_file(v.predictions(spark, sf_dir)))
    return spark.createDataFrame([(evaluate.orientation(rows, v.truth(spark, sf_dir)), evaluate.orientation(rows, None))], "with_truth string, without string")


@query(f"{with_views('truth')} SELECT alt, round(avg(abs(log2fc)), 6) AS mean_abs_log2fc, round(median(abs(log2fc)), 6) AS median_abs_log2fc, round(max(abs(log2fc)), 6) AS max_abs_log2fc FROM truth GROUP BY 1")
def source_summary(spark, sf_dir):
    path = f"{scratch.folder(spark)}/summary.csv"
    rows = evaluate.effect_summary(v.truth(spark, sf_dir))
    writers.write_csv(rows.select(F.col("alt").alias("alteration"), F.col("mean_abs").alias("mean_abs_log2FC_sig"), F.col("median_abs").alias("median_abs_log2FC_sig"), F.col("max_abs").alias("abs_max_log2FC_sig")), path)
    return rounded(readers.read_summary(spark, path))


@query(f"{with_views('alt', 'expr')} SELECT 'alteration' AS kind, sample, feature AS name, 1.0::DOUBLE AS value FROM alt UNION ALL SELECT 'count', sample, gene, count::DOUBLE FROM expr WHERE count <> 0 UNION ALL SELECT 'real', sample, gene, count::DOUBLE FROM expr WHERE count <> 0")
def sink_simulation(spark, sf_dir):
    out, counts = scratch.folder(spark), v.expression(spark, sf_dir)
    writers.write_simulation(out, "DRIVER", counts, v.alterations(spark, sf_dir).withColumn("value", F.lit(1)), v.truth(spark, sf_dir), compress=True, rna_real=counts, alt_gistic=None)
    named = lambda kind, df, c, x: df.select(F.lit(kind).alias("kind"), "sample", F.col(c).alias("name"), F.col(x).cast("double").alias("value"))
    back = [named(kind, readers.read_rna(spark, f"{out}/{name}_DRIVER.csv", zeros=False), "gene", "count") for kind, name in (("count", "rna_simulated"), ("real", "rna_real"))]
    return named("alteration", readers.read_alterations(spark, f"{out}/alterations_DRIVER.csv"), "feature", "value").unionByName(back[0]).unionByName(back[1])


@query(f"{with_views('samples', 'alt', 'truth')}, {_FISHER}, m AS (SELECT alt1 AS query_alteration, alt1, alt2, co_count FROM pairs UNION ALL SELECT alt2, alt1, alt2, co_count FROM pairs) SELECT query_alteration, alt1, alt2, co_count FROM m WHERE query_alteration IN (SELECT alt FROM truth)")
def sink_robustness(spark, sf_dir):
    out, alts, samples = scratch.folder(spark), v.alterations(spark, sf_dir), v.samples(spark, sf_dir)
    table = cooccurrence.frequencies(alts)
    writers.write_robustness(out, "DRIVER", table, cooccurrence.expected(alts, samples), cooccurrence.fisher_pairs(alts, samples), v.truth(spark, sf_dir).select("alt").distinct())
    back = spark.read.option("header", True).csv(f"{out}/fisher_DRIVER.csv")
    return back.select("query_alteration", "alt1", "alt2", F.col("co_count").cast("long").alias("co_count"))


_PICKS = "SELECT alt, gene FROM (SELECT alt, gene, row_number() OVER (PARTITION BY alt ORDER BY md5(concat_ws('|', '{0}', alt, gene)), gene) AS place FROM (SELECT DISTINCT feature AS alt FROM alt) a, (SELECT DISTINCT gene FROM expr) g) WHERE place <= {1}"


def _gene_picks(spark, sf_dir, tag: str, n: int) -> DataFrame:
    from pyspark.sql import Window

    alts = v.alterations(spark, sf_dir).select(F.col("feature").alias("alt")).distinct()
    order = Window.partitionBy("alt").orderBy(F.md5(F.concat_ws("|", F.lit(tag), "alt", "gene")), "gene")
    return alts.crossJoin(v.expression(spark, sf_dir).select("gene").distinct()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("alt", "gene")


@query(f"""{with_views('alt', 'expr')}, t AS ({_PICKS.format('btruth', 8)}), p AS (SELECT 'half' AS method, * FROM ({_PICKS.format('btruth', 4)}) UNION ALL SELECT 'guess', * FROM ({_PICKS.format('bguess', 8)})), n AS (SELECT count(DISTINCT gene) AS n FROM expr),
    k AS (SELECT method, p.alt, count(*) AS said, count(t.gene) AS tp FROM p LEFT JOIN t USING (alt, gene) GROUP BY 1, 2), s AS (SELECT *, tp / said AS precision, tp / 8 AS recall, (n - said - 8 + 2 * tp) / n AS accuracy, tp / (said + 8 - tp) AS jaccard FROM k, n)
    SELECT method, round(avg(CASE WHEN tp > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(accuracy), 6) AS accuracy, round(avg(jaccard), 6) AS jaccard, count(*) AS n_signatures_evaluated, 'DRIVER' AS dataset FROM s GROUP BY 1""")
def evaluate_folder(spark, sf_dir):
    """A data set's folder is written, read as a bundle, scored, and its results are written and read again."""
    base = scratch.folder(spark)
    at, out = f"{base}/DRIVER", f"{base}/out"
    truth = _gene_picks(spark, sf_dir, "btruth", 8).withColumn("log2fc", F.lit(1.0))
    said = _gene_picks(spark, sf_dir, "btruth", 4).withColumn("method", F.lit("half")).unionByName(_gene_picks(spark, sf_dir, "bguess", 8).withColumn("method", F.lit("guess")))
    writers.write_matrix(v.alterations(spark, sf_dir).withColumn("value", F.lit(1)), "feature", "value", f"{at}/alterations_DRIVER.csv")
    writers.write_matrix(v.expression(spark, sf_dir), "gene", "count", f"{at}/rna_simulated_DRIVER.csv")
    for rows, name in ((_signatures(truth), "true_signatures"), (said.groupBy("alt", "method").agg(F.collect_list("gene").alias("genes")).groupBy("alt").agg(F.map_from_entries(F.collect_list(F.struct("method", "genes"))).alias("sig")), "signatures")):
        rows.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("alt", "sig")))).alias("value")).write.text(f"{at}/{name}_DRIVER.json")
    workflows.evaluate_dataset(spark, "DRIVER", base, out, filter_alts=False)
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/overall_results_DRIVER.csv")
    return rounded(back.select("method", "f1", "precision", "recall", "accuracy", "jaccard", F.col("n_signatures_evaluated").cast("long").alias("n_signatures_evaluated"), "dataset"))


# ---- helpers -----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, upper(substr('TCGA-ab-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '-01A', 1, 12)) AS sample FROM customer WHERE c_custkey % 3 > 0")
def mapped_patients(spark, sf_dir):
    named = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("tcga-ab-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("-01a"))).otherwise(F.lit("not an id"))
    return align.mapped(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", named.alias("sample")), "TCGA")


@query(f"{with_views('alt', 'fus')}, f AS (SELECT DISTINCT sample FROM fus WHERE site1 = site2) SELECT 'x' AS side, sample, feature AS name FROM alt WHERE sample IN (SELECT sample FROM f) UNION ALL SELECT 'y', sample, 'f' FROM f WHERE sample IN (SELECT sample FROM alt)")
def aligned_pair(spark, sf_dir):
    f = v.fusions(spark, sf_dir).where("site1 = site2").select("sample").distinct().withColumn("name", F.lit("f"))
    x, y = align.align_pair(v.alterations(spark, sf_dir), f)
    return x.select(F.lit("x").alias("side"), "sample", F.col("feature").alias("name")).unionByName(y.select(F.lit("y").alias("side"), "sample", "name"))


@query(f"{with_views('subtype', 'alt')} SELECT DISTINCT feature FROM alt WHERE sample IN (SELECT sample FROM subtype WHERE subtype = 'BUILDING') AND feature IN (SELECT feature FROM alt WHERE sample IN (SELECT sample FROM subtype WHERE subtype = 'MACHINERY'))")
def shared_features(spark, sf_dir):
    alts = v.alterations(spark, sf_dir)
    part = lambda s: alts.join(v.subtypes(spark, sf_dir).where(F.col("subtype") == s), "sample", "left_semi")
    return spark.createDataFrame([(f,) for f in knn.common_features(part("BUILDING"), part("MACHINERY"))], "feature string")


_NAMED = "n AS (SELECT feature AS name, row_number() OVER (ORDER BY feature) AS place FROM (SELECT DISTINCT feature FROM alt UNION SELECT DISTINCT replace(feature, '#', '-') FROM alt UNION SELECT DISTINCT '1' || replace(feature, '#', ' ') FROM alt))"


def _names(spark, sf_dir) -> DataFrame:
    f = F.col("feature")
    alts = v.alterations(spark, sf_dir)
    return alts.select(f).union(alts.select(F.replace(f, F.lit("#"), F.lit("-")))).union(alts.select(F.concat(F.lit("1"), F.replace(f, F.lit("#"), F.lit(" "))))).distinct()


@query(f"{with_views('alt')}, {_NAMED}, s AS (SELECT name, place, CASE WHEN regexp_matches(name, '^[0-9]') THEN 'X_' ELSE '' END || regexp_replace(name, '[^0-9A-Za-z_]', '_', 'g') AS safe FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY place) - 1 AS k FROM s) SELECT name, safe || CASE WHEN k > 0 THEN '__' || k ELSE '' END AS safe FROM r")
def model_names(spark, sf_dir):
    names = sorted(r["feature"] for r in _names(spark, sf_dir).collect())  # a dimension
    return spark.createDataFrame(list(zip(names, r_names(names), strict=True)), "name string, safe string")


@query(f"{with_views('alt')}, {_NAMED} SELECT name, translate(name, '-:/ ', '____') AS design, replace(name, '_', '-') AS contrast FROM n")
def design_names(spark, sf_dir):
    return _names(spark, sf_dir).select(F.col("feature").alias("name"), design_name(F.col("feature")).alias("design"), contrast_name(F.col("feature")).alias("contrast"))


@query("SELECT p_partkey, p_brand, p_retailprice > avg(p_retailprice) OVER w + 1e-12 AS mean, p_retailprice > median(p_retailprice) OVER w + 1e-12 AS median, p_retailprice > avg(p_retailprice) OVER w + stddev_pop(p_retailprice) OVER w + 1e-12 AS mean_sd FROM part WINDOW w AS (PARTITION BY p_brand)")
def score_masks(spark, sf_dir):
    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["p_retailprice"].to_numpy()
        return pdf[["p_partkey", "p_brand"]].assign(mean=linear.score_mask(s, "mean"), median=linear.score_mask(s, "median"), mean_sd=linear.score_mask(s, "mean+sd"))

    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return rows.groupBy("p_brand").applyInPandas(marked, "p_partkey long, p_brand string, mean boolean, median boolean, mean_sd boolean")


_WEIGHT = u_sql("'weight'", "alt", "gene")


def _weights(spark, sf_dir) -> DataFrame:
    return v.truth(spark, sf_dir).select("gene", "alt", uniform("weight", F.col("alt"), F.col("gene")).alias("weight"))


@query(f"{with_views('truth')}, w AS (SELECT alt, gene, {_WEIGHT} AS weight FROM truth) SELECT alt, gene, round(weight, 6) AS weight, row_number() OVER (PARTITION BY alt ORDER BY weight DESC, gene) AS place FROM w WHERE weight >= 0.6 - 1e-12")
def stability_signatures(spark, sf_dir):
    return rounded(linear.signature_of(_weights(spark, sf_dir), "stability"))


@query(f"{with_views('truth')}, w AS (SELECT alt, gene, log2fc AS weight FROM truth) SELECT alt, gene, round(weight, 6) AS weight, row_number() OVER (PARTITION BY alt ORDER BY gene) AS place FROM w WHERE abs(weight) > 1e-6")
def nonzero_signatures(spark, sf_dir):
    return rounded(linear.signature_of(v.truth(spark, sf_dir).withColumnRenamed("log2fc", "weight"), "nonzero"))


@query(f"""{with_views('samples', 'alt', 'truth')}, w AS (SELECT alt, gene, {_WEIGHT} AS weight FROM truth), tot AS (SELECT count(*) AS n FROM samples),
    g AS (SELECT a.alt, coalesce(n1, 0) AS n1, n - coalesce(n1, 0) AS n0, n FROM (SELECT DISTINCT feature AS alt FROM alt UNION ALL SELECT 'nowhere') a LEFT JOIN (SELECT feature AS alt, count(*) AS n1 FROM alt GROUP BY 1) c USING (alt), tot),
    gate AS (SELECT alt, CASE WHEN n1 = 0 OR n0 = 0 THEN 'SKIPPED: constant or low variance' WHEN n1 < 2 OR n0 < 2 THEN 'SKIPPED: insufficient group sizes' ELSE 'ok' END AS status FROM g),
    said AS (SELECT 'Deconfounder' AS method, alt, gene FROM truth WHERE abs(log2fc) > 1e-6 UNION ALL SELECT 'Ridge', alt, gene FROM w WHERE weight >= 0.6 - 1e-12 UNION ALL SELECT 'limma', alt, gene FROM w WHERE weight < 0.05)
    SELECT alt, status, NULL AS method, NULL AS gene FROM gate WHERE status <> 'ok' UNION ALL SELECT gate.alt, status, m.method, gene FROM gate CROSS JOIN (SELECT unnest(['Deconfounder', 'Ridge', 'limma']) AS method) m LEFT JOIN said ON said.alt = gate.alt AND said.method = m.method WHERE status = 'ok'""")
def supervised_signatures(spark, sf_dir):
    w = _weights(spark, sf_dir)
    both = w.withColumn("method", F.lit("Ridge")).unionByName(v.truth(spark, sf_dir).select("gene", "alt", F.col("log2fc").alias("weight"), F.lit("Deconfounder").alias("method")))
    alts = v.alterations(spark, sf_dir)
    every = alts.select(F.col("feature").alias("alt")).distinct().union(spark.createDataFrame([("nowhere",)], "alt string"))
    return linear.supervised_signatures(alts, v.samples(spark, sf_dir), every, both, {"limma": w.withColumnRenamed("weight", "padj")})


@query(f"{with_views('samples', 'alt')}, {_FISHER}, r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM (SELECT alt1, alt2, round(p, 9) AS p FROM pairs)), q AS (SELECT alt1, alt2, least(1, min(p * m / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS padj FROM r) SELECT alt1, alt2 FROM q WHERE padj < 0.9")
def significant_pairs(spark, sf_dir):
    pairs = cooccurrence.fisher_pairs(v.alterations(spark, sf_dir), v.samples(spark, sf_dir))
    return evaluate.significant(evaluate.adjusted(pairs.select("alt1", "alt2", F.round("p", 9).alias("pvalue"))), 0.9).select("alt1", "alt2")


@query(f"{with_views('truth')} SELECT alt, string_agg(gene, ',' ORDER BY gene) AS targets, count(*) AS n FROM truth GROUP BY 1")
def nested_signatures(spark, sf_dir):
    return simulate.nested(v.truth(spark, sf_dir)).select("alt", F.array_join("targets", ",").alias("targets"), F.size("effects").cast("long").alias("n"))


@query(f"{with_views('truth')} SELECT alt, gene, round(log2fc, 6) AS effect FROM truth")
def effects_of_signatures(spark, sf_dir):
    """Signatures under other keys, as JSON text by key."""
    sig = simulate.nested(v.truth(spark, sf_dir)).select("alt", F.create_map(F.lit("genes"), F.to_json("targets"), F.lit("log2FC"), F.to_json("effects")).alias("sig"))
    targets, effects = evaluate.targets_and_effects(F.col("sig"))
    rows = sig.select("alt", F.explode(F.arrays_zip(targets.alias("gene"), effects.alias("effect"))).alias("x"))
    return rounded(rows.select("alt", F.col("x.gene").alias("gene"), F.col("x.effect").alias("effect")))


@query(f"{with_views('samples', 'expr')}, m AS (SELECT gene, sum(count) / (SELECT count(*) FROM samples) AS mean FROM expr GROUP BY 1) SELECT gene FROM (SELECT gene FROM m ORDER BY mean DESC, gene LIMIT 500) UNION SELECT gene FROM m WHERE gene LIKE 'ECONOMY%'")
def simulated_gene_set(spark, sf_dir):
    counts = v.expression(spark, sf_dir)
    altered = counts.select("gene").distinct().where("gene like 'ECONOMY%'").union(spark.createDataFrame([("unknown gene",)], "gene string"))
    return simulate.gene_set(simulate.moment_dispersions(counts, v.samples(spark, sf_dir)), altered, 500).select("gene")


@query()
def theory_replicate_means(spark, sf_dir):
    path = f"{scratch.folder(spark)}/theory.csv"
    writers.write_theory(theory.replicates(spark), path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return rounded(theory.replicate_means(back))


@query()
def ppca_generated(spark, sf_dir):
    alts, samples = v.alterations(spark, sf_dir), v.samples(spark, sf_dir)
    cov, means, names, _ = deconfounder.covariance(alts, samples)
    return rounded(deconfounder.generate(samples, deconfounder.ppca(cov, means, names, 3)))


@query()
def integrate_files(spark, sf_dir):
    """The blocks of a study read from its files, mapped, aligned and filtered: features per sample."""
    base = scratch.folder(spark)
    paths = {n: f"{base}/{n}" for n in ("maf", "cna", "fusion", "clinical", "rna")}
    v.variants(spark, sf_dir).select(F.col("sample").alias("Tumor_Sample_Barcode"), F.col("gene").alias("Hugo_Symbol"), F.col("variant").alias("Variant_Classification")).write.option("sep", "\t").option("header", True).csv(paths["maf"])
    writers.write_matrix(v.copies(spark, sf_dir), "gene", "value", paths["cna"])
    writers.write_csv(v.fusions(spark, sf_dir).select(F.col("sample").alias("sample_id"), F.concat("site1", F.lit("--"), "site2").alias("fusion_name")), paths["fusion"])
    writers.write_csv(v.customers(spark, sf_dir).select(F.col("sample").alias("Patient"), F.col("c_mktsegment").alias("Subtype")), paths["clinical"])
    writers.write_matrix(v.expression(spark, sf_dir), "gene", "count", paths["rna"])
    study = workflows.integrate(spark, paths["maf"], paths["cna"], paths["fusion"], paths["clinical"], paths["clinical"], paths["rna"], "DRIVER", "ALL", cna_genes_in_rows=False, metadata_rows=0)
    rows = [(name, df.select("sample", "feature")) for name, df in (("mutation", study.mutations), ("cna", study.cna), ("fusion", study.fusions))]
    out = None
    for name, df in rows:
        part = df.select(F.lit(name).alias("block"), "sample", "feature")
        out = part if out is None else out.unionByName(part)
    return out
