import json

import pytest
from pyspark.sql import functions as F

from sigspark.operators import evaluate
from sigspark.plans.workflows import evaluate_dataset, integrate, simulate_expression
from sigspark.sources import readers, writers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_readers(spark, tmp_path):
    cna = put(tmp_path / "cna.tsv", "gene\tS1\tS2\tEntrez_Gene_Id\tA|B\nGENE1\t2\t0\t77\t1\nGENE2\t1\t-2\t78\t1\n")
    assert sorted(tuple(r) for r in readers.read_cna(spark, cna).collect()) == [("S1", "GENE1", "GENE1_CNA", 2.0), ("S1", "GENE2", "GENE2_CNA", 1.0), ("S2", "GENE1", "GENE1_CNA", 0.0), ("S2", "GENE2", "GENE2_CNA", -2.0)]
    with pytest.raises(FileNotFoundError):
        readers.read_cna(spark, str(tmp_path / "none.tsv"))
    fusions = put(tmp_path / "f.csv", "sample_id,fusion_name\nP1,ETV6--RUNX1\nP2,BCR--ABL1\n")
    assert sorted(tuple(r) for r in readers.read_fusions(spark, fusions).collect()) == [("P1", "ETV6", "RUNX1"), ("P2", "BCR", "ABL1")]
    with pytest.raises(ValueError):
        readers.read_fusions(spark, put(tmp_path / "bad.csv", "Sample_Id,foo\nP1,x\n"))
    maf = put(tmp_path / "m.tsv", "#version 2\nTumor_Sample_Barcode\tHugo_Symbol\tVariant_Classification\n s1 \tKRAS\tMissense_Mutation\n")
    assert tuple(readers.read_maf(spark, maf).first()) == ("S1", "KRAS", "Missense_Mutation")
    clin = put(tmp_path / "c.tsv", "Sample Id\tCancer Type\n#meta\tx\ns1 \tAML\n")
    assert readers.read_clinical(spark, clin, 1).columns == ["sample", "CANCER_TYPE"] and tuple(readers.read_clinical(spark, clin, 1).first()) == ("S1", "AML")
    rna = put(tmp_path / "r.csv", "gene,S1,S2\nG1,1,2\nG2,0.5,x\n")
    assert sorted(tuple(r) for r in readers.read_rna(spark, rna, genes_in_rows=True).collect()) == [("S1", "G1", 1.0), ("S1", "G2", 0.5), ("S2", "G1", 2.0), ("S2", "G2", 0.0)]
    assert [r.gene for r in readers.gene_universe(spark, rna).collect()] == ["S1", "S2"]
    truth = put(tmp_path / "t.json", json.dumps({"A_GOF": {"targets": ["G1", "G2"], "effects": {"G1": 1.5}}, "bad": 3}, indent=2))
    assert [tuple(r) for r in readers.read_truth(spark, truth).collect()] == [("A_GOF", ["G1", "G2"], {"G1": 1.5}, 2)]
    said = put(tmp_path / "p.json", json.dumps({"A_GOF": {"Lasso": ["G1"], "Ridge": "G1;G2"}, "x": 1}))
    assert sorted(tuple(r) for r in readers.read_predictions(spark, said).collect()) == [("A_GOF", "Lasso", ["G1"]), ("A_GOF", "Ridge", ["G1", "G2"])]
    assert readers.read_predictions(spark, str(tmp_path / "no.json")).collect() == []


def test_integrate(spark, tmp_path):
    ids = [f"TCGA-AA-{i:04}" for i in range(6)]
    mut = put(tmp_path / "mut.tsv", "Tumor_Sample_Barcode\tHugo_Symbol\tVariant_Classification\n" + "".join(f"{i}-01A\tKRAS\tMissense_Mutation\n{i}-01A\tABC\tSplice_Site\n" for i in ids[:5]))
    cna = put(tmp_path / "cna.tsv", "Hugo\t" + "\t".join(f"{i}-01" for i in ids) + "\nMYC\t" + "\t".join("201-102".replace("-1", "1")[:6]) + "\n")
    fus = put(tmp_path / "fus.csv", "Sample_Id,fusion_name\n" + "".join(f"{i},BCR--ABL1\n" for i in ids[:4]))
    sample = put(tmp_path / "sample.tsv", "id\tSubtype\n" + "#\tx\n" * 4 + "".join(f"{i}\tA\n" for i in ids))
    patient = put(tmp_path / "patient.tsv", "id\tSex\n" + "#\tx\n" * 4 + "".join(f"{i}\tM\n" for i in ids))
    rna = put(tmp_path / "rna.csv", "id,G1,G2\n" + "".join(f"{i},{k},1\n" for k, i in enumerate(ids)))
    study = integrate(spark, mut, cna, fus, patient, sample, rna, "TCGA", "COAD")
    assert {r["sample"] for r in study.mutations.collect()} == set(ids[:4]) and {r.feature for r in study.mutations.collect()} == {"KRAS_GOF", "ABC_MUT"}
    assert study.rna.select("sample").distinct().count() == 4 and study.subtypes.count() == 4 and study.clinical.columns == ["sample", "SUBTYPE", "SEX"]
    assert {tuple(r) for r in study.fusions.select("feature", "value").collect()} == {("BCR--ABL1_FUSION", 1)}


def test_simulated_data_set_is_written_and_scored(spark, tmp_path):
    rna = spark.range(40).select(F.concat(F.lit("R"), "id").alias("sample"), F.explode(F.expr("transform(sequence(0, 14), i -> 'G' || i)")).alias("gene")).withColumn("count", F.pmod(F.xxhash64("sample", "gene"), F.lit(90)) + 10)
    real = rna.select("sample").distinct().select("sample", F.explode(F.array(*map(F.lit, ("G1_GOF", "G2_LOF", "G3_MUT")))).alias("feature")).where(F.pmod(F.xxhash64("sample", "feature"), F.lit(2)) == 0).withColumn("value", F.lit(1))
    sim = real.withColumn("sample", F.concat(F.lit("S"), "sample"))
    truth = spark.createDataFrame([("G1_GOF", "G1", 3.0), ("G1_GOF", "G4", -2.0), ("G2_LOF", "G2", -3.0)], "alt string, gene string, log2fc double")
    with pytest.raises(ValueError):
        simulate_expression(rna, real, sim)
    made = simulate_expression(rna, real, sim, signatures=truth)
    assert made.counts.where("count < 0").count() == 0 and made.counts.select("gene").distinct().count() == 15
    out = tmp_path / "DS"
    paths = writers.write_simulation(str(out), "DS", made.counts, sim, truth, background_exp=made.background)
    assert len(paths) == 4 and spark.read.json(paths[-2 + 1]).columns == ["alt", "effect_mode", "effects", "targets"]
    (tmp_path / "in").mkdir()
    at = tmp_path / "in" / "DS"
    at.mkdir()
    for name, rows, column, value in (("rna_simulated", made.counts, "gene", "count"), ("alterations", sim, "feature", "value")):
        pdf = writers.wide(rows, column, value).toPandas().set_index("sample")
        pdf.to_csv(at / f"{name}_DS.csv")
    (at / "true_signatures_DS.json").write_text(json.dumps({"G1_GOF": {"targets": ["G1", "G4"], "effects": {"G1": 3.0, "G4": -2.0}}, "G2_LOF": {"targets": ["G2"], "effects": {"G2": -3.0}}}))
    (at / "signatures_DS.json").write_text(json.dumps({"G1_GOF": {"Lasso": ["G1", "G4"]}, "G2_LOF": {"Lasso": ["G2", "G9"]}}))
    found = evaluate_dataset(spark, "DS", str(tmp_path / "in"), str(tmp_path / "res"))
    got = {r.alt: r for r in found.individual.collect()}
    assert got["G1_GOF"].f1 == 1 and got["G2_LOF"].precision == 0.5 and got["G1_GOF"].base_snr > 0.5
    assert spark.read.option("header", True).csv(str(tmp_path / "res" / "overall_results_DS.csv")).count() == 1


def test_wide_files_of_odd_cells(spark, tmp_path):
    odd = put(tmp_path / "odd.csv", 'id,"a, b",c\n"S ""1""",1,2\n\nS2,,x\nS3,5\n"S\\"4",6,7,8\n')
    got = sorted(((r.row, r.name, r.value) for r in readers.read_matrix(spark, odd).collect()), key=str)
    assert got == sorted([('S "1"', "a, b", "1"), ('S "1"', "c", "2"), ("S2", "a, b", None), ("S2", "c", "x"), ("S3", "a, b", "5"), ("S3", "c", None), ('S"4', "a, b", "6"), ('S"4', "c", "7")], key=str)
    assert [r.gene for r in readers.gene_universe(spark, odd).collect()] == ["a, b", "c"]
    assert readers.read_matrix(spark, put(tmp_path / "one.csv", "id\nS1\n")).collect() == []
    tabs = put(tmp_path / "tabs.tsv", "\ta|b\tc\nS1\t1\t2\n")
    assert sorted(tuple(r) for r in readers.read_matrix(spark, tabs).collect()) == [("S1", "a|b", "1"), ("S1", "c", "2")]


def test_wide_round_trip_without_a_pivot(spark, tmp_path):
    names = [f"G{i}" for i in range(10_000)] + ['with, comma', 'with "quotes" and \\\\']
    cells = spark.createDataFrame([(f"S{s}", names[(s * 37 + k * 101) % len(names)], float(s + k + 1)) for s in range(40) for k in range(90)] + [('odd "id", 1', names[-1], 2.5), ('odd "id", 1', names[-2], 3.0)], "sample string, gene string, count double")
    rest = cells.select("gene").distinct().count()
    for compress in (False, True):
        path = str(tmp_path / f"wide{compress}")
        writers.write_matrix(cells.repartition(3), "gene", "count", path, compress)
        back = readers.read_rna(spark, path)
        assert back.count() == 41 * rest
        assert back.where("count <> 0").exceptAll(cells).count() == 0 and cells.exceptAll(back.where("count <> 0")).count() == 0
    assert {r.gene for r in readers.gene_universe(spark, path).collect()} == {r.gene for r in cells.select("gene").distinct().collect()}
    writers.write_matrix(cells.limit(0), "gene", "count", str(tmp_path / "none"))
    assert readers.read_rna(spark, str(tmp_path / "none")).collect() == []


def test_wide_files_without_their_zeros(spark, tmp_path):
    odd = put(tmp_path / "odd.csv", 'id,"a, b",c,d\n"S ""1""",0,2,0.0\n\nS2,,x\nS3,0,0,0\n,1,0,0\n')
    whole, some = (sorted((tuple(r) for r in readers.read_matrix(spark, odd, zeros=z).collect()), key=str) for z in (True, False))
    assert some == [r for r in whole if r[2] not in (None, "0")] and len(some) == 4
    assert sorted(map(str, (r.sample for r in readers.rna_samples(spark, odd).collect()))) == ['None', 'S "1"', "S2", "S3"]
    assert readers.rna_samples(spark, put(tmp_path / "one.csv", "id\nS1\n")).collect() == []
    cells = spark.createDataFrame([("S1", "G1", 3), ("S1", "G1", 2), ("S1", "G3", None), ("S2", "G2", None), ("S2", "G3", 10), ("S2", "G3", 9), ("S3", "G1", None)], "sample string, gene string, count long")
    writers.write_matrix(cells, "gene", "count", str(tmp_path / "dealt"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "dealt")).distinct().collect())
    assert lines == ["S1,2,0,0", "S2,0,0,9", "S3,0,0,0", "sample,G1,G2,G3"]


def test_effects_by_target_or_as_a_list(spark):
    rows = [("a", {"targets": '["G1","G2"]', "effects": '{"G2":-1.5}'}), ("b", {"genes": '["G1","G2","G3"]', "log2fc": "[0.5, -2]"}), ("c", {"effect_sizes": '{"G9":3.0}'}), ("d", {"signature": '["G1"]'})]
    targets, effects = evaluate.targets_and_effects(F.col("sig"))
    got = {r.alt: (r.t, r.e) for r in spark.createDataFrame(rows, "alt string, sig map<string,string>").select("alt", targets.alias("t"), effects.alias("e")).collect()}
    assert got == {"a": (["G1", "G2"], [None, -1.5]), "b": (["G1", "G2", "G3"], [0.5, -2.0, None]), "c": (["G9"], [3.0]), "d": (["G1"], [None])}
