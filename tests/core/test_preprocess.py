import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import alteration_gene, alteration_kind, as_list, odds_smooth, patient_id, r_names, theory_c1
from sigspark.operators import align, clinical, cna, design, mutations, rna


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("gene", "disease", "variant", "label"),
    [
        ("TP53", "AML", "Silent", "Drop"), ("NOTCH1", "T-ALL", "Nonsense_Mutation", "GOF"), ("KRAS", "COAD", "Frame_Shift_Del", "Unclear"), ("TP53", "OV", "Splice_Site", "LOF"),
        ("NPM1", "AML", "Frame_Shift_Ins", "GOF"), ("SF3B1", "BRCA", "Missense_Mutation", "GOF"), ("kras", "coad", "In_Frame_Del", "GOF"), ("TP53", "OV", "Missense_Mutation", "Unclear"),
        ("NPM1", "BRCA", "Frame_Shift_Ins", "Unclear"), ("GENE", "OV", "Splice_Site", "Unclear"), ("ETV6", "ALL", "Nonsense_Mutation", "Unclear"), (None, "OV", "Splice_Site", "Unclear"),
    ],
)
def test_classify_variant(spark, gene, disease, variant, label):
    df = spark.createDataFrame([(gene, variant)], "gene string, variant string")
    assert df.select(mutations.classify_variant(F.col("gene"), disease, F.col("variant"))).first()[0] == label


def test_maf_features(spark):
    maf = spark.createDataFrame([("S1", "KRAS", "GOF"), ("S2", "TP53", "LOF"), ("S2", "KRAS", "GOF"), ("S3", "PIK3CA", "Unclear"), ("S3", "PIK3CA", "Unclear"), ("S4", "KRAS", "Unclear")], "sample string, gene string, label string")
    assert rows(mutations.maf_features(maf)) == [("S1", "KRAS_GOF"), ("S2", "KRAS_GOF"), ("S2", "TP53_LOF"), ("S3", "PIK3CA_MUT")]
    many = spark.createDataFrame([(f"S{i}", g, "Unclear") for g, n in (("G1", 3), ("G2", 2), ("G3", 1)) for i in range(n)], "sample string, gene string, label string")
    assert {r.feature for r in mutations.maf_features(many, top_k=1).collect()} == {"G1_MUT"}
    assert mutations.maf_features(maf.limit(0)).collect() == []


def test_fusions_and_names(spark):
    listed = spark.createDataFrame([("P1", "ETV6", "RUNX1"), ("P1", "ETV6", "RUNX1"), ("P2", "BCR", "ABL1"), ("P3", None, "X")], "sample string, site1 string, site2 string")
    assert rows(mutations.fusion_counts(listed)) == [("P1", "ETV6--RUNX1_FUSION", 2), ("P2", "BCR--ABL1_FUSION", 1)]
    names = spark.createDataFrame([(a,) for a in ("TP53_LOF", "KRAS_GOF", "MYC_AMP", "CDKN2A_DEL", "ETV6--RUNX1_FUSION", "X_MUT")], "a string")
    assert [tuple(r) for r in names.select(alteration_kind(F.col("a")), alteration_gene(F.col("a"))).collect()] == [("LOF", "TP53"), ("GOF", "KRAS"), ("AMP", "MYC"), ("DEL", "CDKN2A"), ("FUSION", "ETV6"), ("OTHER", None)]
    ids = spark.createDataFrame([("TCGA-AB-1234-01A",), ("TCGA-ZZ-9999",), ("NOT_TCGA",), (None,)], "s string")
    assert [r[0] for r in ids.select(patient_id(F.col("s"), "TCGA")).collect()] == ["TCGA-AB-1234", "TCGA-ZZ-9999", None, None]
    texts = spark.createDataFrame([(None,), ("",), ("A;B",), ("A, B",), ("A",)], "t string")
    assert [r[0] for r in texts.select(as_list(F.col("t"))).collect()] == [[], [], ["A", "B"], ["A", "B"], ["A"]]
    assert r_names(["a-b", "a b", "1x", "", "a-b"]) == ["a_b", "a_b__1", "X_1x", "X", "a_b__2"]


def test_copy_numbers(spark):
    values = [("G1", v) for v in (0.0, 1.2, 2.7, -1.4, -3.0)] + [("G2", 0.0)] * 5
    df = spark.createDataFrame([(f"S{i % 5}", g, x) for i, (g, x) in enumerate(values)], "sample string, gene string, value double")
    samples = df.select("sample").distinct()
    got = {r.gene: tuple(r)[1:] for r in cna.event_params(df, samples).collect()}
    assert got["G1"] == pytest.approx((0.4, 0.4, 0.2, 0.5, 0.5)) and got["G2"] == pytest.approx((0, 0, 1, 0, 0))
    double = spark.createDataFrame([("S1", "G1", "2"), ("S1", "G1", "1"), ("S2", "G1", "x"), ("S3", "G1", None)], "sample string, gene string, value string")
    assert sum(tuple(cna.event_params(double, double.select("sample")).first())[1:4]) == pytest.approx(1)
    state = spark.createDataFrame([("S1", "G1", 2), ("S2", "G1", -2), ("S3", "G1", 1)], "sample string, gene string, value int")
    marks = spark.createDataFrame([("S1", "G1_AMP", 1), ("S3", "G1_AMP", 1), ("S2", "G1_DEL", 1), ("S1", "KRAS_GOF", 1), ("S9", "G1_AMP", 1)], "sample string, feature string, value int")
    assert rows(cna.with_severity(marks, state)) == [("S1", "G1_AMP", 2.0), ("S1", "KRAS_GOF", 1.0), ("S2", "G1_DEL", 2.0), ("S3", "G1_AMP", 1.0), ("S9", "G1_AMP", 1.0)]


def test_clinical(spark):
    df = spark.createDataFrame([("S1", 50, "M", 1), ("S2", None, None, 2)], "sample string, diagnosis_age int, Sex string, some_other int")
    assert clinical.known_columns(df, "AML") == ["Sex", "diagnosis_age"]
    with pytest.raises(ValueError):
        clinical.known_columns(df, "none")
    with pytest.raises(ValueError):
        clinical.subtypes(df)
    kept = clinical.without_missing(df, ["diagnosis_age", "Sex"], 0.5)
    assert rows(kept) == [("S1", 50, "M"), ("S2", None, "Unknown")] and clinical.without_missing(df, ["Sex"], 0.25).columns == ["sample"]


def test_alignment_keeps_repeats(spark):
    a = spark.createDataFrame([("S1", 1), ("S1", 2), ("S2", 3)], "sample string, x int")
    b = spark.createDataFrame([("S1",), ("S1",), ("S3",)], "sample string")
    found = align.aligned({"a": a, "b": b, "none": b.limit(0)})
    assert rows(found["a"]) == [("S1", 1), ("S1", 2)] and found["b"].count() == 2
    with pytest.raises(ValueError):
        align.aligned({"a": a.where("x = 3"), "b": b})


def test_gene_selection_and_scaling(spark):
    cells = [("ALTERED", [0] * 5), ("G2", [100, 90, 110, 105, 95]), ("G3", [10, 120, 60, 80, 55]), ("G4", [10, 9, 11, 10, 10])]
    df = spark.createDataFrame([(f"S{i}", g, float(x)) for g, xs in cells for i, x in enumerate(xs)], "sample string, gene string, count double")
    samples, genes = df.select("sample").distinct(), df.select("gene").distinct()
    got = {r.gene: r for r in rna.select_genes(df, samples, genes, spark.createDataFrame([("ALTERED",), ("ABSENT",)], "gene string"), target=2).collect()}
    assert got["ALTERED"].kept and got["ALTERED"].low and sum(r.kept for r in got.values()) == 2 and not got["G4"].kept
    small = spark.createDataFrame([("S1", "G1", 0.1), ("S2", "G1", -0.5), ("S3", "G1", 0.2)], "sample string, gene string, count double")
    assert [r["count"] for r in rna.as_counts(small, small.select("sample"), small.select("gene")).orderBy("sample").collect()] == [10, 0, 20]
    with pytest.raises(ValueError):
        rna.as_counts(small, small, small, "manual")


def test_normaliser(spark):
    df = spark.createDataFrame([("S1", "G1", 0), ("S2", "G1", 10), ("S3", "G1", 5), ("S1", "G2", 0), ("S2", "G2", 0), ("S3", "G2", 5)], "sample string, gene string, count int")
    z = rna.normalised(df, df.select("gene"), zscore=True)
    assert {r["sample"] for r in z.collect()} == {"S2", "S3"}
    stats = z.groupBy("gene").agg(F.avg("value"), F.stddev_pop("value")).collect()
    assert all(r[1] == pytest.approx(0, abs=1e-9) and r[2] == pytest.approx(1) for r in stats)
    grid = spark.createDataFrame([(f"S{i}", f, float(x)) for f, xs in (("A", (5, 5, 5)), ("B", (0, 1, 2))) for i, x in enumerate(xs)], "sample string, feature string, value double")
    got = {(r["sample"], r.feature): r.value for r in rna.floor_scaled(grid).collect()}
    assert got[("S0", "A")] == 0 and got[("S0", "B")] == pytest.approx(-1)


def test_design(spark):
    n, ones = 20, {"A_GOF": range(10), "B_MUT": range(5, 15), "C_MUT": range(5, 15), "D_MUT": range(20), "E_MUT": range(2), "F_MUT": [*range(5), *range(10, 15)], "G_MUT": range(10, 20)}
    alts = spark.createDataFrame([(f"S{i:02}", f) for f, xs in ones.items() for i in xs], "sample string, feature string")
    samples = spark.createDataFrame([(f"S{i:02}",) for i in range(n)], "sample string")
    fate = {r.feature: r.fate for r in design.sanitised(alts, samples, alts.select("feature")).collect()}
    assert fate == {"A_GOF": "kept", "B_MUT": "kept", "C_MUT": "duplicate", "D_MUT": "constant", "E_MUT": "imbalanced", "F_MUT": "kept", "G_MUT": "dependent"}
    few = {r.feature: r.fate for r in design.sanitised(alts, samples, alts.select("feature"), min_residual=18).collect()}
    assert sum(x == "kept" for x in few.values()) == 1 and "capacity" in few.values()


def test_scalars(spark):
    one = spark.createDataFrame([(6, 2, 1, 4)], "a int, b int, c int, d int")
    assert one.select(odds_smooth(*(F.col(x) for x in "abcd"))).first()[0] == pytest.approx(7.8)
    assert theory_c1(100 * 2.718281828459045, 100, 500, 500, 0.8, 0.2) == pytest.approx(0.5694, abs=1e-4)


def test_nonempty(spark):
    from sigspark.functions import nonempty

    one = spark.range(1)
    assert nonempty(one) and not nonempty(one.limit(0)) and not nonempty(one.select())


def test_median_deviations_count_absent_cells_without_a_grid(spark, monkeypatch):
    draw = np.random.default_rng(3)
    table = np.where(draw.random((23, 9)) < np.linspace(0, 1, 9), draw.integers(1, 60, (23, 9)), 0)
    table[:, 4] = 7
    ids, names = [f"s{i}" for i in range(23)], [f"g{j}" for j in range(9)]
    cells = spark.createDataFrame([(ids[i], names[j], int(table[i, j])) for i, j in zip(*np.nonzero(table), strict=True)], "sample string, gene string, count long")
    samples, genes = spark.createDataFrame([(i,) for i in ids], "sample string"), spark.createDataFrame([(g,) for g in names], "gene string")
    monkeypatch.setattr(rna, "dense", None, raising=False)  # no grid is made
    got = {r.gene: r.variability for r in rna.gene_statistics(cells, samples, genes, mad=True).collect()}
    x = np.log1p(table / np.maximum(table.sum(axis=1, keepdims=True), 1) * 1e6)
    assert got == pytest.approx({g: float(np.median(np.abs(x[:, j] - np.median(x[:, j])))) for j, g in enumerate(names)})
