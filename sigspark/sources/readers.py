"""Readers. Delimiters are taken from a file's first line; sample-by-feature matrices become long rows at once, so nothing is transposed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_list, header, number

#: Order in which delimiters are tried on the first line.
DELIMITERS = ("\t", ",", ";", " ")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def first_line(spark: SparkSession, path: str, comment: str | None = None) -> str:
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    lines = spark.read.text(path)
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    found = lines.limit(1).collect()
    return found[0]["value"] if found else ""


def delimiter(line: str) -> str:
    """The first of DELIMITERS that the line has; a comma if none."""
    return next((d for d in DELIMITERS if d in line), ",")


def read_table(spark: SparkSession, path: str, comment: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """A delimited file with a header; every column is text. An unnamed first column is called sample."""
    line = first_line(spark, path, comment)
    options = {"header": True, "sep": delimiter(line), "mode": mode, "inferSchema": False}
    if comment:
        options["comment"] = comment
    df = spark.read.options(**options).csv(path)
    names = [c.strip() for c in df.columns]
    if names and names[0] in ("", "_c0", "Unnamed: 0"):
        names[0] = "sample"
    return df.toDF(*names)


def fields(line: Column, sep: str, empty: bool = False) -> Column:
    """The fields of a delimited line as an array: split at once, or, where there are quotes, taken one by one. Empty ones are null, or, with empty, stay."""
    s = "\\t" if sep == "\t" else f"\\{sep}"
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf'{s}("(?:[^"\\]|\\.|"")*"|[^{s}]*)'), F.lit(1))
    plain = F.transform(quoted, lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r'\\(.)|"(")', "$1$2")).otherwise(x))
    found = F.when(line.contains('"'), plain).otherwise(F.split(line, s, -1))
    return found if empty else F.transform(found, lambda x: F.when(x != "", x))


def _lines(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """(names, cells): the trimmed fields of the header and the fields of each other line."""
    line = first_line(spark, path, None)
    sep = delimiter(line)
    names = spark.createDataFrame([(line,)], "line string").select(F.transform(fields(F.col("line"), sep), lambda x: F.trim(x)).alias("names"))  # one row
    rows = spark.read.text(path).where((F.col("value") != line) & (F.length("value") > 0)).select(fields(F.col("value"), sep, empty).alias("cells"))
    return rows.crossJoin(F.broadcast(names))


def read_matrix(spark: SparkSession, path: str, zeros: bool = True) -> DataFrame:
    """(row, name, value) of a wide delimited file: its first column, the header of each other column, and the cell as text, null where it is empty or missing.

    Lines are split into arrays, so thousands of columns are one column to Spark. Every file of a folder begins with the header. Quoted fields don't go over lines.
    zeros: with False, cells that are empty, missing or just 0 are left out before anything else is made of them; most of a wide file is that.
    """
    rows, first = _lines(spark, path, not zeros), F.col("cells")[0]
    if zeros:
        rows = rows.select(first.alias("row"), "names", F.posexplode(F.expr("transform(sequence(2, greatest(size(names), 2)), i -> try_element_at(cells, i))")).alias("at", "value")).withColumn("at", F.col("at") + 1)
    else:
        rows = rows.select(F.when(first != "", first).alias("row"), "names", F.posexplode("cells").alias("at", "value")).where("at > 0 and value <> '' and value <> '0'")
    return rows.select("row", F.try_element_at("names", F.col("at") + 1).alias("name"), "value").where("name is not null")


def matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row): the first column of a wide file that has others; its cells are not taken apart further."""
    return _lines(spark, path).where("exists(slice(names, 2, greatest(size(names) - 1, 0)), x -> x is not null)").select(F.col("cells")[0].alias("row"))


def read_cna(spark: SparkSession, path: str, genes_in_rows: bool = True, rename: bool = True) -> DataFrame:
    """(sample, gene, feature, value). With genes in rows, columns that name Entrez ids or hold a '|' are no samples. rename: features end in _CNA."""
    cells = read_matrix(spark, path)
    if genes_in_rows:
        long = cells.where("not (contains(name, 'Entrez') or contains(name, '|'))").select(F.col("name").alias("sample"), F.col("row").alias("gene"), "value")
    else:
        long = cells.select(F.col("row").alias("sample"), F.col("name").alias("gene"), "value")
    return long.select("sample", "gene", (F.concat("gene", F.lit("_CNA")) if rename else F.col("gene")).alias("feature"), number(F.col("value")).alias("value"))


def read_clinical(spark: SparkSession, path: str, metadata_rows: int = 0) -> DataFrame:
    """A clinical table: sample in upper case, headers normalised, as many leading rows left out as say what the columns mean."""
    df = read_table(spark, path)
    if metadata_rows:
        df = df.withColumn("_row", F.monotonically_increasing_id()).where(F.col("_row") >= metadata_rows).drop("_row")  # the first rows of the first split
    df = df.toDF("sample", *(header(c) for c in df.columns[1:]))
    return df.withColumn("sample", F.upper(F.trim("sample")))


def read_rna(spark: SparkSession, path: str, genes_in_rows: bool = False, zeros: bool = True) -> DataFrame:
    """(sample, gene, count) of a matrix, as it is, or, with zeros=False, without its zeros. The orientation is the caller's to say."""
    sample, gene = ("name", "row") if genes_in_rows else ("row", "name")
    rows = read_matrix(spark, path, zeros).select(F.col(sample).alias("sample"), F.col(gene).alias("gene"), number(F.col("value")).alias("count"))
    return rows if zeros else rows.where("count <> 0")


def rna_samples(spark: SparkSession, path: str, genes_in_rows: bool = False) -> DataFrame:
    """(sample) of every cell that read_rna gives, from the header or the first column alone."""
    return gene_universe(spark, path).withColumnRenamed("gene", "sample").where("sample is not null") if genes_in_rows else matrix_rows(spark, path).withColumnRenamed("row", "sample")


def read_fusions(spark: SparkSession, path: str) -> DataFrame:
    """(sample, site1, site2): partners from their own columns, or from fusion_name split at '--'. Rows that don't parse drop out; without ids or partners ValueError."""
    df = read_table(spark, path, mode="DROPMALFORMED")
    names = {c.lower(): c for c in df.columns}
    sample = names.get("sample_id") or names.get("sample")
    if sample is None:
        raise ValueError(f"no sample column among {df.columns}")
    if {"site1_hugo_symbol", "site2_hugo_symbol"} <= names.keys():
        partners: list[Column] = [F.col(f"`{names[f'site{i}_hugo_symbol']}`") for i in (1, 2)]
    elif "fusion_name" in names:
        parts = F.split(F.col(f"`{names['fusion_name']}`"), "--", 2)
        partners = [F.try_element_at(parts, F.lit(i)) for i in (1, 2)]
    else:
        raise ValueError(f"no fusion partners among {df.columns}")
    return df.select(F.coalesce(F.col(f"`{sample}`"), F.lit("nan")).alias("sample"), *(p.alias(f"site{i}") for i, p in enumerate(partners, 1)))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """(sample, gene, variant, ...) of a mutation annotation file."""
    df = read_table(spark, path, comment="#")
    rename = {"Tumor_Sample_Barcode": "sample", "Hugo_Symbol": "gene", "Variant_Classification": "variant", "Functional_Label": "label"}
    missing = {"Tumor_Sample_Barcode", "Hugo_Symbol"} - set(df.columns)
    if missing:
        raise KeyError(f"missing columns: {sorted(missing)}")
    return df.withColumnsRenamed(rename).withColumn("sample", F.upper(F.trim("sample")))


def read_alterations(spark: SparkSession, path: str) -> DataFrame:
    """(sample, feature, value) of a sample-by-feature table of 0 and 1, cells of 0 left out."""
    long = read_matrix(spark, path, zeros=False).select(F.col("row").alias("sample"), F.col("name").alias("feature"), number(F.col("value")).cast("int").alias("value"))
    return long.where("value <> 0")


def gene_universe(spark: SparkSession, path: str) -> DataFrame:
    """(gene): the header of an expression table; its rows are not read."""
    line = first_line(spark, path)
    names = spark.createDataFrame([(line,)], "line string").select(F.posexplode(fields(F.col("line"), delimiter(line))).alias("at", "gene"))
    return names.where("at > 0").select(F.trim("gene").alias("gene"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(alt, targets, effects, n_targets) of a JSON object of signatures; what is no object is left out."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("alt", "sig")).where(F.ltrim("sig").startswith("{"))
    sig = F.from_json("sig", "targets array<string>, effects map<string,double>, n_targets int")
    rows = rows.select("alt", sig.alias("s")).select("alt", F.coalesce("s.targets", F.array().cast("array<string>")).alias("targets"), F.col("s.effects").alias("effects"), F.col("s.n_targets").alias("n"))
    return rows.select("alt", "targets", "effects", F.coalesce("n", F.size("targets")).alias("n_targets"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(outer, inner, genes) of a JSON object of objects whose values are lists or delimited text; a missing file gives no rows."""
    schema = "outer string, inner string, genes array<string>"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("outer", "o")).where(F.ltrim("o").startswith("{"))
    rows = rows.select("outer", F.explode(F.from_json("o", "map<string,string>")).alias("inner", "g"))
    listed = F.from_json("g", "array<string>")
    return rows.select("outer", "inner", F.coalesce(F.when(F.ltrim("g").startswith("["), listed), as_list(F.col("g"))).alias("genes"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(alt, mean_abs_log2fc, median_abs_log2fc, max_abs_log2fc) of a table of differential expression results."""
    df = read_table(spark, path)
    pick = lambda c: number(F.col(f"`{c}`"))
    return df.select(F.col("alteration").alias("alt"), pick("mean_abs_log2FC_sig").alias("mean_abs_log2fc"), pick("median_abs_log2FC_sig").alias("median_abs_log2fc"), pick("abs_max_log2FC_sig").alias("max_abs_log2fc"))
