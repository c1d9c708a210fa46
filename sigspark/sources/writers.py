"""Writers. Tables are written by the executors; wide text is made at this edge only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cooccurrence import by_member
from ..operators.simulate import nested
from .scratch import stored


def wide(rows: DataFrame, column: str, value: str) -> DataFrame:
    """One row per sample and a column for each feature, absent cells 0."""
    names = [r[column] for r in rows.select(column).distinct().orderBy(column).collect()]  # a dimension
    return rows.groupBy("sample").pivot(column, names).agg(F.first(value)).fillna(0)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"' if any(c in text for c in '",\\') else text


def write_matrix(rows: DataFrame, column: str, value: str, path: str, compress: bool = False) -> None:
    """A line per sample and a column for each feature, absent cells 0, as comma-separated text. Nothing is pivoted: a sample's cells are
    an array in the order of the columns, and between two of them stand as many zeros as there are columns. Of cells that repeat, the least counts.

    The rows are stored once, as the columns must be known before a line is written; they are dealt by sample, never by column.
    """
    rows = stored(rows.select("sample", F.col(column).alias("_name"), F.col(value).alias("_value")))
    names = [r["_name"] for r in rows.select("_name").distinct().orderBy("_name").collect()]  # a dimension
    head = ",".join(["sample", *map(_quoted, names)])
    places = F.broadcast(rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "_name string, _at int"))  # a row per column
    cell = F.when(F.col("_value").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_value").alias("v")))
    lines = rows.join(places, "_name").select("sample", cell.alias("cell")).repartition("sample").groupBy("sample").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    lines = lines.withColumn("cells", F.expr("filter(cells, (x, i) -> i = 0 or x.at <> cells[greatest(i, 1) - 1].at)"))
    id_ = F.when(F.col("sample").rlike('[",\\\\]'), F.concat(F.lit('"'), F.regexp_replace("sample", '(["\\\\])', "\\\\$1"), F.lit('"'))).otherwise(F.col("sample"))
    text = F.expr("array_join(transform(cells, (x, i) -> concat(repeat(',0', x.at - if(i = 0, -1, cells[greatest(i, 1) - 1].at) - 1), ',', cast(x.v as string))), '')")
    rest = F.expr(f"repeat(',0', {len(names)} - 1 - coalesce(try_element_at(cells, -1).at, -1))")
    lines = lines.select(F.concat(F.coalesce(id_, F.lit("")), text, rest).alias("value"))

    def headed(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    lines.mapInArrow(headed, "value string").write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_simulation(out: str, suffix: str, counts: DataFrame, alterations: DataFrame, signatures: DataFrame, compress: bool = False, **extra: DataFrame | None) -> list[str]:
    """rna_simulated, alterations and true_signatures, and whichever extra matrices (rna_real, binary_alt, alt_real, alt_gistic, background_exp) are given."""
    paths = []
    tables = {"rna_simulated": (counts, "gene", "count"), "alterations": (alterations, "feature", "value")}
    for name, df in extra.items():
        if df is not None:
            tables[name] = (df, *(("gene", df.columns[-1]) if "gene" in df.columns else ("feature", "value")))
    for name, (df, column, value) in tables.items():
        paths.append(f"{out}/{name}_{suffix}.csv")
        write_matrix(df, column, value, paths[-1], compress)
    paths.append(f"{out}/true_signatures_{suffix}.json")
    write_json(nested(signatures), paths[-1])
    return paths


def write_robustness(out: str, dataset: str, alt_table: DataFrame, co: DataFrame, pairs: DataFrame, truth_alts: DataFrame) -> DataFrame:
    """The tables of a robustness analysis; returns the pairs once for each of their members that has a true signature."""
    members = by_member(pairs).join(truth_alts.select(F.col("alt").alias("query_alteration")).distinct(), "query_alteration", "left_semi")
    write_csv(alt_table, f"{out}/robustness_{dataset}.csv")
    for kind in ("obs", "exp", "diff"):
        write_csv(co.select("alt1", "alt2", kind), f"{out}/cooccurrence_{kind}_{dataset}.csv")
    write_csv(members, f"{out}/fisher_{dataset}.csv")
    return members


def write_evaluation(out: str, dataset: str, individual: DataFrame, overall: DataFrame, predictions: DataFrame, diagnostics: DataFrame) -> None:
    write_csv(individual, f"{out}/individual_results_{dataset}.csv")
    write_csv(overall, f"{out}/overall_results_{dataset}.csv")
    write_json(predictions, f"{out}/predicted_signatures_{dataset}.json")
    write_json(diagnostics, f"{out}/diagnostics_{dataset}.json")


def write_theory(replicates: DataFrame, path: str) -> None:
    """The fitted and expected slopes of all replicates."""
    write_csv(replicates.orderBy("rep"), path)
