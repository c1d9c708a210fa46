"""Views of the driver's tables as study data, in Spark and as SQL.

Customers with orders are samples, brands are genes of alterations, part types and sizes are expressed genes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uniform

GENES = ("KRAS", "TP53", "NOTCH1", "NPM1", "SF3B1", "PTEN", "FLT3", "ETV6", "APC", "BRCA1", "GENE1", "GENE2")
VARIANTS = ("Missense_Mutation", "Nonsense_Mutation", "Frame_Shift_Del", "Splice_Site", "In_Frame_Ins", "Silent", "3'UTR", "Missense_Mutation")
#: Targets of a true signature.
TARGETS = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's customer and their part."""
    item, orders, part = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return item.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("sample", F.concat(F.lit("C"), "o_custkey"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("sample")).distinct()


def _altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "GOF").when(F.col("l_returnflag") == "A", "LOF").otherwise("MUT")
    return lines(spark, sf_dir).where("l_quantity >= 45").select("sample", F.concat_ws("_", "p_brand", kind).alias("feature"))


def alterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _altered(spark, sf_dir).distinct()


def _gene() -> Column:
    return F.concat_ws("_", "p_type", "p_size").alias("gene")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genes of expression, which is not added up for them."""
    return lines(spark, sf_dir).select(_gene()).distinct()


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("sample", _gene()).agg(F.sum("l_quantity").cast("long").alias("count"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return lines(spark, sf_dir).select("sample", pick(GENES, F.col("l_partkey")).alias("gene"), pick(VARIANTS, F.col("l_suppkey") + F.col("l_linenumber")).alias("variant"))


def fusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two genes for the first line of each order."""
    pick = lambda n: F.element_at(F.array(*map(F.lit, GENES)), (n % len(GENES) + 1).cast("int"))
    return lines(spark, sf_dir).where("l_linenumber = 1").select("sample", pick(F.col("l_partkey")).alias("site1"), pick(F.col("l_suppkey")).alias("site2"))


def brand_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression of the brands, as few columns as a wide file holds."""
    return lines(spark, sf_dir).groupBy("sample", F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").cast("long").alias("count"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.greatest(F.lit(-2), F.least(F.lit(2), F.max(F.rint(F.col("l_discount") * 100).cast("int")) - 5))
    return lines(spark, sf_dir).groupBy("sample", F.col("p_brand").alias("gene")).agg(v.alias("value"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    return _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("sample", F.concat(F.lit("C"), "c_custkey"))


def subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).join(samples(spark, sf_dir), "sample", "left_semi").select("sample", F.col("c_mktsegment").alias("subtype"))


def _picked(spark: SparkSession, sf_dir: str, tag: str, n: int) -> DataFrame:
    from pyspark.sql import Window

    alts = _altered(spark, sf_dir).select(F.col("feature").alias("alt")).distinct()
    order = Window.partitionBy("alt").orderBy(F.md5(F.concat_ws("|", F.lit(tag), "alt", "gene")), "gene")
    return alts.crossJoin(genes(spark, sf_dir)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _picked(spark, sf_dir, "truth", TARGETS)
    return rows.select("alt", "gene", (uniform("effect", F.col("alt"), F.col("gene")) * 4 - 2).alias("log2fc"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods: one finds the first half of the truth and some more, the other guesses."""
    half = _picked(spark, sf_dir, "truth", TARGETS // 2).select(F.lit("half").alias("method"), "alt", "gene")
    some = _picked(spark, sf_dir, "some", 3).select(F.lit("half").alias("method"), "alt", "gene")
    guess = _picked(spark, sf_dir, "guess", TARGETS).select(F.lit("guess").alias("method"), "alt", "gene")
    return half.union(some).union(guess).distinct()


def _pick_sql(values, n: str) -> str:
    texts = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{texts}][({n}) % {len(values)} + 1]"


def u_sql(*key: str) -> str:
    """The draw of functions.uniform in SQL; key parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8))::BIGINT / 4294967296.0)"


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"


def _picked_sql(tag: str, n: int) -> str:
    return f"SELECT alt, gene FROM (SELECT alt, gene, row_number() OVER (PARTITION BY alt ORDER BY md5(concat_ws('|', '{tag}', alt, gene)), gene) AS place FROM (SELECT DISTINCT feature AS alt FROM alt) a, (SELECT DISTINCT gene FROM expr) g) WHERE place <= {n}"


#: Each view as the body of a common table expression; a view may use those before it.
SQL = {
    "samples": "SELECT DISTINCT 'C' || o_custkey AS sample FROM orders",
    "alt": f"SELECT DISTINCT 'C' || o_custkey AS sample, p_brand || '_' || CASE l_returnflag WHEN 'R' THEN 'GOF' WHEN 'A' THEN 'LOF' ELSE 'MUT' END AS feature FROM {_LINES} WHERE l_quantity >= 45",
    "expr": f"SELECT 'C' || o_custkey AS sample, p_type || '_' || p_size AS gene, sum(l_quantity)::BIGINT AS count FROM {_LINES} GROUP BY 1, 2",
    "maf": f"SELECT 'C' || o_custkey AS sample, {_pick_sql(GENES, 'l_partkey')} AS gene, {_pick_sql(VARIANTS, 'l_suppkey + l_linenumber')} AS variant FROM {_LINES}",
    "fus": f"SELECT 'C' || o_custkey AS sample, {_pick_sql(GENES, 'l_partkey')} AS site1, {_pick_sql(GENES, 'l_suppkey')} AS site2 FROM {_LINES} WHERE l_linenumber = 1",
    "brand": f"SELECT 'C' || o_custkey AS sample, p_brand AS gene, sum(l_quantity)::BIGINT AS count FROM {_LINES} GROUP BY 1, 2",
    "cna": f"SELECT 'C' || o_custkey AS sample, p_brand AS gene, greatest(-2, least(2, max(round_even(l_discount * 100, 0)::INT) - 5)) AS value FROM {_LINES} GROUP BY 1, 2",
    "clin": "SELECT 'C' || c_custkey AS sample, * FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "subtype": "SELECT sample, c_mktsegment AS subtype FROM clin WHERE sample IN (SELECT sample FROM samples)",
    "truth": f"SELECT alt, gene, {u_sql(chr(39) + 'effect' + chr(39), 'alt', 'gene')} * 4 - 2 AS log2fc FROM ({_picked_sql('truth', TARGETS)})",
    "pred": f"SELECT DISTINCT * FROM (SELECT 'half' AS method, * FROM ({_picked_sql('truth', TARGETS // 2)}) UNION ALL SELECT 'half', * FROM ({_picked_sql('some', 3)}) UNION ALL SELECT 'guess', * FROM ({_picked_sql('guess', TARGETS)}))",
}


def with_views(*names: str) -> str:
    """WITH and the views named, with those that they use."""
    uses = {"subtype": ("samples", "clin"), "truth": ("alt", "expr"), "pred": ("alt", "expr")}
    wanted = {x for n in names for x in (*uses.get(n, ()), n)}
    return "WITH " + ", ".join(f"{n} AS ({body})" for n, body in SQL.items() if n in wanted)
