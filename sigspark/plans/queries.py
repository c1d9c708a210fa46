"""One query for each operator over the driver's tables, and its SQL. Floating results are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import alteration_gene, alteration_kind, alteration_partners, as_list, block_of, gene_prefix, patient_id, patient_index, simulated_genes, theory_c1
from ..operators import align, clinical, cna, cooccurrence, deconfounder, design, differential, evaluate, knn, linear, mutations, rna, simulate, theory
from ..sources import scratch
from . import views as v
from .views import u_sql, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, places).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields))


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- pairs of alterations ----------------------------------------------------------------------------------------

_FREQ = "freq AS (SELECT feature, count(DISTINCT sample) AS ones FROM alt GROUP BY 1), n AS (SELECT count(*) AS n FROM samples)"
_TABLES = f"{_FREQ}, co AS (SELECT x.feature AS alt1, y.feature AS alt2, count(*) AS k FROM alt x JOIN alt y USING (sample) WHERE x.feature < y.feature GROUP BY 1, 2), tab AS (SELECT f.feature AS alt1, g.feature AS alt2, coalesce(k, 0) AS a, f.ones - coalesce(k, 0) AS b, g.ones - coalesce(k, 0) AS c, n - f.ones - g.ones + coalesce(k, 0) AS d, n FROM freq f JOIN freq g ON f.feature < g.feature LEFT JOIN co ON alt1 = f.feature AND alt2 = g.feature, n)"
_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_FISHER = f"""{_TABLES}, sup AS (SELECT *, unnest(range(greatest(0, a + b + a + c - n), least(a + b, a + c) + 1)) AS k FROM tab),
    pm AS (SELECT *, exp({_LC.format('(a + c)', 'k')} + {_LC.format('(n - a - c)', '(a + b - k)')} - {_LC.format('n', '(a + b)')}) AS w FROM sup),
    pv AS (SELECT alt1, alt2, least(1.0, sum(w) FILTER (w <= seen * (1 + 1e-7))) AS p FROM (SELECT *, max(w) FILTER (k = a) OVER (PARTITION BY alt1, alt2) AS seen FROM pm) GROUP BY 1, 2),
    pairs AS (SELECT alt1, alt2, a AS co_count, a / n AS co_percent, CASE WHEN a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 THEN NULL WHEN b * c = 0 THEN 'inf'::DOUBLE ELSE a * d / (b * c) END AS odds_ratio, ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5)) AS odds_smooth, p FROM tab JOIN pv USING (alt1, alt2))"""


@query(f"{with_views('alt')} SELECT x.feature AS alt1, y.feature AS alt2, count(*) AS co_count FROM alt x JOIN alt y USING (sample) WHERE x.feature < y.feature GROUP BY 1, 2")
def cooccurrence_counts(spark, sf_dir):
    return cooccurrence.pair_counts(v.alterations(spark, sf_dir))


@query(f"{with_views('samples', 'alt')}, {_TABLES} SELECT alt1, alt2, a AS obs, round((a + b) * (a + c) / n, 6) AS exp, round(a - (a + b) * (a + c) / n, 6) AS diff FROM tab")
def cooccurrence_expected(spark, sf_dir):
    return rounded(cooccurrence.expected(v.alterations(spark, sf_dir), v.samples(spark, sf_dir)))


@query(f"{with_views('samples', 'alt')}, {_FISHER} SELECT alt1, alt2, co_count, round(co_percent, 6) AS co_percent, round(odds_ratio, 6) AS odds_ratio, round(odds_smooth, 6) AS odds_smooth, round(p, 6) AS p FROM pairs")
def fisher_pairs(spark, sf_dir):
    return rounded(cooccurrence.fisher_pairs(v.alterations(spark, sf_dir), v.samples(spark, sf_dir)))


@query(f"{with_views('samples', 'alt')}, {_FISHER}, m AS (SELECT unnest([alt1, alt2]) AS alteration, * FROM pairs) SELECT alteration, count(*) AS n_pairs, round(avg(abs(ln(odds_smooth))), 6) AS mean_abs_log_or, round(max(abs(ln(odds_smooth))), 6) AS max_abs_log_or, round(avg(co_count), 6) AS mean_co_count, max(co_count) AS max_co_count, round(avg(co_percent), 6) AS mean_co_percent, round(max(co_percent), 6) AS max_co_percent FROM m GROUP BY 1")
def pair_summary_by_alt(spark, sf_dir):
    return rounded(cooccurrence.pair_summary(cooccurrence.fisher_pairs(v.alterations(spark, sf_dir), v.samples(spark, sf_dir))))


# ---- variants and features ---------------------------------------------------------------------------------------


def _in(values) -> str:
    return "(" + ", ".join(f"'{x}'" for x in sorted(values)) + ")"


def _classify_sql(disease: str) -> str:
    rules = [f"WHEN variant IN {_in(config.DROPPED)} THEN 'Drop'"]
    if disease in ("ALL", "T-ALL"):
        rules.append("WHEN gene = 'NOTCH1' THEN 'GOF'")
    if disease == "AML":
        rules.append(f"WHEN gene = 'NPM1' AND variant IN {_in(config.TRUNCATING)} THEN 'GOF'")
    onc, sup = _in(config.oncogenes(disease)), _in(config.suppressors(disease))
    rules += [
        f"WHEN gene IN {_in(config.MISSENSE_DRIVERS)} AND variant IN {_in(config.MISSENSE)} THEN 'GOF'",
        f"WHEN gene IN {onc} AND variant IN {_in(config.MISSENSE | config.INFRAME)} THEN 'GOF'",
        f"WHEN gene IN {onc} AND variant IN {_in(config.TRUNCATING)} THEN 'Unclear'",
        f"WHEN gene IN {sup} AND variant IN {_in(config.TRUNCATING | config.SPLICE)} THEN 'LOF'",
    ]
    return f"CASE {' '.join(rules)} ELSE 'Unclear' END"


_LABELLED = f"{with_views('maf')}, lab AS (SELECT sample, gene, {_classify_sql('ALL')} AS label FROM maf), func AS (SELECT DISTINCT gene FROM lab WHERE label IN ('GOF', 'LOF')), unc AS (SELECT gene, count(*) / (SELECT count(DISTINCT sample) FROM lab WHERE label = 'Unclear') AS freq FROM lab WHERE label = 'Unclear' GROUP BY 1), top AS (SELECT * FROM (SELECT * FROM unc ORDER BY freq DESC, gene LIMIT 6) WHERE gene NOT IN (SELECT gene FROM func))"


def _labelled(spark, sf_dir):
    rows = v.variants(spark, sf_dir)
    return rows.select("sample", "gene", mutations.classify_variant(F.col("gene"), "ALL", F.col("variant")).alias("label"))


@query(" UNION ALL ".join(f"(SELECT '{d}' AS disease, gene, variant, label, count(*) AS n FROM ({with_views('maf')} SELECT gene, variant, {_classify_sql(d)} AS label FROM maf) GROUP BY 1, 2, 3, 4)" for d in ("ALL", "AML", "BRCA", "OTHER")))
def variant_classify(spark, sf_dir):
    rows = v.variants(spark, sf_dir)
    labels = F.explode(F.array(*(F.struct(F.lit(d).alias("disease"), mutations.classify_variant(F.col("gene"), d, F.col("variant")).alias("label")) for d in ("ALL", "AML", "BRCA", "OTHER"))))
    return rows.select("gene", "variant", labels.alias("x")).groupBy("x.disease", "gene", "variant", "x.label").agg(F.count("*").alias("n"))


@query(f"{_LABELLED} SELECT DISTINCT sample, gene || '_' || label AS feature FROM lab WHERE label IN ('GOF', 'LOF') UNION ALL SELECT DISTINCT sample, gene || '_MUT' FROM lab WHERE label = 'Unclear' AND gene IN (SELECT gene FROM top)")
def maf_onehot(spark, sf_dir):
    return mutations.maf_features(_labelled(spark, sf_dir), top_k=6)


@query(f"{_LABELLED} SELECT gene, round(freq, 6) AS freq FROM top")
def uncertain_topk(spark, sf_dir):
    return rounded(mutations.uncertain_genes(_labelled(spark, sf_dir), top_k=6))


@query(f"{with_views('samples', 'alt')}, {_FREQ}, kept AS (SELECT feature FROM freq, n WHERE CASE WHEN n < 100 THEN ones >= 3 ELSE ones / n >= 0.05 END QUALIFY n < 100 OR row_number() OVER (ORDER BY ones DESC, feature) <= 40) SELECT feature, count(*) AS n FROM alt WHERE feature IN (SELECT feature FROM kept) GROUP BY 1")
def freq_filter(spark, sf_dir):
    rows = v.alterations(spark, sf_dir).withColumn("value", F.lit(1))
    return mutations.frequent_features(rows, v.samples(spark, sf_dir), 0.05, top=40).groupBy("feature").agg(F.count("*").alias("n"))


@query(f"{with_views('cna')} SELECT feature, count(*) AS n FROM (SELECT gene AS feature, value FROM cna) WHERE feature IN (SELECT gene FROM cna WHERE value <> 0 GROUP BY gene ORDER BY count(DISTINCT sample) DESC, gene LIMIT 10) GROUP BY 1")
def cna_top_features(spark, sf_dir):
    rows = v.copies(spark, sf_dir).withColumnRenamed("gene", "feature")
    return mutations.top_features(rows, 10).groupBy("feature").agg(F.count("*").alias("n"))


_IDS = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' tcga-ab-' WHEN 1 THEN 'TCGA-ZZ-' ELSE 'NOT-' END || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || CASE c_custkey % 2 WHEN 0 THEN '-01A ' ELSE '' END AS raw FROM customer"


@query(f"SELECT c_custkey, CASE WHEN regexp_matches(upper(trim(raw)), 'TCGA-\\w{{2}}-\\w{{4}}') THEN regexp_extract(upper(trim(raw)), 'TCGA-\\w{{2}}-\\w{{4}}') END AS patient, substr(upper(trim(raw)), 1, 12) AS cut, trim(raw) AS kept FROM ({_IDS})")
def patient_id_map(spark, sf_dir):
    key = F.col("c_custkey")
    raw = F.concat(F.when(key % 3 == 0, " tcga-ab-").when(key % 3 == 1, "TCGA-ZZ-").otherwise("NOT-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.when(key % 2 == 0, "-01A ").otherwise(""))
    return _table(spark, sf_dir, "customer").select("c_custkey", patient_id(F.upper(raw), "TCGA").alias("patient"), patient_index(raw, "tcga").alias("cut"), patient_id(raw, "other").alias("kept"))


_NAMES = "SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN p_brand || '_GOF' WHEN 1 THEN p_brand || '_LOF' WHEN 2 THEN p_brand || '_CNA_DEL' WHEN 3 THEN p_type || '_AMP' WHEN 4 THEN p_brand || '--' || p_type || '_FUSION' WHEN 5 THEN p_type || '-' || p_brand || '_FUSION' ELSE p_type || '_MUT' END AS alt FROM part"


def _names(spark, sf_dir):
    k, brand, kind = F.col("p_partkey") % 7, F.col("p_brand"), F.col("p_type")
    name = (
        F.when(k == 0, F.concat(brand, F.lit("_GOF"))).when(k == 1, F.concat(brand, F.lit("_LOF"))).when(k == 2, F.concat(brand, F.lit("_CNA_DEL"))).when(k == 3, F.concat(kind, F.lit("_AMP")))
        .when(k == 4, F.concat(brand, F.lit("--"), kind, F.lit("_FUSION"))).when(k == 5, F.concat(kind, F.lit("-"), brand, F.lit("_FUSION"))).otherwise(F.concat(kind, F.lit("_MUT")))
    )
    return _table(spark, sf_dir, "part").select(name.alias("alt")).distinct()


@query(f"""SELECT alt, kind, CASE WHEN kind = 'FUSION' THEN parts[1] WHEN kind <> 'OTHER' THEN left(alt, length(alt) - 4) END AS gene,
    CASE WHEN kind = 'FUSION' THEN array_to_string(parts, '+') ELSE '' END AS partners,
    CASE WHEN kind = 'FUSION' THEN array_to_string(string_split(replace(alt, '_FUSION', ''), '-'), '+') WHEN kind <> 'OTHER' THEN regexp_replace(alt, '_[^_]*$', '') ELSE '' END AS simulated, string_split(alt, '_')[1] AS prefix
    FROM (SELECT *, CASE WHEN contains(body, '--') THEN string_split(body, '--') ELSE string_split(body, '-') END AS parts FROM (SELECT alt, CASE WHEN alt LIKE '%\\_FUSION' ESCAPE '\\' THEN 'FUSION' WHEN alt LIKE '%\\_GOF' ESCAPE '\\' THEN 'GOF' WHEN alt LIKE '%\\_LOF' ESCAPE '\\' THEN 'LOF' WHEN alt LIKE '%\\_AMP' ESCAPE '\\' THEN 'AMP' WHEN alt LIKE '%\\_DEL' ESCAPE '\\' THEN 'DEL' ELSE 'OTHER' END AS kind, regexp_replace(alt, '_FUSION$', '') AS body FROM ({_NAMES})))""")
def parse_alt(spark, sf_dir):
    a = F.col("alt")
    return _names(spark, sf_dir).select("alt", alteration_kind(a).alias("kind"), alteration_gene(a).alias("gene"), F.array_join(alteration_partners(a), "+").alias("partners"), F.array_join(simulated_genes(a), "+").alias("simulated"), gene_prefix(a).alias("prefix"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(CASE WHEN contains(t, ';') THEN string_split(t, ';') ELSE string_split(t, ',') END, lambda x: trim(x)), lambda x: length(x) > 0), '|') AS items FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '; ' || p_type || ';' WHEN 1 THEN p_brand || ', ' || p_type WHEN 2 THEN p_name ELSE ' , ' END AS t FROM part)")
def as_list_tokens(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat("p_brand", F.lit("; "), "p_type", F.lit(";"))).when(k == 1, F.concat("p_brand", F.lit(", "), "p_type")).when(k == 2, F.col("p_name")).otherwise(" , ")
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(as_list(text), "|").alias("items"))


@query(f"SELECT alt AS feature, CASE WHEN regexp_matches(alt, '_(MUT|GOF|LOF)$') THEN 'mut' WHEN regexp_matches(alt, '_FUS(ION)?') THEN 'fusion' WHEN regexp_matches(alt, '_(CNA|AMP|DEL|AMP_LVL|DEL_LVL)$') THEN 'cna' WHEN lower(alt) = 'subtype' THEN 'subtype' ELSE 'clinical' END AS block FROM (SELECT alt FROM ({_NAMES}) UNION ALL SELECT unnest(['Subtype', 'Age', 'G1_CNA', 'G1__AMP_LVL']))")
def split_blocks(spark, sf_dir):
    more = spark.createDataFrame([(x,) for x in ("Subtype", "Age", "G1_CNA", "G1__AMP_LVL")], "alt string")
    return _names(spark, sf_dir).union(more).select(F.col("alt").alias("feature"), block_of(F.col("alt")).alias("block"))


@query("SELECT 'C' || o_custkey AS sample, a.p_brand || '--' || b.p_brand || '_FUSION' AS feature, count(*) AS value FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 JOIN part a ON x.l_partkey = a.p_partkey JOIN part b ON y.l_partkey = b.p_partkey JOIN orders ON x.l_orderkey = o_orderkey GROUP BY 1, 2")
def fusion_counts(spark, sf_dir):
    rows = v.lines(spark, sf_dir)
    left = rows.select("sample", "l_orderkey", (F.col("l_linenumber") + 1).alias("at"), F.col("p_brand").alias("site1"))
    right = rows.select("l_orderkey", F.col("l_linenumber").alias("at"), F.col("p_brand").alias("site2"))
    return mutations.fusion_counts(left.join(right, ["l_orderkey", "at"]))


# ---- clinical ----------------------------------------------------------------------------------------------------


@query(f"{with_views('clin')} SELECT sample, n_name AS subtype FROM clin QUALIFY count(*) OVER (PARTITION BY n_name) >= 6")
def subtype_filter(spark, sf_dir):
    return clinical.subtypes(v.customers(spark, sf_dir).select("sample", F.col("n_name").alias("Disease Subtype")), 6)


@query(f"{with_views('clin')} SELECT sample, 'c_mktsegment_' || c_mktsegment AS feature, 1.0::DOUBLE AS value FROM clin UNION ALL SELECT sample, 'n_name_' || n_name, 1.0::DOUBLE FROM clin")
def onehot_clinical(spark, sf_dir):
    return clinical.one_hot(v.customers(spark, sf_dir), ["c_mktsegment", "n_name"])


@query(f"{with_views('clin')} SELECT * FROM (SELECT 'a' AS \"column\", round(avg(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END), 6) AS share FROM clin UNION ALL SELECT 'b', round(avg(CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END), 6) FROM clin UNION ALL SELECT 'c', 0.0::DOUBLE)")
def missingness_filter(spark, sf_dir):
    rows = v.customers(spark, sf_dir).select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_nationkey") % 2 == 1, F.col("n_name")).alias("b"), F.col("c_mktsegment").alias("c"))
    return rounded(clinical.missing_shares(rows, ["a", "b", "c"]))


@query(f"{with_views('samples', 'alt', 'clin')}, s AS (SELECT sample FROM clin WHERE sample IN (SELECT sample FROM alt)), cells AS (SELECT sample, feature, 1.0 AS value FROM alt UNION ALL SELECT sample, 'SUBTYPE_' || c_mktsegment, 1.0 FROM clin WHERE sample IN (SELECT sample FROM s)), grid AS (SELECT s.sample, f.feature, coalesce(value, 0.0)::DOUBLE AS v FROM s CROSS JOIN (SELECT DISTINCT feature FROM cells) f LEFT JOIN cells USING (sample, feature) UNION ALL SELECT sample, 'DIAGNOSIS_AGE', c_acctbal FROM clin WHERE sample IN (SELECT sample FROM s)), z AS (SELECT sample, feature, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS value FROM grid WINDOW w AS (PARTITION BY feature)) SELECT feature, count(*) AS n, round(sum(abs(value)) / count(*), 6) AS mean_abs, round(max(value), 6) AS most FROM z GROUP BY 1")
def encode_alterations_clinical(spark, sf_dir):
    alts = v.alterations(spark, sf_dir).withColumn("value", F.lit(1))
    table = v.customers(spark, sf_dir).select("sample", F.col("c_mktsegment").alias("SUBTYPE"), F.col("c_acctbal").alias("DIAGNOSIS_AGE"), F.col("n_name").alias("other"))
    rows = clinical.encode(alts, table, v.samples(spark, sf_dir), "AML")
    return rounded(rows.groupBy("feature").agg(F.count("*").alias("n"), (F.sum(F.abs("value")) / F.count("*")).alias("mean_abs"), F.max("value").alias("most")))


# ---- copy numbers ------------------------------------------------------------------------------------------------


@query(f"{with_views('samples', 'cna')}, n AS (SELECT count(*) AS n FROM samples) SELECT gene, round(count(*) FILTER (value > 0) / any_value(n), 6) AS p_amp, round(count(*) FILTER (value < 0) / any_value(n), 6) AS p_del, round((any_value(n) - count(*) FILTER (value <> 0)) / any_value(n), 6) AS p_neu, round(coalesce(count(*) FILTER (value = 2) / nullif(count(*) FILTER (value > 0), 0), 0), 6) AS q_amp2, round(coalesce(count(*) FILTER (value = -2) / nullif(count(*) FILTER (value < 0), 0), 0), 6) AS q_del2 FROM cna, n GROUP BY gene")
def cna_event_params(spark, sf_dir):
    return rounded(cna.event_params(v.copies(spark, sf_dir), v.samples(spark, sf_dir)))


@query(f"{with_views('cna')} SELECT sample, gene || '_AMP' AS feature, (value > 0)::INT AS value FROM cna UNION ALL SELECT sample, gene || '_DEL', (value < 0)::INT FROM cna")
def cna_amp_del(spark, sf_dir):
    return cna.amp_del(v.copies(spark, sf_dir))


@query(f"{with_views('cna')} SELECT sample, gene || '_AMP' AS feature, greatest(value, 0)::DOUBLE AS value FROM cna WHERE value > 0 UNION ALL SELECT sample, gene || '_DEL', greatest(-value, 0)::DOUBLE FROM cna WHERE value < 0")
def severity_weights(spark, sf_dir):
    states = v.copies(spark, sf_dir)
    return cna.with_severity(cna.amp_del(states).where("value = 1"), states)


@query(f"{with_views('cna')} SELECT sample, gene || '__AMP_LVL' AS feature, greatest(value, 0)::DOUBLE AS value FROM cna UNION ALL SELECT sample, gene || '__DEL_LVL', greatest(-value, 0)::DOUBLE FROM cna")
def cna_dosage(spark, sf_dir):
    return cna.dosage(v.copies(spark, sf_dir))


# ---- alignment ---------------------------------------------------------------------------------------------------


def _blocks(spark, sf_dir):
    return {"alt": v.alterations(spark, sf_dir), "cna": v.copies(spark, sf_dir).where("value = 2"), "subtype": v.subtypes(spark, sf_dir).where("subtype <> 'BUILDING'")}


_BLOCKS_SQL = "ids AS (SELECT DISTINCT sample, 'alt' AS block FROM alt UNION ALL SELECT DISTINCT sample, 'cna' FROM cna WHERE value = 2 UNION ALL SELECT DISTINCT sample, 'subtype' FROM subtype WHERE subtype <> 'BUILDING')"


@query(f"{with_views('alt', 'cna', 'subtype')}, {_BLOCKS_SQL}, common AS (SELECT sample FROM ids GROUP BY 1 HAVING count(*) = 3) SELECT feature, count(*) AS n FROM alt WHERE sample IN (SELECT sample FROM common) GROUP BY 1")
def integrate_semi_join(spark, sf_dir):
    return align.aligned(_blocks(spark, sf_dir))["alt"].groupBy("feature").agg(F.count("*").alias("n"))


@query(f'{with_views("alt", "cna", "subtype")}, {_BLOCKS_SQL} SELECT x.block AS "left", y.block AS "right", count(*) AS common FROM ids x JOIN ids y USING (sample) WHERE x.block < y.block GROUP BY 1, 2')
def modality_overlap(spark, sf_dir):
    return align.overlaps(_blocks(spark, sf_dir))


# ---- expression --------------------------------------------------------------------------------------------------

_DENSE = "genes AS (SELECT DISTINCT gene FROM expr), cells AS (SELECT s.sample, g.gene, coalesce(count, 0)::DOUBLE AS count FROM (SELECT DISTINCT sample FROM expr) s CROSS JOIN genes g LEFT JOIN expr USING (sample, gene))"


def _rna(spark, sf_dir):
    counts = v.expression(spark, sf_dir)
    return counts, counts.select("sample").distinct(), counts.select("gene").distinct()


@query(f"{with_views('expr')}, {_DENSE}, q AS (SELECT quantile_cont(count, 0.75) AS q FROM cells GROUP BY gene), m AS (SELECT median(q) AS q FROM q) SELECT round(q, 6) AS q75, CASE WHEN q < 1 THEN 100.0 WHEN q < 10 THEN 50.0 WHEN q < 100 THEN 10.0 ELSE 1.0 END::DOUBLE AS factor FROM m")
def rna_scale_factor(spark, sf_dir):
    return rounded(rna.scale_factor(*_rna(spark, sf_dir)))


@query(f"{with_views('expr')} SELECT sample, gene, greatest(round_even(count * 0.25, 0), 0)::BIGINT AS count FROM expr")
def rna_manual_counts(spark, sf_dir):
    return rna.as_counts(*_rna(spark, sf_dir), strategy="manual", scale=0.25)


@query(f"{with_views('expr')} SELECT sample, gene, round(count / t * 1e6, 4) AS cpm, round(ln(1 + count / t * 1e6), 6) AS log_cpm FROM (SELECT *, sum(count) OVER (PARTITION BY sample) AS t FROM expr)")
def cpm_log(spark, sf_dir):
    return rna.log_cpm(v.expression(spark, sf_dir)).select("sample", "gene", F.round("cpm", 4).alias("cpm"), F.round("log_cpm", 6).alias("log_cpm"))


def _select_sql(spread: str) -> str:
    return f"""{with_views('expr')}, {_DENSE}, lc AS (SELECT sample, gene, count / sum(count) OVER (PARTITION BY sample) * 1e6 AS cpm FROM cells), st AS (SELECT gene, avg((cpm >= 1)::INT) AS expressed, {spread} AS var FROM lc GROUP BY gene),
        fl AS (SELECT *, gene LIKE '%\\_7' ESCAPE '\\' AS altered, expressed < 0.12 AS low FROM st), rk AS (SELECT *, row_number() OVER (PARTITION BY altered OR low ORDER BY round(var, 9) DESC, gene) AS r FROM fl)
        SELECT gene, altered, low, altered OR (NOT low AND r <= 60 - (SELECT count(*) FROM fl WHERE altered)) AS kept FROM rk"""


def _select(spark, sf_dir, mad):
    counts = scratch.stored(v.expression(spark, sf_dir))
    samples, genes = counts.select("sample").distinct(), counts.select("gene").distinct()
    altered = genes.where(F.col("gene").endswith("_7"))
    return rna.select_genes(counts, samples, genes, altered, target=60, min_share=0.12, mad=mad, counts=True)


@query(_select_sql("var_samp(ln(1 + cpm))"))
def gene_select_var(spark, sf_dir):
    return _select(spark, sf_dir, False)


@query(_select_sql("mad(ln(1 + cpm))"))
def gene_select_mad(spark, sf_dir):
    return _select(spark, sf_dir, True)


_FACTORS = "geo AS (SELECT gene, exp(avg(ln(count))) AS g FROM expr WHERE count > 0 GROUP BY 1), sf AS (SELECT sample, median(count / g) AS sf FROM expr JOIN geo USING (gene) WHERE count > 0 GROUP BY 1)"


@query(f"{with_views('expr')}, {_FACTORS} SELECT sample, round(sf, 6) AS size_factor FROM sf")
def size_factors(spark, sf_dir):
    return rounded(rna.size_factors(v.expression(spark, sf_dir)))


_NORMAL = f"{_DENSE}, {_FACTORS}, y AS (SELECT sample, gene, ln(2 + count / sf) AS value FROM cells JOIN sf USING (sample))"


@query(f"{with_views('expr')}, {_NORMAL} SELECT gene, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM y GROUP BY 1")
def median_of_ratios_log(spark, sf_dir):
    counts, _, genes = _rna(spark, sf_dir)
    return rounded(rna.normalised(counts, genes).groupBy("gene").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")))


@query(f"{with_views('expr')}, {_NORMAL}, z AS (SELECT gene, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS z FROM y WINDOW w AS (PARTITION BY gene)) SELECT gene, round(max(z), 5) AS most, round(min(z), 5) AS least, round(sum(z * z) / count(*), 5) AS square FROM z GROUP BY 1")
def zscore_genes(spark, sf_dir):
    counts, _, genes = _rna(spark, sf_dir)
    z = rna.normalised(counts, genes, zscore=True)
    return rounded(z.groupBy("gene").agg(F.max("value").alias("most"), F.min("value").alias("least"), (F.sum(F.col("value") * F.col("value")) / F.count("*")).alias("square")), 5)


@query(f"{with_views('samples', 'cna')}, cells AS (SELECT s.sample, g.gene AS feature, coalesce(value, 0)::DOUBLE AS v FROM samples s CROSS JOIN (SELECT DISTINCT gene FROM cna) g LEFT JOIN cna c ON c.sample = s.sample AND c.gene = g.gene) SELECT sample, feature, round((v - avg(v) OVER w) / greatest(coalesce(stddev_samp(v) OVER w, 0), 0.25), 6) AS value FROM cells WINDOW w AS (PARTITION BY feature)")
def robust_scale_floor(spark, sf_dir):
    states = v.copies(spark, sf_dir).withColumnRenamed("gene", "feature")
    return rounded(rna.floor_scaled(align.dense(states, v.samples(spark, sf_dir), states)))


@query(f"{with_views('expr')}, n AS (SELECT count(DISTINCT sample) AS n FROM expr), st AS (SELECT gene, sum(count) / any_value(n) AS mean, greatest((sum(count * count) - any_value(n) * (sum(count) / any_value(n)) * (sum(count) / any_value(n))) / (any_value(n) - 1), 0) AS variance FROM expr, n GROUP BY 1) SELECT gene, round(mean, 6) AS mean, round(variance, 5) AS variance, round(coalesce(least(greatest((variance - mean) / (mean * mean), 1e-6), 1e6), 0.1), 6) AS dispersion FROM st")
def moment_dispersions(spark, sf_dir):
    counts, samples, _ = _rna(spark, sf_dir)
    d = simulate.moment_dispersions(counts, samples)
    return d.select("gene", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"), F.round("dispersion", 6).alias("dispersion"))


# ---- design ------------------------------------------------------------------------------------------------------


@query(f"{with_views('samples', 'alt')}, n AS (SELECT count(*) AS n FROM samples), st AS (SELECT feature, count(*) AS ones, list_sort(list(sample))::VARCHAR AS sig FROM alt GROUP BY 1), r AS (SELECT *, CASE WHEN ones = 0 OR ones = n THEN 'constant' WHEN ones < 80 OR n - ones < 80 THEN 'imbalanced' END AS reason FROM st, n), d AS (SELECT feature, ones, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, sig ORDER BY feature) > 1 THEN 'duplicate' ELSE reason END AS reason FROM r) SELECT feature, ones, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL ORDER BY (contains(feature, 'GOF') OR contains(feature, 'LOF') OR contains(feature, 'FUSION')) DESC, ones DESC, feature) END AS place FROM d")
def sanitize_report(spark, sf_dir):
    alts = v.alterations(spark, sf_dir)
    return design.column_report(alts, v.samples(spark, sf_dir), alts.select("feature"), 80).withColumn("place", F.col("place").cast("long"))


@query()
def sanitize_fates(spark, sf_dir):
    alts = v.alterations(spark, sf_dir)
    return design.sanitised(alts, v.samples(spark, sf_dir), alts.select("feature"))


@query(f"{with_views('samples', 'alt')}, n AS (SELECT count(*) AS n FROM samples), a AS (SELECT feature AS alt, count(*) AS n1 FROM alt GROUP BY 1) SELECT alt, n1, n - n1 AS n0, CASE WHEN n1 = 0 OR n1 = n THEN 'SKIPPED: constant or low variance' WHEN n1 < 90 OR n - n1 < 90 THEN 'SKIPPED: insufficient group sizes' ELSE 'ok' END AS status FROM a, n")
def alteration_gate(spark, sf_dir):
    alts = v.alterations(spark, sf_dir)
    return linear.alteration_gate(alts, v.samples(spark, sf_dir), alts.select(F.col("feature").alias("alt")), 90)


@query(f"{with_views('alt')} SELECT x.feature AS f1, y.feature AS f2, count(*) AS value FROM alt x JOIN alt y USING (sample) GROUP BY 1, 2")
def gram_matrix(spark, sf_dir):
    return design.gram(v.alterations(spark, sf_dir))


# ---- neighbours and simulation -----------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("string").alias("subtype"))


@query("WITH e AS (SELECT lpad(vec_id::VARCHAR, 9, '0') AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), d AS (SELECT a.id AS query, b.id AS neighbor, list_distance(a.v, b.v) AS distance FROM e a, e b) SELECT query, neighbor, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor)::INT AS rank FROM d QUALIFY rank <= 4")
def knn_neighbors(spark, sf_dir):
    vec = _vectors(spark, sf_dir)
    return rounded(knn.nearest(vec, vec, 4))


_EMB = "e AS (SELECT lpad(vec_id::VARCHAR, 9, '0') AS sample, label::VARCHAR AS subtype FROM embeddings)"
_QUOTA = "sz AS (SELECT subtype, count(*) AS size FROM {0} GROUP BY 1), qt AS (SELECT subtype, size, round_even(size / sum(size) OVER () * {1}, 0)::BIGINT AS q, row_number() OVER (ORDER BY size DESC, subtype) = count(*) OVER () AS last FROM sz), quota AS (SELECT subtype, size, q + CASE WHEN last THEN {1} - sum(q) OVER () ELSE 0 END AS quota FROM qt)"


@query(f"{with_views('subtype')}, {_QUOTA.format('subtype', 601)} SELECT subtype, size, quota::BIGINT AS quota FROM quota")
def subtype_quota(spark, sf_dir):
    return simulate.quotas(v.subtypes(spark, sf_dir), 601)


_SYN = f"""{_QUOTA.format('subtype', 100)}, rk AS (SELECT sample, subtype, row_number() OVER (PARTITION BY subtype ORDER BY sample) - 1 AS place FROM subtype),
    wn AS (SELECT subtype, size, unnest(range(1, quota::BIGINT + 1)) AS i FROM quota WHERE size >= 2 AND quota > 0), wp AS (SELECT *, floor({u_sql("'44'", "'anchor'", 'subtype', 'i')} * size)::BIGINT AS place FROM wn),
    syn AS (SELECT 'Sample_' || row_number() OVER (ORDER BY subtype, i) AS sim, subtype, sample AS anchor FROM wp JOIN rk USING (subtype, place))"""


@query(f"{with_views('subtype')}, {_SYN} SELECT sim, subtype, anchor FROM syn")
def synthetic_samples(spark, sf_dir):
    return simulate.synthetic_samples(v.subtypes(spark, sf_dir), 100)


@query(f"{with_views('alt', 'subtype')}, {_SYN}, fr AS (SELECT DISTINCT feature FROM alt), p AS (SELECT sim, fr.feature, CASE WHEN a.sample IS NULL THEN 0.02 ELSE 0.98 END AS p FROM syn CROSS JOIN fr LEFT JOIN alt a ON a.sample = anchor AND a.feature = fr.feature) SELECT sim, feature, ({u_sql("'44'", "'binary'", 'sim', 'feature')} < p)::INT AS value FROM p")
def simulate_mutations(spark, sf_dir):
    alts = v.alterations(spark, sf_dir)
    near = simulate.synthetic_samples(v.subtypes(spark, sf_dir), 100).select("sim", F.col("anchor").alias("neighbor"))
    return simulate.draw_binary(simulate.neighbour_shares(near, alts, alts), 44, 0.02, 0.98)


@query()
def simulate_alterations(spark, sf_dir):
    alts, states, subtypes = (scratch.stored(x(spark, sf_dir)) for x in (v.alterations, v.copies, v.subtypes))
    listed = v.fusions(spark, sf_dir)
    fusion = scratch.stored(listed.where(F.col("site1") != F.col("site2")).select("sample", F.concat("site1", F.lit("--"), "site2", F.lit("_FUSION")).alias("feature")).distinct())
    numbers = v.customers(spark, sf_dir).join(subtypes, "sample", "left_semi").select("sample", F.lit("c_acctbal").alias("feature"), F.col("c_acctbal").cast("double").alias("value"))
    one = F.lit(1)
    space = simulate.space_vectors(subtypes, mut=alts.withColumn("value", one), fusion=fusion.withColumn("value", one), cna=states, clinical=numbers)
    table = numbers.withColumn("value", F.col("value").cast("string"))
    return simulate.simulate_alterations(space, subtypes, 100, mut=alts, fusion=fusion, cna=states, clinical=table)


@query(f"{with_views('fus', 'subtype')}, {_SYN}, f AS (SELECT DISTINCT sample, site1 || '--' || site2 || '_FUSION' AS feature FROM fus WHERE site1 <> site2), p AS (SELECT sim, x.feature, (f.sample IS NOT NULL)::INT AS p FROM syn CROSS JOIN (SELECT DISTINCT feature FROM f) x LEFT JOIN f ON f.sample = anchor AND f.feature = x.feature) SELECT sim, feature, ({u_sql("'44'", "'binary'", 'sim', 'feature')} < p)::INT AS value FROM p")
def simulate_fusions(spark, sf_dir):
    fusion = v.fusions(spark, sf_dir).where(F.col("site1") != F.col("site2")).select("sample", F.concat("site1", F.lit("--"), "site2", F.lit("_FUSION")).alias("feature")).distinct()
    near = simulate.synthetic_samples(v.subtypes(spark, sf_dir), 100).select("sim", F.col("anchor").alias("neighbor"))
    return simulate.draw_binary(simulate.neighbour_shares(near, fusion, fusion), 44)


_NEAR = "near AS (SELECT sim, anchor AS neighbor FROM syn UNION ALL SELECT sim, sample FROM (SELECT sim, s.sample, row_number() OVER (PARTITION BY sim ORDER BY md5(sim || s.sample)) AS r FROM syn JOIN subtype s ON s.subtype = syn.subtype AND s.sample <> anchor) WHERE r <= 2)"


def _near(spark, sf_dir):
    from pyspark.sql import Window

    syn = simulate.synthetic_samples(v.subtypes(spark, sf_dir), 100)
    other = syn.join(v.subtypes(spark, sf_dir), "subtype").where(F.col("sample") != F.col("anchor"))
    other = other.withColumn("r", F.row_number().over(Window.partitionBy("sim").orderBy(F.md5(F.concat("sim", "sample"))))).where("r <= 2")
    return syn.select("sim", F.col("anchor").alias("neighbor")).union(other.select("sim", "sample"))


@query(f"{with_views('expr', 'subtype')}, {_SYN}, {_NEAR}, w AS (SELECT sim, neighbor, x / sum(x) OVER (PARTITION BY sim) AS w FROM (SELECT *, -ln(greatest({u_sql("'44'", "'mix'", 'sim', 'neighbor')}, 1e-12)) AS x FROM near)) SELECT sim, gene, round(exp(sum(w * ln(1 + count))) - 1, 6) AS mu FROM w JOIN expr ON neighbor = sample GROUP BY 1, 2")
def background_mix(spark, sf_dir):
    return rounded(simulate.mixed_background(_near(spark, sf_dir), v.expression(spark, sf_dir)))


@query(f"{with_views('samples', 'expr', 'cna', 'subtype')}, {_SYN}, {_NEAR}, n AS (SELECT count(*) AS n FROM subtype), pr AS (SELECT gene, coalesce(count(*) FILTER (value = 2) / nullif(count(*) FILTER (value > 0), 0), 0) AS q_up, coalesce(count(*) FILTER (value = -2) / nullif(count(*) FILTER (value < 0), 0), 0) AS q_down FROM cna GROUP BY 1), sh AS (SELECT sim, g.gene, count(*) FILTER (value > 0) / 3 AS up, count(*) FILTER (value < 0) / 3 AS down FROM near CROSS JOIN (SELECT DISTINCT gene FROM cna) g LEFT JOIN cna c ON c.sample = neighbor AND c.gene = g.gene GROUP BY 1, 2), dr AS (SELECT *, {u_sql("'44'", "'event'", 'sim', 'gene')} AS u, {u_sql("'44'", "'depth'", 'sim', 'gene')} AS x FROM sh JOIN pr USING (gene)) SELECT sim, gene, CASE WHEN u < 1 - up - down THEN 0 WHEN u < 1 - up - down + up THEN CASE WHEN x < q_up THEN 2 ELSE 1 END ELSE CASE WHEN x < q_down THEN -2 ELSE -1 END END::INT AS value FROM dr")
def simulate_states(spark, sf_dir):
    return simulate.draw_states(_near(spark, sf_dir), v.copies(spark, sf_dir), v.subtypes(spark, sf_dir))


@query(f"{with_views('subtype', 'clin')}, {_SYN}, {_NEAR.replace('md5(sim || s.sample)', 'md5(sim || s.sample)')} SELECT sim, feature, value FROM (SELECT sim, 'nation' AS feature, n_name AS value, row_number() OVER (PARTITION BY sim ORDER BY {u_sql(chr(39) + '44' + chr(39), chr(39) + 'clinical' + chr(39), 'sim', chr(39) + 'nation' + chr(39), 'neighbor')}, neighbor) AS r FROM near JOIN clin ON sample = neighbor) WHERE r = 1")
def simulate_clinical(spark, sf_dir):
    table = v.customers(spark, sf_dir).select("sample", F.lit("nation").alias("feature"), F.col("n_name").alias("value"))
    return simulate.draw_clinical(_near(spark, sf_dir), table)


# ---- signatures --------------------------------------------------------------------------------------------------


def _summary(spark, sf_dir):
    t = evaluate.effect_summary(v.truth(spark, sf_dir))
    return t.select("alt", F.col("mean_abs").alias("mean_abs_log2fc"), F.when(F.col("alt") > "Brand#3", F.col("median_abs")).alias("median_abs_log2fc"), F.col("max_abs").alias("max_abs_log2fc"))


@query(f"{with_views('truth')}, s AS (SELECT alt, avg(abs(log2fc)) AS m, CASE WHEN alt > 'Brand#3' THEN median(abs(log2fc)) END AS med, max(abs(log2fc)) AS mx FROM truth GROUP BY 1) SELECT alt, NULL::DOUBLE AS size_mean, round(ln(med), 6) AS abs_mu, round(CASE WHEN med > 0 THEN sqrt(greatest(2 * (ln(m) - ln(med)), 1e-6)) END, 6) AS abs_sigma, round(least(greatest(mx, 8 * m), 12), 6) AS abs_cap FROM s")
def alteration_params(spark, sf_dir):
    return rounded(simulate.alteration_params(_summary(spark, sf_dir)))


_SIZED = "SELECT DISTINCT feature AS alt, 12 AS size FROM alt"


@query(f"{with_views('alt', 'expr')}, sized AS ({_SIZED}) SELECT alt, gene FROM (SELECT alt, gene, row_number() OVER (PARTITION BY alt ORDER BY {u_sql(chr(39) + '44' + chr(39), chr(39) + 'target' + chr(39), 'alt', 'gene')}, gene) AS r, size FROM sized, (SELECT DISTINCT gene FROM expr) g) WHERE r <= size")
def signature_targets(spark, sf_dir):
    sized = v.alterations(spark, sf_dir).select(F.col("feature").alias("alt"), F.lit(12).alias("size")).distinct()
    return simulate.signature_targets(sized, v.expression(spark, sf_dir))


_PAIRED = "named AS (SELECT gene AS base, gene || k AS alt, k FROM (SELECT DISTINCT gene FROM brand) g, (SELECT unnest(['_GOF', '_AMP']) AS k) x)"
_DRAW = u_sql("'44'", "'target'", "alt", "gene")


@query(f"""{with_views('brand')}, {_PAIRED}, pool AS (SELECT alt, base, k, gene, gene = base AS own, CASE WHEN gene = base THEN -1.0 ELSE {_DRAW} END AS draw FROM named, (SELECT DISTINCT gene FROM brand) g),
    dflt AS (SELECT alt, gene FROM (SELECT *, row_number() OVER (PARTITION BY alt ORDER BY draw, gene) AS r FROM pool) WHERE r <= 12),
    amp AS (SELECT p.*, d.gene IS NOT NULL AS in_ref FROM pool p LEFT JOIN dflt d ON d.alt = p.base || '_GOF' AND d.gene = p.gene WHERE k = '_AMP'),
    pl AS (SELECT *, row_number() OVER (PARTITION BY alt, in_ref, own ORDER BY draw, gene) AS pr FROM amp),
    fin AS (SELECT alt, gene, row_number() OVER (PARTITION BY alt ORDER BY CASE WHEN own THEN 0 WHEN in_ref AND pr <= 8 THEN 1 ELSE 2 END, draw, gene) AS r FROM pl)
    SELECT alt, gene FROM fin WHERE r <= 12 UNION ALL SELECT alt, gene FROM dflt WHERE alt LIKE '%GOF'""")
def signature_shared_targets(spark, sf_dir):
    genes = v.brand_counts(spark, sf_dir).select("gene").distinct()
    sized = genes.select(F.explode(F.array(F.concat("gene", F.lit("_GOF")), F.concat("gene", F.lit("_AMP")))).alias("alt"), F.lit(12).alias("size"))
    return simulate.signature_targets(sized, genes)


_NORMAL = f"sqrt(-2 * ln(greatest({u_sql(chr(39) + '44' + chr(39), chr(39) + 'effect' + chr(39), 'alt', 'gene', chr(39) + 'r' + chr(39))}, 1e-12))) * cos(2 * pi() * {u_sql(chr(39) + '44' + chr(39), chr(39) + 'effect' + chr(39), 'alt', 'gene', chr(39) + 'a' + chr(39))})"


@query(f"""{with_views('alt', 'expr', 'truth')}, s AS (SELECT alt, avg(abs(log2fc)) AS m, CASE WHEN alt > 'Brand#3' THEN median(abs(log2fc)) END AS med, max(abs(log2fc)) AS mx FROM truth GROUP BY 1),
    pa AS (SELECT alt, ln(med) AS mu, CASE WHEN med > 0 THEN sqrt(greatest(2 * (ln(m) - ln(med)), 1e-6)) END AS sigma, least(greatest(mx, 8 * m), 12) AS cap, 10 + floor({u_sql("'44'", "'size'", 'alt')} * 291)::INT AS size FROM s),
    tg AS (SELECT * FROM (SELECT pa.*, gene, row_number() OVER (PARTITION BY alt ORDER BY {_DRAW}, gene) AS r FROM pa, (SELECT DISTINCT gene FROM expr) g) WHERE r <= size),
    ef AS (SELECT alt, gene, least(CASE WHEN sigma > 0 THEN exp(mu + sigma * {_NORMAL}) ELSE 1 + {u_sql("'44'", "'effect'", 'alt', 'gene')} END, cap) AS e, CASE WHEN alt LIKE '%_GOF' THEN 0.85 WHEN alt LIKE '%_LOF' THEN 0.15 ELSE 0.0 END AS share, {u_sql("'44'", "'sign'", 'alt', 'gene')} AS u FROM tg)
    SELECT alt, gene, round(CASE WHEN u < share THEN e ELSE -e END, 6) AS log2fc FROM ef""")
def signature_effects(spark, sf_dir):
    return rounded(simulate.signatures(simulate.alteration_params(_summary(spark, sf_dir)), v.expression(spark, sf_dir)))


@query(f"{with_views('alt', 'expr', 'truth')}, l AS (SELECT sample, gene, sum(log2fc) AS l FROM alt JOIN truth ON feature = alt GROUP BY 1, 2) SELECT sample, gene, round(count * pow(2, coalesce(l, 0)), 5) AS mu FROM expr LEFT JOIN l USING (sample, gene)")
def induced_effects(spark, sf_dir):
    mu = v.expression(spark, sf_dir).withColumnRenamed("count", "mu")
    return rounded(simulate.induced(mu, v.alterations(spark, sf_dir).withColumn("value", F.lit(1)), v.truth(spark, sf_dir)), 5)


@query()
def nb_counts(spark, sf_dir):
    counts, samples, _ = _rna(spark, sf_dir)
    drawn = v.truth(spark, sf_dir).select("gene").distinct()
    return simulate.nb_counts(counts.select("sample", "gene", F.col("count").cast("double").alias("mu")), simulate.moment_dispersions(counts, samples), drawn)


@query(f"{with_views('expr', 'subtype')}, {_SYN}, {_FACTORS}, rf AS (SELECT sf, row_number() OVER (ORDER BY sample) - 1 AS place FROM sf) SELECT sim, round(sf, 6) AS size_factor FROM (SELECT sim, floor({u_sql(chr(39) + '44' + chr(39), chr(39) + 'factor' + chr(39), 'sim')} * (SELECT count(*) FROM sf))::BIGINT AS place FROM syn) JOIN rf USING (place)")
def resampled_factors(spark, sf_dir):
    syn = simulate.synthetic_samples(v.subtypes(spark, sf_dir), 100)
    return rounded(simulate.resampled_factors(rna.size_factors(v.expression(spark, sf_dir)), syn))


# ---- evaluation --------------------------------------------------------------------------------------------------

_MOMENTS = f"""{_FACTORS}, u AS (SELECT sample, gene, ln(2 + count / sf) - ln(2.0) AS u FROM expr JOIN sf USING (sample)), ns AS (SELECT count(*) AS n FROM sf),
    c AS (SELECT feature AS alt, count(*) AS n1 FROM alt WHERE sample IN (SELECT sample FROM sf) GROUP BY 1), t AS (SELECT gene, sum(u) AS s, sum(u * u) AS ss FROM u GROUP BY 1),
    o AS (SELECT feature AS alt, gene, sum(u) AS s1, sum(u * u) AS ss1 FROM alt JOIN u USING (sample) GROUP BY 1, 2),
    mo AS (SELECT alt, gene, n1, n - n1 AS n0, coalesce(s1, 0) AS s1, s - coalesce(s1, 0) AS s0, coalesce(ss1, 0) AS ss1, ss - coalesce(ss1, 0) AS ss0 FROM truth JOIN c USING (alt) JOIN t USING (gene) LEFT JOIN o USING (alt, gene), ns),
    sc AS (SELECT alt, abs(s1 / n1 - s0 / n0) AS d, sqrt((CASE WHEN n1 > 1 THEN greatest((ss1 - s1 * s1 / n1) / (n1 - 1), 0) END + CASE WHEN n0 > 1 THEN greatest((ss0 - s0 * s0 / n0) / (n0 - 1), 0) END) / 2) AS p FROM mo WHERE n1 >= 1 AND n0 >= 1),
    snr AS (SELECT alt AS alteration, avg(CASE WHEN p > 1e-9 THEN d / p END) AS snr, any_value(nt) AS n_targets FROM (SELECT alt, count(*) AS nt FROM truth GROUP BY 1) LEFT JOIN sc USING (alt) GROUP BY 1)"""


@query(f"{with_views('alt', 'expr', 'truth')}, {_MOMENTS} SELECT alteration, round(snr, 6) AS snr, n_targets FROM snr")
def snr_by_alt(spark, sf_dir):
    return rounded(evaluate.snr(scratch.stored(v.alterations(spark, sf_dir)), v.expression(spark, sf_dir), scratch.stored(v.truth(spark, sf_dir))))


_OVERLAP = f"ov AS (SELECT x.alt AS alt1, y.alt AS alt2, count(*) / ({2 * v.TARGETS} - count(*)) AS j FROM truth x JOIN truth y USING (gene) WHERE x.alt <> y.alt GROUP BY 1, 2)"


@query(f"{with_views('truth')}, {_OVERLAP} SELECT alt1, alt2, round(j, 6) AS jaccard FROM ov")
def jaccard_overlap(spark, sf_dir):
    return rounded(evaluate.overlaps(v.truth(spark, sf_dir)))


@query(f"""{with_views('samples', 'alt', 'expr', 'truth')}, {_FISHER}, {_MOMENTS}, {_OVERLAP}, li AS (SELECT alt1, alt2, greatest(least(ln(odds_smooth), 6), -6) AS l FROM pairs UNION ALL SELECT alt2, alt1, greatest(least(ln(odds_smooth), 6), -6) FROM pairs),
    cf AS (SELECT alt1 AS alteration, sum(l * j) AS confound_score, count(*) AS k FROM li JOIN ov USING (alt1, alt2) GROUP BY 1)
    SELECT alteration, round(snr, 6) AS snr_base, n_targets, round(coalesce(confound_score, 0), 6) AS confound_score, coalesce(k, 0) AS n_partners_used, round(snr / (1 + coalesce(confound_score, 0)), 5) AS effective_snr FROM snr LEFT JOIN cf USING (alteration)""")
def effective_snr(spark, sf_dir):
    alts, truth = v.alterations(spark, sf_dir), v.truth(spark, sf_dir)
    pairs = cooccurrence.fisher_pairs(alts, v.samples(spark, sf_dir))
    rows = evaluate.effective_snr(evaluate.snr(alts, v.expression(spark, sf_dir), truth), evaluate.confounding(pairs, truth))
    return rounded(rows.withColumn("effective_snr", F.round("effective_snr", 5)))


_METRICS = """g AS (SELECT count(DISTINCT gene) AS n FROM expr), k AS (SELECT method, alt, count(*) AS said, count(t.gene) AS tp FROM pred LEFT JOIN (SELECT alt, gene FROM truth) t USING (alt, gene) GROUP BY 1, 2), z AS (SELECT alt, count(*) AS size FROM truth GROUP BY 1),
    b AS (SELECT m.method, z.alt, coalesce(tp, 0) AS tp, coalesce(said, 0) - coalesce(tp, 0) AS fp, size - coalesce(tp, 0) AS fn, n - coalesce(said, 0) - size + coalesce(tp, 0) AS tn, n FROM (SELECT DISTINCT method FROM pred) m CROSS JOIN z CROSS JOIN g LEFT JOIN k ON k.method = m.method AND k.alt = z.alt),
    s AS (SELECT *, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS jaccard, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM b),
    f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM s)"""


@query(f"{with_views('truth', 'pred')}, {_METRICS} SELECT method, alt, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(jaccard, 6) AS jaccard, round(mcc, 6) AS mcc, 0::BIGINT AS outside FROM f")
def signature_metrics(spark, sf_dir):
    return rounded(evaluate.signature_metrics(v.predictions(spark, sf_dir), v.truth(spark, sf_dir), v.expression(spark, sf_dir)))


@query(f"{with_views('truth', 'pred')}, {_METRICS} SELECT method, round(avg(f1), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(accuracy), 6) AS accuracy, round(avg(jaccard), 6) AS jaccard, round(avg(mcc), 6) AS mcc, count(*) AS n_signatures_evaluated FROM f GROUP BY 1")
def method_summary(spark, sf_dir):
    return rounded(evaluate.method_summary(evaluate.signature_metrics(v.predictions(spark, sf_dir), v.truth(spark, sf_dir), v.expression(spark, sf_dir))))


@query(f"{with_views('truth')} SELECT alt, count(*) AS n, round(avg(log2fc), 6) AS mean, round(avg(abs(log2fc)), 6) AS mean_abs, round(median(abs(log2fc)), 6) AS median_abs, round(max(abs(log2fc)), 6) AS max_abs, round(stddev_samp(log2fc), 6) AS sd FROM truth GROUP BY 1")
def truth_effect_summary(spark, sf_dir):
    return rounded(evaluate.effect_summary(v.truth(spark, sf_dir)))


@query()
def robustness_bundle(spark, sf_dir):
    alts, samples, truth = (scratch.stored(x(spark, sf_dir)) for x in (v.alterations, v.samples, v.truth))
    pairs = scratch.stored(cooccurrence.fisher_pairs(alts, samples))
    return rounded(evaluate.robustness(alts, samples, v.expression(spark, sf_dir), truth, pairs))


@query()
def dataset_evaluation(spark, sf_dir):
    from .workflows import evaluate_predictions

    alts, samples, truth, predictions, genes = (scratch.stored(x(spark, sf_dir)) for x in (v.alterations, v.samples, v.truth, v.predictions, v.genes))
    found = evaluate_predictions("DRIVER", alts, samples, v.expression(spark, sf_dir), truth, predictions, genes)
    return rounded(found.individual)


@query(f"""{with_views('alt', 'expr', 'truth', 'pred')}, f AS (SELECT DISTINCT feature FROM alt)
    SELECT 'DRIVER' AS dataset, (SELECT count(DISTINCT alt) FROM truth WHERE alt IN (SELECT feature FROM alt)) AS n_true_alterations, (SELECT count(*) FROM f) AS n_kept_alterations, (SELECT count(DISTINCT method) FROM pred) AS n_methods,
    (SELECT count(DISTINCT method) FROM pred) * (SELECT count(DISTINCT alt) FROM truth) AS n_scores, (SELECT count(DISTINCT gene) FROM expr) AS n_genes, (SELECT count(DISTINCT sample) FROM alt) AS raw_samples, (SELECT count(*) FROM f) AS raw_features,
    (SELECT count(DISTINCT sample) FROM alt) AS clean_samples, (SELECT count(*) FROM f) AS clean_features, 0::BIGINT AS n_robust, 'off' AS robustness""")
def evaluation_notes(spark, sf_dir):
    from .workflows import evaluate_predictions

    counts = v.expression(spark, sf_dir)
    found = evaluate_predictions("DRIVER", v.alterations(spark, sf_dir), v.samples(spark, sf_dir), counts, v.truth(spark, sf_dir), v.predictions(spark, sf_dir), counts, filter_alts=False, with_robustness=False)
    return found.diagnostics.drop("left_out", "left_out_features", "min_group", "min_residual", "filtered")


@query(f"{with_views('samples', 'alt')}, {_FISHER}, r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM (SELECT alt1, alt2, round(p, 9) AS p FROM pairs)) SELECT alt1, alt2, round(p, 6) AS pvalue, round(least(1, min(p * m / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS padj FROM r")
def bh_adjust(spark, sf_dir):
    pairs = cooccurrence.fisher_pairs(v.alterations(spark, sf_dir), v.samples(spark, sf_dir))
    return rounded(evaluate.adjusted(pairs.select("alt1", "alt2", F.round("p", 9).alias("pvalue"))))


# ---- differential expression and theory --------------------------------------------------------------------------


@query()
def wald_tests(spark, sf_dir):
    return rounded(differential.wald(v.alterations(spark, sf_dir), v.expression(spark, sf_dir)))


@query(f"""{with_views('alt', 'expr')}, {_FACTORS}, u AS (SELECT sample, gene, count / sf AS u FROM expr JOIN sf USING (sample) WHERE count > 0), n AS (SELECT count(*) AS n FROM sf),
    c AS (SELECT feature AS alt, count(*) AS n1 FROM alt JOIN sf USING (sample) GROUP BY 1), ok AS (SELECT alt, n1, n - n1 AS n0, n FROM c, n WHERE n1 >= 5 AND n - n1 >= 5), t AS (SELECT gene, sum(u) AS s, sum(u * u) AS ss FROM u GROUP BY 1),
    o AS (SELECT feature AS alt, gene, sum(u) AS s1, sum(u * u) AS ss1 FROM alt JOIN u USING (sample) GROUP BY 1, 2),
    m AS (SELECT alt, gene, n1, n0, n, coalesce(s1, 0) AS s1, s - coalesce(s1, 0) AS s0, coalesce(ss1, 0) AS ss1, ss - coalesce(ss1, 0) AS ss0 FROM ok CROSS JOIN t LEFT JOIN o USING (alt, gene)),
    w AS (SELECT *, (greatest(ss1 - s1 * s1 / n1, 0) + greatest(ss0 - s0 * s0 / n0, 0)) / (n - 2) AS within, (s1 + s0) / n AS mean FROM m),
    r AS (SELECT *, greatest((within - mean) / (mean * mean), 1e-4) AS raw FROM w), d AS (SELECT *, exp(0.5 * ln(raw) + 0.5 * avg(ln(raw)) OVER (PARTITION BY alt)) AS phi, ln((s1 + 0.5) / n1) - ln((s0 + 0.5) / n0) AS change FROM r)
    SELECT alt, gene, round(change / ln(2), 6) AS log2fc, round(change / sqrt((1 / greatest(s1 / n1, 1e-8) + phi) / n1 + (1 / greatest(s0 / n0, 1e-8) + phi) / n0), 6) AS stat FROM d WHERE s1 + s0 > 0""")
def wald_moments(spark, sf_dir):
    """The statistic; tails of the normal law have no SQL."""
    return rounded(differential.wald_by_moments(v.alterations(spark, sf_dir), v.expression(spark, sf_dir)).drop("pvalue", "padj"))


@query()
def moderated_t_tests(spark, sf_dir):
    return rounded(differential.moderated_t(v.alterations(spark, sf_dir), v.expression(spark, sf_dir)))


@query()
def moderated_t_joint(spark, sf_dir):
    return rounded(differential.moderated_t_joint(v.alterations(spark, sf_dir), v.expression(spark, sf_dir)))


@query()
def quasi_f_tests(spark, sf_dir):
    return rounded(differential.quasi_f(v.alterations(spark, sf_dir), v.expression(spark, sf_dir)))


@query()
def quasi_f_joint(spark, sf_dir):
    return rounded(differential.quasi_f_joint(v.alterations(spark, sf_dir), v.brand_counts(spark, sf_dir)))


@query(f"""{with_views('expr')}, z AS (SELECT sample, sum(count) AS size, quantile_cont(count, 0.75) / sum(count) AS q FROM expr GROUP BY 1), rf AS (SELECT sample AS ref, size AS ref_size FROM z ORDER BY abs(q - (SELECT avg(q) FROM z)), sample LIMIT 1),
    b AS (SELECT gene, count AS ref_count, ref_size FROM expr JOIN rf ON sample = ref), x AS (SELECT e.sample, log2((count / size) / (ref_count / ref_size)) AS m, log2((count / size) * (ref_count / ref_size)) / 2 AS a, (size - count) / size / count + (ref_size - ref_count) / ref_size / ref_count AS v FROM expr e JOIN b USING (gene) JOIN z USING (sample)),
    k AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n, rank() OVER (PARTITION BY sample ORDER BY m) AS rm, rank() OVER (PARTITION BY sample ORDER BY a) AS ra FROM x),
    w AS (SELECT sample, pow(2, sum(m / v) / sum(1 / v)) AS raw FROM k WHERE v > 0 AND rm >= floor(n * 0.3) + 1 AND rm <= n - floor(n * 0.3) AND ra >= floor(n * 0.05) + 1 AND ra <= n - floor(n * 0.05) GROUP BY 1),
    f AS (SELECT sample, size, coalesce(raw, 1) AS raw FROM z LEFT JOIN w USING (sample)) SELECT sample, round(raw / (SELECT exp(avg(ln(raw))) FROM f), 6) AS factor, size::BIGINT AS size FROM f""")
def tmm_factors(spark, sf_dir):
    return rounded(differential.tmm_factors(v.expression(spark, sf_dir)))


@query("SELECT region, round(ln((n1 * 0.8 * m1 + n0 * 0.2 * m0) / (n1 * 0.8 + n0 * 0.2)) - ln((n1 * 0.2 * m1 + n0 * 0.8 * m0) / (n1 * 0.2 + n0 * 0.8)), 6) AS c1 FROM (SELECT r_name AS region, r_regionkey * 100 + 100 AS n1, 500 AS n0, 100 * exp(1) AS m1, 100 AS m0 FROM region)")
def theory_c1_by_region(spark, sf_dir):
    from math import e

    rows = [(r["r_name"], theory_c1(100 * e, 100.0, r["r_regionkey"] * 100 + 100, 500, 0.8, 0.2)) for r in _table(spark, sf_dir, "region").collect()]
    return rounded(spark.createDataFrame(rows, "region string, c1 double"))


@query(f"{with_views('alt', 'expr')}, y AS (SELECT sample, sum(count) AS y FROM expr GROUP BY 1) SELECT a.feature AS alt, round(ln(avg(y) FILTER (x.sample IS NOT NULL)) - ln(avg(y) FILTER (x.sample IS NULL)), 6) AS slope FROM (SELECT DISTINCT feature FROM alt) a CROSS JOIN y LEFT JOIN alt x ON x.feature = a.feature AND x.sample = y.sample GROUP BY 1")
def nb_single_slope(spark, sf_dir):
    y = v.expression(spark, sf_dir).groupBy("sample").agg(F.sum("count").cast("double").alias("y"))
    return rounded(theory.slopes_by_alteration(v.alterations(spark, sf_dir), y))


@query()
def theory_replicates(spark, sf_dir):
    return rounded(theory.replicates(spark))


# ---- models ------------------------------------------------------------------------------------------------------


def _cells(spark, sf_dir):
    return evaluate._cells(v.expression(spark, sf_dir), 1.0)


@query(f"{with_views('samples', 'alt', 'expr')}, {_FACTORS}, u AS (SELECT sample, gene, ln(2 + count / sf) - ln(2.0) AS u FROM expr JOIN sf USING (sample)), n AS (SELECT count(*) AS n FROM samples), c AS (SELECT feature AS alt, count(*) AS n1 FROM alt GROUP BY 1), t AS (SELECT gene, sum(u) AS s FROM u GROUP BY 1), o AS (SELECT feature AS alt, gene, sum(u) AS s1 FROM alt JOIN u USING (sample) GROUP BY 1, 2) SELECT gene, alt, round((coalesce(s1, 0) - n1 * s / n) / (n1 - n1 * n1 / n + 1), 6) AS weight FROM c CROSS JOIN t LEFT JOIN o USING (alt, gene), n")
def ridge_single(spark, sf_dir):
    return rounded(linear.ridge_single(v.alterations(spark, sf_dir), _cells(spark, sf_dir), v.samples(spark, sf_dir)))


@query()
def lasso_weights(spark, sf_dir):
    return rounded(linear.penalised(v.alterations(spark, sf_dir), _cells(spark, sf_dir), v.samples(spark, sf_dir)))


@query()
def elastic_net_weights(spark, sf_dir):
    return rounded(linear.penalised(v.alterations(spark, sf_dir), _cells(spark, sf_dir), v.samples(spark, sf_dir), l1_ratios=(0.5,)))


@query()
def lasso_signatures(spark, sf_dir):
    w = linear.penalised(v.alterations(spark, sf_dir), _cells(spark, sf_dir), v.samples(spark, sf_dir))
    return rounded(linear.signature_of(w, "nonzero"))


@query()
def stability_ridge(spark, sf_dir):
    return rounded(linear.ridge_stability(v.alterations(spark, sf_dir), _cells(spark, sf_dir), v.samples(spark, sf_dir)))


@query()
def svr_stability(spark, sf_dir):
    return rounded(linear.svr_stability(v.alterations(spark, sf_dir), _cells(spark, sf_dir), v.samples(spark, sf_dir)))


@query()
def rf_stability(spark, sf_dir):
    return rounded(linear.forest_stability(v.alterations(spark, sf_dir), _cells(spark, sf_dir), v.samples(spark, sf_dir)))


@query()
def ppca_latent(spark, sf_dir):
    alts, samples = v.alterations(spark, sf_dir), v.samples(spark, sf_dir)
    cov, means, names, _ = deconfounder.covariance(alts, samples)
    return rounded(deconfounder.scores(alts, samples, deconfounder.ppca(cov, means, names, 3)))


@query(f"{with_views('samples', 'alt')} SELECT sample, feature FROM samples, (SELECT DISTINCT feature FROM alt) f WHERE {u_sql(chr(39) + '44' + chr(39), chr(39) + 'holdout' + chr(39), 'sample', 'feature')} < 0.2")
def ppca_holdout(spark, sf_dir):
    return deconfounder.holdout(v.samples(spark, sf_dir), v.alterations(spark, sf_dir))


@query()
def deconfounder_weights(spark, sf_dir):
    return rounded(deconfounder.deconfounded(v.alterations(spark, sf_dir), _cells(spark, sf_dir), v.samples(spark, sf_dir)))
