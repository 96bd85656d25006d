"""Registered queries of the upkeep operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import export, size
from tessera.operators import upkeep
from tessera.plans.queries import CONSOLIDATED, _consolidated, query
from tessera.plans.tables import ctes, derived, read

SITES = """WITH s AS (SELECT o_custkey AS company_id, CASE WHEN o_orderkey % 2 = 0 THEN 'sede_operativa' ELSE 'domicilio_social' END AS kind, o_orderkey AS seq,
  CASE WHEN o_orderkey % 3 <> 0 THEN concat('Calle ', CAST(o_orderkey % 7 AS STRING)) END AS address, CASE WHEN o_orderkey % 5 <> 0 THEN concat('muni', CAST(o_orderkey % 50 AS STRING)) END AS municipality,
  o_totalprice AS confidence FROM orders)
"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SITES.replace("FROM orders", "FROM {orders}") + "SELECT * FROM s", orders=read(spark, sf_dir, "orders"))


@query(
    SITES
    + """SELECT company_id, kind, arg_max(address, seq) FILTER (address IS NOT NULL) AS address, arg_max(municipality, seq) FILTER (municipality IS NOT NULL) AS municipality,
  arg_max(confidence, seq) AS confidence FROM s GROUP BY 1, 2"""
)
def latest_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.latest_sites(_sites(spark, sf_dir), ["address", "municipality", "confidence"])


@query(
    SITES
    + """SELECT company_id, kind, seq, before, address AS after FROM (SELECT *, lag(address) OVER (PARTITION BY company_id, kind ORDER BY seq) AS before FROM s WHERE address IS NOT NULL)
WHERE before <> address"""
)
def address_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.address_changes(_sites(spark, sf_dir))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS code FROM customer")
def place_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations play municipalities and regions provinces; a fifth of the sites names none that is known."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    catalogue = nation.select(F.col("n_name").alias("name"), F.col("r_name").alias("province"), F.col("n_nationkey").alias("code"))
    named = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    written = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" ¡"), F.lower("n_name"), F.lit("! "))).otherwise("nowhere")
    return upkeep.with_place_codes(named.select("c_custkey", written.alias("municipality"), F.col("r_name").alias("province")), catalogue).select("c_custkey", "code")


@query(
    """SELECT p_partkey AS entity, 'web' AS field, concat_ws('|', least(p_brand, p_type), greatest(p_brand, p_type)) AS found_values,
  CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'held' WHEN p_partkey % 3 = 0 THEN 'generic' ELSE 'detail' END AS reason FROM part WHERE p_partkey % 10 <> 5"""
)
def conflict_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the conflicts are held; a tenth was decided with the same values, another tenth again with others."""
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part").select(k.alias("entity"), F.lit("web").alias("field"), "p_brand", "p_type")
    e = F.col("entity")
    found = part.select("entity", "field", F.array("p_brand", "p_type").alias("values"), F.when(e % 3 == 0, "generic").otherwise("detail").alias("reason"))
    held = part.where(e % 2 == 0).select("entity", "field", F.array(F.lit("old")).alias("values"), F.lit("held").alias("reason"))
    same = part.where(e % 5 == 0).select("entity", "field", F.array("p_type", "p_brand").alias("values"), F.lit(1).alias("decided_at"))
    later = part.where(e % 10 == 0).select("entity", "field", F.array(F.lit("other")).alias("values"), F.lit(2).alias("decided_at"))
    out = upkeep.upsert_conflicts(held, found, same.unionByName(later), "generic")
    return out.select("entity", "field", F.array_join(F.array_sort("values"), "|").alias("found_values"), "reason")


@query(
    """SELECT c_custkey AS company_id, CASE WHEN free AND failing THEN 'descartado' WHEN free AND v IS NULL THEN 'dudoso' ELSE v END AS verdict,
  CASE WHEN free AND failing THEN 'size' END AS reason FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'aceptado' WHEN 1 THEN 'relevante' WHEN 2 THEN 'descartado' END AS v,
  c_custkey % 4 <> 0 AND c_custkey % 5 NOT IN (0, 2) AS free, c_custkey % 7 <> 0 AND c_custkey % 60 > 20 AS failing FROM customer)"""
)
def verdict_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose known size is outside the asked range; reviewed and settled ones stay."""
    k = F.col("c_custkey")
    verdict = F.when(k % 5 == 0, "aceptado").when(k % 5 == 1, "relevante").when(k % 5 == 2, "descartado")
    known = F.when(k % 7 != 0, k % 60)
    rows = read(spark, sf_dir, "customer").select(k.alias("company_id"), verdict.alias("verdict"), (k % 4 == 0).alias("reviewed"), known.alias("n"))
    outside = F.when(size.size_fit(F.col("n"), F.col("n"), None, 20) == "outside", "size")
    return upkeep.swept(rows, outside, unseen="dudoso").select("company_id", "verdict", "reason")


@query(
    """WITH s AS (SELECT o_custkey AS search_id, o_orderkey AS candidate_id, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS score FROM orders)
SELECT search_id, candidate_id, CASE WHEN score >= 0.8 THEN 'relevante' WHEN score >= 0.6 AND row_number() OVER (PARTITION BY search_id, score >= 0.6 AND score < 0.8 ORDER BY score DESC, candidate_id) <= 3
  THEN 'dudoso' ELSE 'descartado' END AS verdict FROM s"""
)
def ranked_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.col("o_orderkey") % 101).cast("double") / 100
    return upkeep.ranked_verdicts(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("search_id"), F.col("o_orderkey").alias("candidate_id"), score.alias("score")))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS person, l_suppkey % 3 AS sheet FROM lineitem)
SELECT l_orderkey, l_linenumber, person, n_distinct FROM r JOIN (SELECT person, count(DISTINCT sheet) AS n_distinct FROM r GROUP BY 1) USING (person) WHERE n_distinct > 1"""
)
def shared_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of more than one registry sheet, with all their rows."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("person"), (F.col("l_suppkey") % 3).alias("sheet"))
    return upkeep.groups_by(rows, "person", "sheet").select("l_orderkey", "l_linenumber", "person", "n_distinct")


@query(
    """WITH e AS (SELECT l_suppkey AS company_id, l_returnflag AS kind, l_partkey AS value, bool_and(l_linenumber % 2 = 1) AS only_web FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT DISTINCT l_suppkey AS company_id, l_returnflag AS kind, l_partkey AS value FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT company_id, kind, value FROM e WHERE only_web AND NOT EXISTS (SELECT 1 FROM r WHERE r.company_id = e.company_id AND r.kind = e.kind AND r.value = e.value)
  AND EXISTS (SELECT 1 FROM r WHERE r.company_id = e.company_id AND r.kind = e.kind)"""
)
def retired_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("l_linenumber") % 2 == 1, "web").otherwise("maps")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company_id"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("value"), source.alias("source"), "l_orderkey")
    return upkeep.retired_channels(rows, rows.where("l_orderkey % 3 = 0"))


@query("SELECT o_orderkey AS company_id, o_orderstatus AS before, 'F' AS after FROM orders WHERE o_orderkey % 4 = 1 AND o_orderstatus <> 'F'")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("company_id"), F.col("o_orderstatus").alias("state"))
    found = held.where("company_id % 4 < 2").select("company_id", F.when(F.col("company_id") % 4 == 1, "F").alias("state"))
    return upkeep.state_changes(held, found)


@query(
    ctes("observations")
    + """SELECT entity, field, value, array_to_string(list_sort(list(DISTINCT source_group)), ',') AS sources,
  array_to_string(list(original ORDER BY observed_at, original)[1:3], ',') AS originals FROM observations GROUP BY 1, 2, 3"""
)
def value_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = upkeep.value_details(derived(spark, sf_dir, "observations"))
    return found.select("entity", "field", "value", F.array_join("sources", ",").alias("sources"), F.array_join("originals", ",").alias("originals"))


@query(
    CONSOLIDATED
    + """SELECT entity, max(value) FILTER (field = 'web') AS web, max(value) FILTER (field = 'razon_social') AS razon_social, count(*) AS n_fields
FROM consolidated WHERE rank = 1 GROUP BY 1"""
)
def golden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best value of every field of an entity in one row."""
    return upkeep.golden_rows(_consolidated(spark, sf_dir)[0], ["web", "razon_social"])


@query(
    """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-20', INTERVAL 1 DAY)) AS DATE) AS day),
c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (day) WHERE coalesce(n, 0) > 0 OR DATE '2024-02-20' - day >= 7"""
)
def loaded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-20").cast("date"))).alias("day"))
    acts = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    return upkeep.loaded_days(days, acts, F.lit("2024-02-20").cast("date")).select(F.col("day").cast("string").alias("day"), "n")


@query("SELECT s_suppkey AS a, s_suppkey + 1 AS b, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey + 1 <= (SELECT max(s_suppkey) FROM supplier) THEN 'merge' WHEN s_suppkey % 3 = 0 THEN 'reject' ELSE 'keep' END AS action FROM supplier")
def rule_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring suppliers as open pairs; an even one shares its sheet with the next."""
    k = F.col("s_suppkey")
    supplier = read(spark, sf_dir, "supplier")
    pairs = supplier.select(k.alias("a"), (k + 1).alias("b"), F.when(k % 3 == 0, "R7").otherwise("sum").alias("rule"))
    letter = F.when(k % 2 == 0, "se").otherwise("SE")
    return upkeep.resolved_by_rule(pairs, supplier.select(k.alias("company_id"), F.concat(letter, F.floor(k / 2).cast("string")).alias("sheet")))


@query(
    """SELECT DISTINCT 'old' AS from_version, p_brand AS source_code, p_type AS target_code FROM part
UNION SELECT DISTINCT 'new', p_type, p_brand FROM part"""
)
def code_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.correspondence(read(spark, sf_dir, "part"), "p_brand", "p_type")


@query(
    ctes("companies", "channels")
    + """, u AS (SELECT *, regexp_replace(value, '\\D', '', 'g') AS d FROM channels WHERE state IS DISTINCT FROM 'invalid'),
n AS (SELECT *, CASE WHEN length(d) = 11 AND d LIKE '34%' THEN substr(d, 3) WHEN length(d) = 9 THEN d ELSE value END AS nat FROM u),
p AS (SELECT company_id, nat, row_number() OVER (PARTITION BY company_id ORDER BY c, v) AS nth, mobile FROM (
  SELECT company_id, nat, max(coalesce(confidence, -1)) AS c0, arg_min(value, (-coalesce(confidence, -1), value)) AS v, -max(coalesce(confidence, -1)) AS c, regexp_full_match(nat, '[67].{8}') AS mobile FROM n WHERE kind = 'phone' GROUP BY company_id, nat)),
m AS (SELECT company_id, nat, row_number() OVER (PARTITION BY company_id ORDER BY nth) AS i FROM p WHERE mobile),
o AS (SELECT company_id, nat, row_number() OVER (PARTITION BY company_id ORDER BY nth) AS i FROM p WHERE NOT mobile),
e AS (SELECT company_id, value, generic, row_number() OVER (PARTITION BY company_id ORDER BY generic, c DESC, value) AS i FROM (
  SELECT company_id, value, generic, max(coalesce(confidence, -1)) AS c FROM n WHERE kind = 'email' GROUP BY 1, 2, 3)),
f AS (SELECT company_id, value FROM e WHERE i = 1),
g AS (SELECT e.company_id, e.value, row_number() OVER (PARTITION BY e.company_id ORDER BY e.generic DESC, e.i) AS i FROM e JOIN f ON f.company_id = e.company_id WHERE e.value <> f.value)
SELECT c.company_id, upper(coalesce(name, trade_name, '')) AS name, coalesce(nif, '') AS nif, coalesce('www.' || domain, '') AS web, coalesce(m1.nat, '') AS phone_1,
  coalesce(o1.nat, m2.nat, '') AS phone_2, coalesce(f.value, '') AS email, coalesce(g.value, '') AS corporate_email, coalesce(purpose, '') AS activity
FROM companies c LEFT JOIN m m1 ON m1.company_id = c.company_id AND m1.i = 1 LEFT JOIN m m2 ON m2.company_id = c.company_id AND m2.i = 2
LEFT JOIN o o1 ON o1.company_id = c.company_id AND o1.i = 1 LEFT JOIN f ON f.company_id = c.company_id LEFT JOIN g ON g.company_id = c.company_id AND g.i = 1
WHERE merged_into IS NULL"""
)
def export_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.export_cards(derived(spark, sf_dir, "companies"), derived(spark, sf_dir, "channels"))


@query()
def export_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards as XML; SQL has no XML writer."""
    return upkeep.card_xml(export_cards(spark, sf_dir))


@query(
    """WITH c AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ', "x"' WHEN 1 THEN '' ELSE chr(10) END AS a, p_brand, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS z FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(a, '[",\\n]') THEN '"' || replace(a, '"', '""') || '"' ELSE a END || ',' || p_brand || ',' || coalesce(CAST(z AS VARCHAR), '') AS line FROM c"""
)
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    a = F.concat("p_name", F.when(k % 3 == 0, ', "x"').when(k % 3 == 1, "").otherwise("\n"))
    return read(spark, sf_dir, "part").select("p_partkey", export.csv_line(a, F.col("p_brand"), F.when(k % 4 != 0, F.col("p_size"))).alias("line"))


@query(
    """WITH p AS (SELECT p_partkey, lpad(CAST(p_partkey % 9000 + 500 AS VARCHAR), 4, '0') AS c FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 OR c = '1111' THEN c END AS main, CASE p_partkey % 4 WHEN 0 THEN '9901,9902' ELSE '' END AS others FROM p"""
)
def explicit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    c = F.lpad((k % 9000 + 500).cast("string"), 4, "0")
    dotted = F.concat(F.substring(c, 1, 2), F.lit("."), F.substring(c, 3, 2), F.lit(" /"))
    purpose = (
        F.when(k % 4 == 0, F.concat(F.lit("Actividad principal: "), dotted, F.lit(" obras. Otras actividades: 99.01 / a, CNAE 9902, "), dotted, F.lit(" b")))
        .when(k % 4 == 1, F.concat(F.lit("Obras. CNAE: "), c))
        .when(k % 4 == 2, F.concat(F.lit("Venta, "), dotted, F.lit(" y cnae "), c))
        .otherwise(F.concat(F.lit("Obras CNAE 1111 o "), dotted))
    )
    return read(spark, sf_dir, "part").select("p_partkey", export.explicit_codes(purpose).alias("x")).select("p_partkey", "x.main", F.array_join("x.others", ",").alias("others"))
