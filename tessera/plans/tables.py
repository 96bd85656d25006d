"""Company tables derived from the driver's tables, in Spark and, word for word, in SQL.

The driver has no companies: customers play companies, orders their contact
channels and roles, suppliers' lines their conflicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Both engines run these texts.
DERIVED = {
    "companies": (
        "customer",
        """SELECT c_custkey AS company_id,
               CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name,
               CASE WHEN c_custkey % 5 <> 0 THEN concat('Tienda ', c_name) END AS trade_name,
               CASE WHEN c_custkey % 3 <> 0 THEN concat('N', CAST(c_custkey AS STRING)) END AS nif,
               c_custkey % 4 = 0 AS nif_valid,
               CASE WHEN c_acctbal >= 0 THEN c_acctbal / 10000 END AS confidence,
               CASE WHEN c_custkey % 4 <> 0 THEN concat('web', CAST(c_custkey % 200 AS STRING), '.es') END AS domain,
               c_custkey % 6 = 0 AS natural_person,
               CASE WHEN c_custkey % 11 = 0 THEN CAST(1 AS BIGINT) END AS merged_into,
               CASE c_custkey % 5 WHEN 0 THEN 'activa' WHEN 1 THEN 'probablemente_activa' WHEN 2 THEN 'dudosa' WHEN 3 THEN 'disuelta' ELSE 'inactiva' END AS state,
               CASE WHEN c_custkey % 3 = 0 THEN 'SL' WHEN c_custkey % 3 = 1 THEN 'SA' END AS form,
               CASE WHEN c_custkey % 8 <> 0 THEN CAST(4100 + c_custkey % 40 AS STRING) END AS code,
               CASE WHEN c_custkey % 9 <> 0 THEN concat('Reformas y construcción ', c_mktsegment) END AS purpose,
               CASE WHEN c_custkey % 4 <> 1 THEN CAST(c_custkey % 60 AS INT) END AS size_lo,
               CASE WHEN c_custkey % 4 <> 2 THEN CAST(c_custkey % 60 + 20 AS INT) END AS size_hi,
               c_mktsegment AS segment, c_nationkey AS nation
        FROM customer""",
    ),
    "channels": (
        "orders",
        """SELECT o_custkey AS company_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'phone' ELSE 'email' END AS kind,
               CASE WHEN o_orderkey % 2 = 0 THEN concat(CASE WHEN o_orderkey % 3 = 0 THEN '+34' ELSE '+33' END, CAST(600000000 + o_orderkey % 9973 AS STRING))
                    ELSE concat('mail', CAST(o_orderkey % 500 AS STRING), '@x.es') END AS value,
               CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice END AS confidence,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'invalid' ELSE 'valid' END AS state,
               o_orderkey % 4 = 1 AS generic
        FROM orders""",
    ),
    "roles": (
        "orders",
        """SELECT o_custkey AS company_id, concat('persona ', CAST(o_orderkey AS STRING)) AS person,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'presidente' WHEN '2' THEN 'administrador_unico' WHEN '3' THEN 'Directora de arte'
                    WHEN '4' THEN 'Contacto' ELSE 'Vendedor' END AS role,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 5 <> 1 END AS current,
               o_orderdate AS seen_at
        FROM orders""",
    ),
    "conflicts": (
        "lineitem",
        """SELECT l_suppkey AS company_id, CASE WHEN l_returnflag = 'R' THEN 'sin_contrastar' ELSE 'resuelto_con_evidencia' END AS kind,
               CASE WHEN l_linestatus = 'O' THEN 'pendiente' ELSE 'cerrado' END AS state
        FROM lineitem""",
    ),
    "results": (
        "customer",
        """SELECT c_custkey AS company_id, CASE c_custkey % 10 WHEN 0 THEN 'descartado' WHEN 1 THEN 'rechazado' WHEN 2 THEN NULL ELSE 'relevante' END AS verdict
        FROM customer""",
    ),
    "sites": (
        "orders",
        """SELECT o_custkey AS company_id, o_orderkey AS site_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'sede_operativa' WHEN 1 THEN 'domicilio_social' ELSE 'otra' END AS kind,
               concat('muni', CAST(o_orderkey % 50 AS STRING)) AS municipality, concat('prov', CAST(o_orderkey % 12 AS STRING)) AS province,
               lpad(CAST(o_orderkey % 52000 AS STRING), 5, '0') AS postal_code, concat('reg', CAST(o_orderkey % 5 AS STRING)) AS region,
               o_totalprice AS confidence, o_orderkey % 7 <> 0 AS active
        FROM orders""",
    ),
    "observations": (
        "events",
        """SELECT CAST(user_id AS STRING) AS entity, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'razon_social' END AS field, event_type AS value,
               concat('g', CAST(event_id % 4 AS STRING)) AS source_group, (event_id % 9) / 10.0 AS confidence, ts AS observed_at,
               event_id % 37 = 0 AS official, concat(event_type, ' ', CAST(event_id AS STRING)) AS original
        FROM events""",
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = DERIVED[name]
    return spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=read(spark, sf_dir, source))


def ctes(*names: str) -> str:
    """The derived tables as SQL common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n][1]})" for n in names)
