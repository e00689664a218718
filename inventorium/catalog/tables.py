"""Inventories, assignments, plans and logs derived from the star schema, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INVENTORY = """
WITH ship AS (SELECT l_orderkey, MAX(l_shipdate) AS d FROM {lineitem} GROUP BY l_orderkey),
area AS (SELECT n_nationkey, n_name, r_regionkey, CAST(r_regionkey + 1 AS STRING) || '_' || r_name AS rp FROM {nation} JOIN {region} ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, rp || '/' || n_name || '/' || c_name AS p, c_name, n_nationkey FROM {customer} JOIN area ON c_nationkey = n_nationkey),
ord AS (SELECT o_orderkey AS k, o_custkey, o_orderdate, o_orderpriority, o_orderstatus,
        CASE WHEN o_orderkey % 7 = 0 THEN 'Rapport_' || CAST(o_orderkey % 500 AS STRING) ELSE 'Order_' || CAST(o_orderkey AS STRING) END AS stem FROM {orders})
SELECT '1' AS id, '' AS parent_id, '.' AS path, 'RecordGrp' AS level, 'Fonds' AS title, '' AS start_date, '' AS end_date, '' AS fingerprint, CAST(0 AS BIGINT) AS pos
UNION ALL SELECT CAST(10 + r_regionkey AS STRING), '1', CAST(r_regionkey + 1 AS STRING) || '_' || r_name, 'RecordGrp', r_name, '', '', '', CAST(10 + r_regionkey AS BIGINT) FROM {region}
UNION ALL SELECT CAST(100 + n_nationkey AS STRING), CAST(10 + r_regionkey AS STRING), rp || '/' || n_name, 'RecordGrp', n_name, '', '', '', CAST(100 + n_nationkey AS BIGINT) FROM area
UNION ALL SELECT CAST(1000 + c_custkey AS STRING), CAST(100 + n_nationkey AS STRING), p, 'RecordGrp', c_name, '', '', '', CAST(1000 + c_custkey AS BIGINT) FROM cust
UNION ALL SELECT CAST(50000000 + s_suppkey AS STRING), CAST(100 + n_nationkey AS STRING), rp || '/' || n_name || '/' || s_name, 'RecordGrp', '', '', '', '', CAST(50000000 + s_suppkey AS BIGINT) FROM {supplier} JOIN area ON s_nationkey = n_nationkey
UNION ALL SELECT CAST(10000000 + k AS STRING), CAST(1000 + o_custkey AS STRING),
  p || '/' || CASE k % 12 WHEN 0 THEN stem || '.pdf' WHEN 1 THEN stem || '.docx' WHEN 2 THEN stem || '.doc' WHEN 3 THEN stem || '.XLSX' WHEN 4 THEN stem || '.xls' WHEN 5 THEN stem || '.jpg'
    WHEN 6 THEN stem || '.zip' WHEN 7 THEN stem || '.tmp' WHEN 8 THEN stem || '.msg' WHEN 9 THEN stem WHEN 10 THEN 'Thumbs.db' ELSE '~$' || stem || '.docx' END,
  'Item', CASE WHEN k % 5 = 0 THEN 'Événement ' ELSE 'Dossier ' END || o_orderpriority, CASE WHEN k % 50 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END,
  COALESCE(CAST(CAST(d AS DATE) AS STRING), ''), CASE WHEN k % 4 = 0 THEN '' ELSE md5(o_orderpriority || o_orderstatus || CAST(k % 3000 AS STRING)) END, CAST(10000000 + k AS BIGINT)
FROM ord JOIN cust ON o_custkey = c_custkey LEFT JOIN ship ON l_orderkey = k
"""

PLAN = """
WITH f AS (
  SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END || '_STATUT_' || o_orderstatus AS folder, CAST(NULL AS STRING) AS parent, 'Statut ' || o_orderstatus AS title FROM {orders}
  UNION ALL SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END || '-' || SUBSTR(o_orderpriority, 1, 1) || '_' || REPLACE(SUBSTR(o_orderpriority, 3), ' ', '_'),
    CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END || '_STATUT_' || o_orderstatus, 'Priorité ' || LOWER(SUBSTR(o_orderpriority, 3)) FROM {orders}
  UNION ALL SELECT '9_VIDE', CAST(NULL AS STRING), '' FROM (SELECT MIN(o_orderkey) AS k FROM {orders}) AS one)
SELECT 'plan' AS plan_id, CAST(ROW_NUMBER() OVER (ORDER BY folder) AS BIGINT) AS pos, folder, parent, title FROM f
"""

ASSIGNMENTS = """
WITH o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END || '-' || SUBSTR(o_orderpriority, 1, 1) || '_' || REPLACE(SUBSTR(o_orderpriority, 3), ' ', '_') AS folder FROM {orders}),
i AS (SELECT path, title, k, folder FROM {inventory} JOIN o ON CAST(id AS BIGINT) = 10000000 + k WHERE level = 'Item')
SELECT CASE WHEN k % 73 = 0 THEN path || '_inconnu' ELSE path END AS path,
  CASE WHEN k % 83 = 0 THEN 'scan_' || CAST(k AS STRING) || '.pdf' WHEN k % 79 = 0 THEN 'Hors_plan' WHEN k % 67 = 0 THEN '' WHEN k % 61 = 0 THEN SUBSTR(folder, 1, 1) || '_STATUT_X/' || folder
    WHEN k % 59 = 0 THEN folder || '/Nouveau sujet ' || CAST(k % 3 AS STRING) ELSE folder END AS target,
  CASE WHEN k % 89 = 0 THEN title || '.odt' ELSE title END AS new_title, CAST(2 * k AS BIGINT) AS apos
FROM i WHERE k % 97 <> 0
UNION ALL SELECT path, '9_VIDE', title, CAST(2 * k + 1 AS BIGINT) FROM i WHERE k % 71 = 0 AND k % 97 <> 0
"""

PLAN_TEXTS = """
SELECT 'plan_' || CAST(o_custkey AS STRING) AS plan_id, REPLACE(SUBSTR(o_orderpriority, 3), ' ', '') AS segment, COUNT(*) AS n FROM {orders} GROUP BY o_custkey, o_orderpriority
"""

_SOURCES = ("region", "nation", "customer", "supplier", "orders", "lineitem")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    used = {n: source(spark, sf_dir, n) for n in _SOURCES if f"{{{n}}}" in sql}
    return spark.sql(sql, **used, **more)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, INVENTORY)


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, PLAN)


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, ASSIGNMENTS, inventory=inventory(spark, sf_dir))


def oracle(sql: str) -> str:
    """SQL over inventory, plan and assignments for DuckDB."""
    plain = {n: n for n in (*_SOURCES, "inventory")}
    out = []
    for name, text in (("inventory", INVENTORY), ("plan", PLAN), ("assignments", ASSIGNMENTS)):
        if name in sql or name == "inventory" and "assignments" in sql:
            for key, value in plain.items():
                text = text.replace(f"{{{key}}}", value)
            out.append(f"{name} AS ({text})")
    sql = sql.strip()
    if not out:
        return sql
    rest = sql[4:].lstrip()
    begin = "WITH RECURSIVE" if rest.upper().startswith("RECURSIVE ") else "WITH"
    return f"{begin} {', '.join(out)}{', ' + rest.removeprefix('RECURSIVE ') if sql.upper().startswith('WITH') else ' ' + sql}"
