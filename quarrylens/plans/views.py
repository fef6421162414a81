"""The tables of the test data seen as a code graph (thin views; the operators know only the graph).

files: parts, suppliers and customers are source files, nations documents, regions configuration.
imports: parts and suppliers import each other along some line items; customers form chains and rings of five.
symbols: orders, in the file of their customer; some are nested in the order before. calls: between the orders of a
customer, and from a customer's file to orders of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DECORATOR, CodeGraph

PART = "'src/b' || substr(p_brand, 7) || '/' || CASE WHEN p_partkey % 17 = 0 THEN 'tests/' ELSE '' END || 'part' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' WHEN 3 THEN '.py' ELSE '.go' END"
PART_LANGUAGE = "CASE p_partkey % 5 WHEN 0 THEN 'typescript' WHEN 1 THEN 'tsx' WHEN 2 THEN 'javascript' WHEN 3 THEN 'python' ELSE 'go' END"
SUPPLIER = "'crates/n' || s_nationkey || '/src/s' || s_suppkey || '.rs'"
CUSTOMER = "'lib/n' || c_nationkey || '/c' || c_custkey || '.py'"
NAME = "CASE o_orderkey % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'load' WHEN 2 THEN 'save' ELSE 'find' END || CASE o_orderkey % 3 WHEN 0 THEN 'User' WHEN 1 THEN 'Order' ELSE 'Index' END || CASE WHEN o_orderkey % 5 = 0 THEN '_' ELSE '' END || (o_orderkey % 97)"
KIND = "CASE o_orderkey % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'trait' WHEN 3 THEN 'method' WHEN 4 THEN 'enum' ELSE 'interface' END"
VISIBILITY = "CASE o_orderkey % 3 WHEN 0 THEN 'pub' WHEN 1 THEN 'pub(crate)' ELSE 'private' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    t = lambda n: table(spark, sf_dir, n)
    parts = t("part").selectExpr("p_partkey", "p_type", "p_size", f"{PART} AS path", f"{PART_LANGUAGE} AS language")
    suppliers = t("supplier").selectExpr("s_suppkey", "s_nationkey", f"{SUPPLIER} AS path")
    customers = t("customer").selectExpr("c_custkey", f"{CUSTOMER} AS path")
    none = "cast(NULL AS string) AS crate_name"
    files = (
        parts.selectExpr("path", "language", none, "'Source' AS kind", "cast(p_size AS long) AS n_lines")
        .unionByName(suppliers.selectExpr("path", "'rust' AS language", "'n' || s_nationkey AS crate_name", "'Source' AS kind", "cast(10 AS long) AS n_lines"))
        .unionByName(customers.selectExpr("path", "'python' AS language", none, "'Source' AS kind", "cast(20 AS long) AS n_lines"))
        .unionByName(t("nation").selectExpr("'docs/n' || n_nationkey || '.md' AS path", "cast(NULL AS string) AS language", none, "'Doc' AS kind", "cast(1 AS long) AS n_lines"))
        .unionByName(t("region").selectExpr("'r' || r_regionkey || '.toml' AS path", "cast(NULL AS string) AS language", none, "'Config' AS kind", "cast(2 AS long) AS n_lines"))
    )
    items = t("lineitem").where("l_returnflag = 'N' AND l_quantity >= 45 OR l_returnflag = 'R' AND l_quantity >= 40").select("l_partkey", "l_suppkey", "l_returnflag").distinct()
    ends = items.join(parts.selectExpr("p_partkey AS l_partkey", "path AS p"), "l_partkey").join(suppliers.selectExpr("s_suppkey AS l_suppkey", "path AS s"), "l_suppkey")
    both = ends.selectExpr("if(l_returnflag = 'N', p, s) AS src", "if(l_returnflag = 'N', s, p) AS dst")
    c = customers.select("c_custkey", "path")
    step = c.selectExpr("c_custkey AS k", "path AS src", "CASE WHEN c_custkey % 5 < 4 THEN c_custkey + 1 WHEN (c_custkey div 5) % 3 = 0 THEN c_custkey - 4 END AS c_custkey").where("c_custkey IS NOT NULL")
    ring = step.join(c.withColumnRenamed("path", "dst"), "c_custkey").select("src", "dst")
    packages = parts.where("p_size < 5").selectExpr("path AS src", "'pkg:' || lower(p_type) AS dst")
    edge = lambda df, kind: df.select("src", "dst", F.lit(kind).alias("kind"), F.col("dst").alias("specifier"), F.xxhash64("src", "dst").alias("seq"))
    orders = t("orders").join(customers.selectExpr("c_custkey AS o_custkey", "path AS home"), "o_custkey")
    from pyspark.sql import Window

    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = orders.withColumn("before", F.lag("o_orderkey").over(own)).withColumn("after", F.lead("o_orderkey").over(own))
    orders = orders.withColumn("parent_id", F.expr("CASE WHEN o_orderkey % 11 = 0 AND before % 11 <> 0 THEN before END"))
    decorator = lambda n: f"struct('{n}' AS name, cast(NULL AS string) AS object, cast(NULL AS string) AS attribute, '(x)' AS args_raw, cast(NULL AS string) AS framework)"
    symbols = orders.selectExpr(
        "o_orderkey AS symbol_id", "CASE WHEN parent_id IS NULL THEN home END AS file", "parent_id", f"{NAME} AS name", f"{KIND} AS kind", "cast(o_orderkey % 200 + 1 AS int) AS line", "0 AS col",
        "cast(o_orderkey % 200 + 1 + o_orderkey % 7 AS int) AS line_end", "o_totalprice > 300000 AS is_exported", "false AS is_default", f"{VISIBILITY} AS visibility", "cast(NULL AS string) AS trait_impl",
        f"cast(CASE o_orderkey % 13 WHEN 0 THEN array({decorator('app.route')}) WHEN 1 THEN array({decorator('Get')}, {decorator('unknown')}) ELSE array() END AS array<{DECORATOR}>) AS decorators",
    )
    calls = orders.where("o_totalprice > 150000 AND after IS NOT NULL").selectExpr("'s:' || o_orderkey AS src", "'s:' || after AS dst")
    by_file = orders.where("o_totalprice > 400000").selectExpr("o_custkey - 1 AS c_custkey", "'s:' || o_orderkey AS dst").join(c, "c_custkey").selectExpr("path AS src", "dst")
    edges = edge(both.unionByName(ring).unionByName(packages), "ResolvedImport").unionByName(edge(calls.unionByName(by_file), "Calls"))
    return CodeGraph(
        files, symbols, edges, parts.where("p_size < 5").selectExpr("lower(p_type) AS name", "cast(NULL AS string) AS version").distinct(),
        spark.createDataFrame([("std",)], "name string"), spark.createDataFrame([], "uid long, specifier string, reason string"),
    )


# The same views for the checking SQL.
SQL = f"""WITH RECURSIVE parts AS (SELECT *, {PART} AS path, {PART_LANGUAGE} AS language FROM part),
sups AS (SELECT *, {SUPPLIER} AS path FROM supplier),
custs AS (SELECT *, {CUSTOMER} AS path FROM customer),
files AS (
  SELECT path, language, NULL::VARCHAR AS crate_name, 'Source' AS kind, CAST(p_size AS BIGINT) AS n_lines FROM parts
  UNION ALL SELECT path, 'rust', 'n' || s_nationkey, 'Source', 10 FROM sups UNION ALL SELECT path, 'python', NULL, 'Source', 20 FROM custs
  UNION ALL SELECT 'docs/n' || n_nationkey || '.md', NULL, NULL, 'Doc', 1 FROM nation UNION ALL SELECT 'r' || r_regionkey || '.toml', NULL, NULL, 'Config', 2 FROM region),
imports AS (
  SELECT DISTINCT p.path AS src, s.path AS dst FROM lineitem JOIN parts p ON p_partkey = l_partkey JOIN sups s ON s_suppkey = l_suppkey WHERE l_returnflag = 'N' AND l_quantity >= 45
  UNION SELECT DISTINCT s.path, p.path FROM lineitem JOIN parts p ON p_partkey = l_partkey JOIN sups s ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND l_quantity >= 40
  UNION SELECT a.path, b.path FROM custs a JOIN custs b ON b.c_custkey = CASE WHEN a.c_custkey % 5 < 4 THEN a.c_custkey + 1 WHEN (a.c_custkey // 5) % 3 = 0 THEN a.c_custkey - 4 END),
pkgs AS (SELECT path AS src, 'pkg:' || lower(p_type) AS dst FROM parts WHERE p_size < 5),
ords AS (SELECT o.*, c.path AS home, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders o JOIN custs c ON c.c_custkey = o.o_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
syms0 AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 AND before % 11 <> 0 THEN before END AS parent_id FROM ords),
syms AS (
  SELECT o_orderkey AS symbol_id, CASE WHEN parent_id IS NULL THEN home END AS file, home, parent_id, {NAME} AS name, {KIND} AS kind, CAST(o_orderkey % 200 + 1 AS INT) AS line, CAST(o_orderkey % 200 + 1 + o_orderkey % 7 AS INT) AS line_end,
    o_totalprice > 300000 AS is_exported, {VISIBILITY} AS visibility, CASE o_orderkey % 13 WHEN 0 THEN ['app.route'] WHEN 1 THEN ['Get', 'unknown'] ELSE [] END AS decos FROM syms0),
calls AS (
  SELECT 's:' || o_orderkey AS src, 's:' || after AS dst FROM ords WHERE o_totalprice > 150000 AND after IS NOT NULL
  UNION ALL SELECT c.path, 's:' || o_orderkey FROM ords JOIN custs c ON c.c_custkey = o_custkey - 1 WHERE o_totalprice > 400000),
every AS (
  SELECT src, dst, 'ResolvedImport' AS kind FROM imports UNION ALL SELECT src, dst, 'ResolvedImport' FROM pkgs UNION ALL SELECT src, dst, 'Calls' FROM calls
  UNION ALL SELECT file, 's:' || symbol_id, 'Contains' FROM syms WHERE parent_id IS NULL UNION ALL SELECT 's:' || symbol_id, 's:' || parent_id, 'ChildOf' FROM syms WHERE parent_id IS NOT NULL
  UNION ALL SELECT 's:' || symbol_id, 's:' || symbol_id, 'HasDecorator' FROM (SELECT symbol_id, unnest(decos) FROM syms))
"""
