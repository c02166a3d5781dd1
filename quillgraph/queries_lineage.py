"""Queries of what SQL statements read: a statement for each part, of five kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.lineage import Lineage
from quillgraph.registry import query
from quillgraph.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Statements by kind; $n, $t and $s are a part's name, type and size.
_KINDS = (
    "SELECT p_name, count(*) n FROM part WHERE p_name = '$n' AND NOT p_size < $s GROUP BY p_name ORDER BY n",
    "select T1.l_orderkey /* , p_type */ from lineitem as T1 join PART T2 on T1.l_partkey = T2.p_partkey where T2.p_size in ($s, 3) and T1.l_quantity not between 2 and $s",
    "SELECT c.c_name FROM customer c WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%$s%' AND c_acctbal > 10) -- n_regionkey = 4",
    "WITH x AS (SELECT o_custkey, max(o_totalprice) AS o_orderkey FROM orders GROUP BY o_custkey) SELECT x.o_orderkey, c_name FROM x JOIN customer ON x.o_custkey = c_custkey WHERE c_mktsegment <> '$t'",
    "SELECT y.n FROM (SELECT s_name AS n, s_nationkey FROM main.supplier WHERE s_acctbal >= 5) AS y JOIN nation ON y.s_nationkey = n_nationkey UNION SELECT `p_name` FROM \"part\" WHERE p_type != 'it''s $t'",
)
_READ = {
    0: {"part": ("p_name", "p_size")},
    1: {"lineitem": ("l_orderkey", "l_partkey", "l_quantity"), "part": ("p_partkey", "p_size")},
    2: {"customer": ("c_name", "c_nationkey", "c_acctbal"), "nation": ("n_nationkey", "n_name")},
    3: {"orders": ("o_custkey", "o_totalprice"), "customer": ("c_name", "c_custkey", "c_mktsegment")},
    4: {"supplier": ("s_name", "s_nationkey", "s_acctbal"), "nation": ("n_nationkey",), "part": ("p_name", "p_type")},
}


def _lineage(spark: SparkSession, sf: str) -> Lineage:
    part = table(spark, sf, "part")
    sql = F.lit("")
    for k, text in enumerate(_KINDS):
        made = F.lit(text)
        for sign, value in (("$n", "p_name"), ("$t", "p_type"), ("$s", "p_size")):
            made = F.replace(made, F.lit(sign), F.col(value).cast("string"))
        sql = F.when(F.col("p_partkey") % len(_KINDS) == k, made).otherwise(sql)
    schema = spark.createDataFrame([(t, c) for t in TABLES for c in table(spark, sf, t).columns], "table string, column string")
    return Lineage(part.select(F.col("p_partkey").alias("sid"), sql.alias("sql")), schema)


_EXPECTED = ", ".join(f"({k}, '{t}', '{c}')" for k, read in _READ.items() for t, columns in read.items() for c in columns)


@query(f"SELECT DISTINCT p_partkey AS sid, t AS \"table\" FROM part JOIN (VALUES {_EXPECTED}) v(k, t, c) ON p_partkey % 5 = k")
def sql_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _lineage(spark, sf).tables()


@query(f"SELECT p_partkey AS sid, t AS \"table\", c AS \"column\" FROM part JOIN (VALUES {_EXPECTED}) v(k, t, c) ON p_partkey % 5 = k")
def sql_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _lineage(spark, sf).columns()


@query("""WITH l AS (SELECT p_partkey AS sid, p_partkey % 5 AS k, p_name AS n, p_type AS t, p_size::VARCHAR AS s FROM part),
x AS (SELECT sid, 'part' AS "table", 'p_name' AS "column", n AS literal, '=' AS how FROM l WHERE k = 0 UNION SELECT sid, 'part', 'p_size', s, '<' FROM l WHERE k = 0
UNION SELECT sid, 'lineitem', 'l_quantity', unnest(['2', s]), 'BETWEEN' FROM l WHERE k = 1 UNION SELECT sid, 'customer', 'c_acctbal', '10', '>' FROM l WHERE k = 2
UNION SELECT sid, 'customer', 'c_mktsegment', t, '<>' FROM l WHERE k = 3 UNION SELECT sid, 'supplier', 's_acctbal', '5', '>=' FROM l WHERE k = 4 UNION SELECT sid, 'part', 'p_type', 'it''s ' || t, '!=' FROM l WHERE k = 4
UNION SELECT sid, 'part', 'p_size', i, 'IN' FROM (SELECT sid, unnest([s, '3']) AS i FROM l WHERE k = 1) q WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT p_size::VARCHAR AS v FROM part) z WHERE contains(v, i))
UNION SELECT sid, 'nation', 'n_name', s, 'LIKE' FROM l WHERE k = 2 AND EXISTS (SELECT 1 FROM nation WHERE contains(n_name, s))) SELECT * FROM x""")
def sql_literals(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "part").select(F.lit("part").alias("table"), F.lit("p_size").alias("column"), F.col("p_size").cast("string").alias("value")).distinct()
    names = table(spark, sf, "nation").select(F.lit("nation"), F.lit("n_name"), "n_name")
    return _lineage(spark, sf).literals(sizes.union(names))
