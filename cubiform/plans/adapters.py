"""Scenes out of plain star-schema tables: integer arithmetic only, so every engine derives the same.

Each adapter has a Spark form and the SQL of the same relation, for checks in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.geometry import tasks  # noqa: F401

DIMS = (32, 32, 32)
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

#: Arguments of every drawing command, as expressions both dialects read ({i} is integer division).
_ARGUMENTS = {
    "material": "l_partkey % 7 + 1", "material2": "l_suppkey % 5 + 8",
    "ox": "l_partkey % 16", "oy": "l_suppkey % 16", "oz": "(l_partkey + l_suppkey) % 16",
    "sx": "1 + CAST(floor(l_quantity) AS BIGINT) % 4", "sy": "1 + l_linenumber % 3", "sz": "1 + l_suppkey % 3",
    "axis": "l_linenumber % 3", "length": "1 + CAST(floor(l_quantity) AS BIGINT) % 8",
    "u": "2 + l_partkey % 5", "v": "2 + l_suppkey % 4", "thickness": "1 + l_linenumber % 2", "depth": "2 + l_suppkey % 7", "width": "3 + l_partkey % 8",
    "count": "2 + l_partkey % 3", "dx": "1 + l_suppkey % 3", "dy": "l_linenumber % 2", "dz": "l_partkey % 3",
    "height": "2 + l_suppkey % 9", "crown": "1 + l_partkey % 4", "spacing": "1 + l_suppkey % 4", "bits": "1 + l_partkey % 62",
    "turns": "1 + l_suppkey % 3", "px": "16 + l_partkey % 8", "py": "l_suppkey % 16", "pz": "16 + l_suppkey % 8", "pivot_twice": "40 + l_partkey % 8",
}

SQL_COMMANDS = (
    "SELECT l_orderkey AS scene, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(_ORDER) + ") AS seq, l_returnflag AS flag, "
    + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in _ARGUMENTS.items()) + " FROM lineitem"
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commands(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """A scene for each order, a command for each of its lines, in a total order.

    With dealt, partitions have whole scenes, row by row in that order: nothing else need be shuffled.
    """
    lines = read(spark, sf_dir, "lineitem")
    lines = (lines.repartition(tasks(spark), "l_orderkey") if dealt else lines).withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).cast("long"))
    return lines.select(F.col("l_orderkey").alias("scene"), "seq", F.col("l_returnflag").alias("flag"), *(F.expr(f"CAST({e} AS BIGINT)").alias(n) for n, e in _ARGUMENTS.items()))


SQL_TERRAIN = "SELECT user_id AS scene, CAST((event_id * 37 + user_id * 11) % 131072 AS BIGINT) AS id, event_id AS seq, -(user_id % 64) AS min_y FROM events"


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted cells of a terrain for each user."""
    return read(spark, sf_dir, "events").selectExpr("user_id AS scene", "CAST((event_id * 37 + user_id * 11) % 131072 AS BIGINT) AS id", "event_id AS seq", "-(user_id % 64) AS min_y")


SQL_FORGE = "SELECT o_custkey AS component, CAST((o_orderkey * 131) % 1960 AS BIGINT) AS cell, o_orderkey AS seq FROM orders"


def forge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a forged component for each customer."""
    return read(spark, sf_dir, "orders").selectExpr("o_custkey AS component", "CAST((o_orderkey * 131) % 1960 AS BIGINT) AS cell", "o_orderkey AS seq")


SQL_CANDIDATES = (
    "SELECT CAST(p_partkey % 8 AS BIGINT) AS island, CAST(p_size % 3 AS BIGINT) AS mismatches, CAST(p_partkey * 13 % 97 AS BIGINT) AS bytes, "
    "CAST(p_partkey * 31 % 1009 AS BIGINT) AS units, p_name AS encoding, p_partkey AS slot FROM part"
)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search population: candidates on eight islands."""
    return read(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey % 8 AS BIGINT) AS island", "CAST(p_size % 3 AS BIGINT) AS mismatches", "CAST(p_partkey * 13 % 97 AS BIGINT) AS bytes",
        "CAST(p_partkey * 31 % 1009 AS BIGINT) AS units", "p_name AS encoding", "p_partkey AS slot",
    )


SQL_QUADS = (
    "SELECT c_custkey AS quad, CAST(c_nationkey AS BIGINT) AS owner, CAST(c_custkey % 3 AS BIGINT) AS axis, CAST(c_custkey // 3 % 2 AS BIGINT) AS side, CAST(c_custkey % 5 AS BIGINT) AS plane, "
    "CAST(c_custkey % 9 AS BIGINT) AS u0, CAST(c_custkey % 9 + 1 + c_custkey % 4 AS BIGINT) AS u1, CAST(c_custkey % 7 AS BIGINT) AS v0, CAST(c_custkey % 7 + 1 + c_custkey % 3 AS BIGINT) AS v1 FROM customer"
)


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paint quads: rectangles on the faces of an owner's planes."""
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS quad", "CAST(c_nationkey AS BIGINT) AS owner", "c_custkey % 3 AS axis", "c_custkey div 3 % 2 AS side", "c_custkey % 5 AS plane",
        "c_custkey % 9 AS u0", "c_custkey % 9 + 1 + c_custkey % 4 AS u1", "c_custkey % 7 AS v0", "c_custkey % 7 + 1 + c_custkey % 3 AS v1",
    )
