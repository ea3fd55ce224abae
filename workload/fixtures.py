"""Inputs of the registered queries: views of the given tables, and fixed parameters.

Every view is written as SQL that Spark and DuckDB both accept, so the query and
its check read the same definition.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions.hashing import HashRow

# Fixed values of the checks: coefficients, modulus and centres.
WIDE_HASHES = [
    HashRow(2305843009213693950, 1152921504606846977, 1729382256910270463, 5, 2147483648, 2147483647),
    HashRow(4294967297, 2305843009213693949, 1099511627777, 1311768467294899695, 987654321987654321, 1),
]
PRIME = 8191
HASHES = [
    HashRow(2753, 4111, 6151, 523, 2971, 6007),
    HashRow(5417, 977, 1877, 7489, 7207, 1013),
    HashRow(7019, 6301, 4409, 3163, 5099, 4507),
    HashRow(3391, 2287, 7703, 1409, 1319, 3821),
]
CENTERS_LI = [[10.0, 20.0, 5.0], [25.0, 45.0, 5.0], [40.0, 70.0, 5.0]]
CENTERS_THREE = [[0.0, 5.0], [5.0, 12.0], [8.0, 20.0]]

LI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LI_COORDINATES = ["l_quantity", "l_extendedprice / 1000", "l_discount * 100"]
LI_GROUP = "case when l_returnflag = 'A' then 'A' else 'B' end"
THREE_COORDINATES = ["c_acctbal / 1000", "cast(c_nationkey as double)"]
THREE_GROUP = "case c_mktsegment when 'BUILDING' then 'A' when 'AUTOMOBILE' then 'B' else 'C' end"
EMB_GROUP = "case when label < 3 then 'A' else 'B' end"

ITEMS = {
    "skew": ("lineitem", "l_partkey % (1 + l_orderkey % 50)"),
    "part": ("lineitem", "l_partkey"),
    "order": ("lineitem", "l_orderkey"),
    "user": ("events", "user_id"),
    "once": ("events", "event_id"),
    "wide": ("lineitem", "(l_orderkey % 1000 - 500) * 9007199254740993 - l_partkey"),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points_li(spark: SparkSession, sf: str, keys: bool = False) -> DataFrame:
    kept = LI_KEY if keys else []
    x = f"array({', '.join(LI_COORDINATES)}) as x"
    return table(spark, sf, "lineitem").selectExpr(*kept, x, f"{LI_GROUP} as g")


def points_three(spark: SparkSession, sf: str) -> DataFrame:
    x = f"array({', '.join(THREE_COORDINATES)}) as x"
    return table(spark, sf, "customer").selectExpr("c_custkey", x, f"{THREE_GROUP} as g")


def points_emb(spark: SparkSession, sf: str) -> DataFrame:
    x = "cast(embedding as array<double>) as x"
    return table(spark, sf, "embeddings").selectExpr("vec_id", "label", x, f"{EMB_GROUP} as g")


def centers_emb(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of every label, numbered in label order."""
    points = points_emb(spark, sf)
    means = points.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("c"))
    return means.select(F.col("label").alias("cluster"), "c")


def items(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, expression = ITEMS[name]
    return table(spark, sf, source).selectExpr(f"{expression} as item")


def sql_points_li() -> str:
    coordinates = ", ".join(f"{x} as x{j}" for j, x in enumerate(LI_COORDINATES))
    return f"select {', '.join(LI_KEY)}, {coordinates}, {LI_GROUP} as g from lineitem"


def sql_points_three() -> str:
    coordinates = ", ".join(f"{x} as x{j}" for j, x in enumerate(THREE_COORDINATES))
    return f"select c_custkey, {coordinates}, {THREE_GROUP} as g from customer"


def sql_items(name: str) -> str:
    source, expression = ITEMS[name]
    return f"select {expression} as item from {source}"
