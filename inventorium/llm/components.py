"""Connected components of a graph that is a table of edges, by alternating large-star and small-star steps.

Each step is one aggregation by node and one join back; the frames are written to the shared folder after each round, so a
lost executor costs one round. No edge or component ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Of each node: its neighbours (above it for the large star, itself and those below for the small) point to the least
    of its neighbourhood. The least is a partial aggregate; the join back is one that Spark may split where it is skewed."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return both.hint("merge").join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.hint("merge").join(least.hint("merge"), "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` has two columns of nodes. Returns (node, component): each node that has an edge to another one, with the
    least node that it reaches. Loops and repeated edges do no harm; no edges, no rows."""
    spark = edges.sparkSession
    a, b = edges.columns
    path = new_path(spark, "edges")
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    start.write.parquet(path)
    kind = start.schema
    now = spark.read.schema(kind).parquet(path)
    seen = None
    for _ in range(most_rounds):
        step = _star(_star(now, large=True), large=False).where("u <> v").distinct()
        after = new_path(spark, "edges")
        step.write.parquet(after)
        remove(spark, path)
        path = after
        now = spark.read.schema(kind).parquet(path)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
