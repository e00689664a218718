"""Set operations over folders, plans and corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .hierarchy import By
from .windows import keep_last


def assemble(*parts: DataFrame) -> DataFrame:
    """Root, folders and Items as one table; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def concat_batches(parts: list[DataFrame]) -> DataFrame:
    """The batches' rows with pos, in the order of the batches and, in each, of apos."""
    from .explore import number_rows

    tagged = [p.withColumn("__batch", F.lit(k)) for k, p in enumerate(parts)]
    return number_rows(reduce(DataFrame.unionByName, tagged), ["__batch", "apos"], "pos").drop("__batch")


def labels(plans: DataFrame) -> DataFrame:
    """(plan_id, label) of every variant's folders."""
    return plans.select("plan_id", X.semantic_label(F.col("folder")).alias("label")).distinct()


def all_folders(plans: DataFrame) -> DataFrame:
    """(label, n_plans, common, unique): in how many variants a label occurs."""
    own = labels(plans)
    total = own.agg(F.count_distinct("plan_id").alias("total"))
    counts = own.groupBy("label").agg(F.count("*").alias("n_plans"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n_plans", (F.col("n_plans") == F.col("total")).alias("common"), (F.col("n_plans") == 1).alias("unique"))


def common_folders(plans: DataFrame) -> DataFrame:
    return all_folders(plans).where("common").select("label")


def unique_folders(plans: DataFrame) -> DataFrame:
    own = labels(plans)
    return own.groupBy("label").agg(F.count("*").alias("n"), F.min("plan_id").alias("plan_id")).where("n = 1").select("label", "plan_id")


def off_plan(plan: DataFrame, folders: DataFrame, by: By = ()) -> DataFrame:
    return folders.select(*by, "folder").distinct().join(plan.select(*by, "folder"), [*by, "folder"], "left_anti")


def missing(plan: DataFrame, folders: DataFrame, by: By = ()) -> DataFrame:
    return plan.select(*by, "folder").distinct().join(folders.select(*by, "folder"), [*by, "folder"], "left_anti")


def plan_path_diff(old: DataFrame, new: DataFrame, by: By = ()) -> DataFrame:
    """(path, change): added, removed or unchanged."""
    sides = old.select(*by, "path", F.lit(1).alias("side")).unionByName(new.select(*by, "path", F.lit(2).alias("side")))
    seen = sides.groupBy(*by, "path").agg(F.bit_or("side").alias("seen"))
    return seen.select(*by, "path", F.when(F.col("seen") == 2, "added").when(F.col("seen") == 1, "removed").otherwise("unchanged").alias("change"))


def merge_corrections(old: DataFrame, new: DataFrame, by: By = ()) -> DataFrame:
    """Corrections by path: the last one counts, at the place of the first."""
    rows = old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1)))
    first = rows.groupBy(*by, "path").agg(F.min(F.struct("__g", "pos")).alias("first"))
    return keep_last(rows, [*by, "path"], ["__g", "pos"]).drop("__g", "pos").join(first, [*by, "path"]).select(*by, "path", "target", "new_title", F.struct("first.*").alias("place"))
