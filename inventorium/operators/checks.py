"""Data-quality rules; each gives (rule, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import materialise, sized
from .hierarchy import By, has_cycle

# Columns that an inventory must have, and levels that it may use.
REQUIRED_COLUMNS = ("id", "parent_id", "path", "level", "title", "start_date", "end_date")
VALID_LEVELS = ("RecordGrp", "SubGrp", "Series", "Subseries", "File", "Item", "OtherLevel")


def check_required(inv: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in inv.columns]


def _rule(df: DataFrame, name: str, n: Column, by: By = ()) -> DataFrame:
    return df.groupBy(*by).agg(n.cast("long").alias("n")).select(*by, F.lit(name).alias("rule"), "n")


def _bad_level() -> Column:
    return F.count_if(~F.coalesce(F.col("level").isin(*VALID_LEVELS), F.lit(False)))


def _no_root() -> Column:
    return F.when(F.count_if(X.text(F.col("parent_id")) == "") == 0, 1).otherwise(0)


def _bad_dates() -> Column:
    start, end = X.text(F.col("start_date")), X.text(F.col("end_date"))
    return F.count_if((start != "") & (end != "") & (start > end))


def check_levels(inv: DataFrame, by: By = ()) -> DataFrame:
    return _rule(inv, "invalid_level", _bad_level(), by)


def check_ids(inv: DataFrame, by: By = ()) -> DataFrame:
    """Every row of an identifier that repeats counts."""
    return _rule(inv.groupBy(*by, "id").agg(F.count("*").alias("c")), "duplicate_id", F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)), by)


def _lost_parents(inv: DataFrame, by: By) -> DataFrame:
    """(parent_id, below): parents that are no row's identifier, with the number of their rows. Each row brings itself and its
    parent to one grouping by identifier, so a parent of many rows is summed before the shuffle."""
    own = inv.select(*by, F.col("id").alias("parent_id"), F.lit(1).cast("long").alias("here"), F.lit(0).cast("long").alias("below"))
    asked = inv.where(X.text(F.col("parent_id")) != "").select(*by, "parent_id", F.lit(0).cast("long").alias("here"), F.lit(1).cast("long").alias("below"))
    keys = own.unionByName(asked).groupBy(*by, "parent_id").agg(F.sum("here").alias("here"), F.sum("below").alias("below"))
    return keys.where("here = 0").select(*by, "parent_id", "below")


#: Parents without a row that are broadcast to the rows; more are joined by a shuffle.
MOST_LOST = 100_000


def orphans(inv: DataFrame, by: By = ()) -> DataFrame:
    """Rows whose parent is no row's identifier."""
    lost = materialise(_lost_parents(inv, by).select(*by, "parent_id"), "lost-parents")
    return inv.join(sized(lost, MOST_LOST), [*by, "parent_id"], "left_semi")


def check_orphans(inv: DataFrame, by: By = ()) -> DataFrame:
    """Holdings without an orphan have no row if there are several."""
    return _rule(_lost_parents(inv, by), "orphan", F.coalesce(F.sum("below"), F.lit(0)), by)


def check_root(inv: DataFrame, by: By = ()) -> DataFrame:
    return _rule(inv, "no_root", _no_root(), by)


def check_cycles(inv: DataFrame, by: By = ()) -> DataFrame:
    return has_cycle(inv, by).select(*by, F.lit("parent_cycle").alias("rule"), F.col("has_cycle").cast("int").cast("long").alias("n"))


def check_dates(inv: DataFrame, by: By = ()) -> DataFrame:
    return _rule(inv, "start_after_end", _bad_dates(), by)


def validate(inv: DataFrame, output: bool = False, by: By = ()) -> DataFrame:
    """All rules for an input; for an output also those of its tree. What a row shows by itself is one aggregate; identifiers
    and orphans share one grouping by identifier, to which each row brings itself and its parent."""
    if missing := check_required(inv):
        raise ValueError(f"missing columns {missing}")
    rows = inv.groupBy(*by).agg(_bad_level().alias("invalid_level"), _bad_dates().alias("start_after_end"), _no_root().alias("no_root"))
    own = inv.select(*by, "id", F.lit(1).alias("here"), F.lit(0).alias("below"))
    keys = own
    if output:
        keys = own.unionByName(inv.where(X.text(F.col("parent_id")) != "").select(*by, F.col("parent_id").alias("id"), F.lit(0).alias("here"), F.lit(1).alias("below")))
    keys = keys.groupBy(*by, "id").agg(F.sum("here").alias("here"), F.sum("below").alias("below"))
    tree = keys.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("here") > 1, F.col("here"))), F.lit(0)).alias("duplicate_id"), F.coalesce(F.sum(F.when(F.col("here") == 0, F.col("below"))), F.lit(0)).alias("orphan"))

    def listed(df: DataFrame, *names: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("n")) for n in names])
        return df.select(*by, F.inline(pairs))

    out = listed(rows, "invalid_level", "start_after_end", *(["no_root"] if output else []))
    out = out.unionByName(listed(tree, "duplicate_id", *(["orphan"] if output else [])))
    return out.unionByName(check_cycles(inv, by)) if output else out


def check_plan_text(plan: DataFrame) -> DataFrame:
    """(plan_id, rule, n) over parsed lines (plan_id, pos, folder): repeated names, illegal names, numbered folders whose
    parent number has no folder."""
    repeated = plan.groupBy("plan_id", F.lower("folder").alias("f")).agg(F.count("*").alias("c")).where("c > 1").groupBy("plan_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("duplicate_name"))
    illegal = plan.where(F.col("folder").rlike('[<>:"/\\\\|?*\\x00-\\x1f]') | F.col("folder").rlike("[. ]$")).groupBy("plan_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("illegal_name"))
    numbered = plan.select("plan_id", F.regexp_replace(X.number_prefix(F.col("folder")), "-?[0-9]+$", "").alias("prefix")).where("prefix <> ''")
    known = plan.select("plan_id", X.number_prefix(F.col("folder")).alias("prefix")).distinct()
    lost = numbered.hint("merge").join(known.hint("merge"), ["plan_id", "prefix"], "left_anti").groupBy("plan_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("missing_parent"))
    return reduce(DataFrame.unionByName, [d.select("plan_id", "rule", "n") for d in (repeated, illegal, lost)])


def check_plan_nodes(nodes: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """(plan_id, rule, n) over nodes (plan_id, id, parent_id, title, slug): empty titles, bad slugs, siblings alike, plans
    without one root, and those of ``plans`` (plan_id) that have no node."""
    title = nodes.where(F.trim(X.text(F.col("title"))) == "").groupBy("plan_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("empty_title"))
    slug = nodes.where(~X.text(F.col("slug")).rlike("^[A-Za-z0-9_]+$")).groupBy("plan_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("bad_slug"))
    alike = nodes.groupBy("plan_id", "parent_id", F.lower("slug").alias("s")).agg(F.count("*").alias("c")).where("c > 1").groupBy("plan_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("sibling_duplicate"))
    root = nodes.groupBy("plan_id").agg(F.count_if(X.text(F.col("parent_id")) == "").alias("n")).where("n <> 1").withColumn("rule", F.lit("root_count"))
    found = [title, slug, alike, root]
    if plans is not None:
        bare = plans.select("plan_id").distinct().hint("merge").join(nodes.select("plan_id").distinct().hint("merge"), "plan_id", "left_anti")
        found.append(bare.select("plan_id", F.lit(1).cast("long").alias("n"), F.lit("empty_plan").alias("rule")))
    return reduce(DataFrame.unionByName, [d.select("plan_id", "rule", "n") for d in found])
