"""Run logs: tokens, cost, agent metrics, and portfolio figures. Nulls are not measured, and are no zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import sized
from .hierarchy import By, along_path, items
from .joins import price_models, recommend_sampling
from .windows import sample_per_folder

COUNTERS = ("input_tokens", "output_tokens", "total_tokens", "cache_read_tokens", "reasoning_tokens")


def usage_sum(runs: DataFrame, by: By = ()) -> DataFrame:
    """Sums of the five counters over records with a total; null where none has the counter."""
    return runs.where("total_tokens IS NOT NULL").groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def token_estimate(rows: DataFrame, columns: list[str], by: By = (), overhead: int = 0) -> DataFrame:
    """ceil(characters / 3.5) of the rows as separated lines, plus a fixed overhead."""
    line = F.length(F.concat_ws(";", *[X.text(F.col(c)) for c in columns])) + 1
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), (F.ceil(F.sum(line) / 3.5) + overhead).cast("long").alias("tokens"))


def cost(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Runs with input, output and total cost in euros, rounded to six digits; null if local or unknown."""
    priced = price_models(runs, rules)
    a, b = F.col("input_tokens") / 1e6 * F.col("input_eur_m"), F.col("output_tokens") / 1e6 * F.col("output_eur_m")
    return priced.withColumns({"input_eur": F.round(a, 6), "output_eur": F.round(b, 6), "total_eur": F.round(a + b, 6)})


def agent_run_metrics(cases: DataFrame, by: By = ("run_id",)) -> DataFrame:
    """cases, passed, pct, for each check ok and measured, mean steps, errors."""
    checks = [c for k in ("tool_ok", "filter_ok", "total_ok") for c in (F.count_if(F.col(k)).alias(k), F.count(k).alias(k.replace("_ok", "_measured")))]
    return cases.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.round(100 * F.count_if("passed") / F.count("*"), 1).alias("pct"), *checks, F.round(F.avg("steps"), 1).alias("mean_steps"), F.count("error").alias("errors"))


def project_metrics(projects: DataFrame) -> DataFrame:
    """Per project: sums of volumes, durations and tokens over its runs, nulls ignored, and whether all measured runs match."""
    sums = [F.sum(c).alias(c) for c in ("items", "folders", "duration_s", "total_tokens")]
    return projects.groupBy("project_id").agg(*sums, F.bool_and("plan_matches").alias("plan_matches"))


def fonds_dashboard(projects: DataFrame) -> DataFrame:
    """Totals of the portfolio; the conformity rate is of those measured, null if none is."""
    return projects.agg(F.count("*").alias("projects"), F.sum("items").alias("items"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("duration_s"), 3).alias("duration_s"), F.count("plan_matches").alias("measured"), F.count_if("plan_matches").alias("matching"), F.round(F.try_divide(F.count_if("plan_matches"), F.nullif(F.count("plan_matches"), F.lit(0))), 4).alias("conformity_rate"))


def coverage_report(inv: DataFrame, classified: DataFrame, by: By = ()) -> DataFrame:
    """original_items, new_folders, new_items, undated_items, missing."""
    kind = F.when(F.col("level") == "Item", "item").when(F.col("path") != ".", "folder")
    after = classified.select(*by, kind.alias("kind"), (X.text(F.col("start_date")) == "").alias("undated"))
    rows = items(inv).select(*by, F.lit("original").alias("kind"), F.lit(False).alias("undated")).unionByName(after)
    n = {"original_items": F.col("kind") == "original", "new_folders": F.col("kind") == "folder", "new_items": F.col("kind") == "item", "undated_items": (F.col("kind") == "item") & F.col("undated")}
    out = rows.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    return out.withColumn("missing", F.col("original_items") - F.col("new_items"))


def manifest_summary(classified: DataFrame, by: By = ()) -> DataFrame:
    """folders, items, max_depth of the folders below the root, first and last date of the Items."""
    item, folder = F.col("level") == "Item", F.col("level") == "RecordGrp"
    depths = along_path(classified.where(folder).select(*by, "id", "parent_id"), {"d": (F.lit(0).cast("long"), lambda above, own: above + own + 1)}, by)
    rows = classified.select(*by, "level", "path", "start_date", "end_date", F.lit(0).cast("long").alias("d")).unionByName(depths.select(*by, "d"), allowMissingColumns=True)
    first, last = (F.coalesce(f(F.when(item, F.nullif(c, F.lit("")))), F.lit("")).alias(c) for c, f in (("start_date", F.min), ("end_date", F.max)))
    return rows.groupBy(*by).agg(F.count_if(folder & (F.col("path") != ".")).alias("folders"), F.count_if(item).alias("items"), F.coalesce(F.max("d"), F.lit(0)).alias("max_depth"), first, last)


def plan_ranges(shapes: DataFrame) -> DataFrame:
    return shapes.agg(*[f(c).alias(f"{n}_{c}") for c in ("folders", "depth", "leaves") for f, n in ((F.min, "min"), (F.max, "max"))])


def enrich_report(described: DataFrame) -> DataFrame:
    return described.groupBy("status").agg(F.count("*").alias("n"))


def budget_report(inv: DataFrame, sample_n: int, blank_dates: bool, columns: tuple[str, ...] = ("id", "parent_id", "path", "level", "title", "start_date", "end_date")) -> DataFrame:
    """(setting, sample_n, rows, tokens) of the current setting and of the recommended one, which also empties dates."""
    volume = items(inv).agg(F.count("*").alias("items"))
    best = recommend_sampling(volume).first().sample_n

    def estimate(name: str, n: int, blank: bool) -> DataFrame:
        rows = sample_per_folder(inv, n)
        return token_estimate(blank_item_dates(rows) if blank else rows, list(columns)).select(F.lit(name).alias("setting"), F.lit(n).alias("sample_n"), "rows", "tokens")

    return estimate("current", sample_n, blank_dates).unionByName(estimate("recommended", best, True))


def prepare_columns(inv: DataFrame, include_description: bool = False) -> DataFrame:
    """The required columns, the description last where asked for."""
    from .checks import REQUIRED_COLUMNS

    extra = ["description"] if include_description and "description" in inv.columns else []
    return inv.select(*REQUIRED_COLUMNS, *extra)


def blank_item_dates(inv: DataFrame) -> DataFrame:
    is_item = F.col("level") == "Item"
    return inv.withColumns({c: F.when(is_item, "").otherwise(F.col(c)) for c in ("start_date", "end_date")})


def tree_only(inv: DataFrame) -> DataFrame:
    return inv.where(F.coalesce(F.col("level") != "Item", F.lit(True)))


def items_to_classify(refs: DataFrame) -> DataFrame:
    """Items with a ref as ref, path, current_title, date and, where known, description."""
    extra = ["description"] if "description" in refs.columns else []
    return refs.select("ref", "path", F.col("title").alias("current_title"), F.col("start_date").alias("date"), *extra)


def llm_projection(rows: DataFrame, ref_mode: bool) -> DataFrame:
    return rows if ref_mode else rows.drop("ref")


def run_matrix(datasets: DataFrame, models: DataFrame, modes: DataFrame, results: DataFrame, preparations: DataFrame | None = None) -> DataFrame:
    """A row for each dataset, model, mode and, where given, preparation, with its result where there is one. What the
    parameter lists multiply to is the result asked for; a list is broadcast if it is short."""
    grid, keys = datasets.select("dataset"), ["dataset"]
    for name, values in (("model", models), ("mode", modes), ("preparation", preparations)):
        if values is not None:
            grid = grid.crossJoin(sized(values.select(name), 1_000))
            keys.append(name)
    return grid.hint("merge").join(results.hint("merge"), keys, "left")
