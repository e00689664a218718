"""Joins between inventories, assignments, plans, directives, prices and listings.

Assignments have ref or path, target, new_title and apos (their order). Plans have plan_id, pos, folder, parent, title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import materialise, merged
from .explore import structured_filter, with_holding
from .hierarchy import By, intervals, items
from .windows import keep_first


def rehydrate_paths(asg: DataFrame, refs: DataFrame, by: By = ()) -> DataFrame:
    """Assignments by ref get the path of the Item with that ref, or an empty one; no-op if they have paths."""
    if "path" in asg.columns:
        return asg
    known = refs.select(*by, F.col("ref").cast("string").alias("ref"), F.col("path"))
    return asg.withColumn("ref", F.trim(F.col("ref").cast("string"))).join(known, [*by, "ref"], "left").withColumn("path", F.coalesce("path", F.lit("")))


def attach_source(asg: DataFrame, inv: DataFrame, by: By = ()) -> DataFrame:
    """Assignments with the attributes of the first Item that has their path."""
    return asg.join(keep_first(items(inv), [*by, "path"], ["pos"]), [*by, "path"])


def unclassified(inv: DataFrame, asg: DataFrame, by: By = ()) -> DataFrame:
    return items(inv).join(asg.select(*by, "path"), [*by, "path"], "left_anti")


def unknown_paths(inv: DataFrame, asg: DataFrame, by: By = ()) -> DataFrame:
    return asg.join(items(inv).select(*by, "path"), [*by, "path"], "left_anti")


def match_targets(asg: DataFrame, plan: DataFrame, by: By = ()) -> DataFrame:
    """Assignments with plan_folder: their target if the plan has it, else null. A plan is small beside them, but of no
    bounded size, so Spark chooses how to join."""
    known = plan.select(*by, F.col("folder").alias("target"), F.col("folder").alias("plan_folder")).distinct()
    return asg.join(known, [*by, "target"], "left")


def plan_parents(plan: DataFrame) -> DataFrame:
    """(plan_id, pos, folder, parent): the first folder whose number is this one's without its last part."""
    prefix = F.substring_index("folder", "_", 1)
    own = plan.select("plan_id", "pos", "folder", F.when(F.instr(prefix, "-") > 0, F.regexp_replace(prefix, "-[^-]*$", "")).alias("above"))
    first = plan.select("plan_id", prefix.alias("above"), "pos", "folder").groupBy("plan_id", "above").agg(F.min_by("folder", "pos").alias("parent"))
    return merged(own, first, ["plan_id", "above"], "left").select("plan_id", "pos", "folder", "parent")


# Prices in euros for a million tokens, by the first rule whose text is in a model's name; local prefixes.
PRICES = (
    ("claude-haiku", "Claude Haiku", 0.7, 3.7),
    ("claude-opus", "Claude Opus", 13.8, 69.0),
    ("claude-sonnet", "Claude Sonnet", 2.8, 13.8),
    ("claude-fable", "Claude Fable", 2.8, 13.8),
    ("gemini-2.5-flash", "Gemini Flash", 0.28, 2.3),
    ("gemini-1.5-flash", "Gemini Flash", 0.07, 0.28),
    ("gemini", "Gemini Pro", 1.15, 9.2),
    ("flash", "Gemini Flash", 0.28, 2.3),
    ("gpt-5-nano", "GPT-5 nano", 0.05, 0.37),
    ("gpt-5-mini", "GPT-5 mini", 0.23, 1.84),
    ("mini", "GPT mini", 0.23, 1.84),
    ("o3", "OpenAI o3", 1.84, 7.36),
    ("o1", "OpenAI o1", 13.8, 55.2),
    ("gpt-5", "GPT-5", 1.15, 9.2),
    ("gpt-4o", "GPT-4o", 2.3, 9.2),
    ("gpt-4", "GPT-4", 2.3, 9.2),
)
LOCAL_PREFIXES = ("ollama/", "openai/", "lm_studio/")


def price_rules(spark) -> DataFrame:
    return spark.createDataFrame([(k, *rule) for k, rule in enumerate(PRICES)], "rule_pos int, match string, label string, input_eur_m double, output_eur_m double")


def price_models(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Runs (model) with label and prices of the first rule that their model's name contains; null if local or unknown.
    Rules are looked up for each distinct model, once."""
    models = runs.select("model").distinct()
    name = F.lower(F.trim(X.text(F.col("model"))))
    local = F.startswith(name, F.lit(LOCAL_PREFIXES[0])) | F.startswith(name, F.lit(LOCAL_PREFIXES[1])) | F.startswith(name, F.lit(LOCAL_PREFIXES[2]))
    hit = models.where(~local).join(F.broadcast(rules), F.contains(name, F.col("match")))  # the fixed rules above
    first = hit.groupBy("model").agg(F.min_by(F.struct("label", "input_eur_m", "output_eur_m"), "rule_pos").alias("r")).select("model", "r.*")
    return runs.join(first, "model", "left")


# Up to how many Items, the tier and how many files of a folder to show.
TIERS = ((200, "petit", 0), (1000, "moyen", 5), (5000, "grand", 3), (None, "très grand", 2))


def recommend_sampling(volumes: DataFrame, n: str = "items") -> DataFrame:
    """Volumes with tier and sample_n of the first tier that holds them."""
    tier, sample = F.lit(TIERS[-1][1]), F.lit(TIERS[-1][2])
    for most, name, k in reversed(TIERS[:-1]):
        tier, sample = F.when(F.col(n) <= most, name).otherwise(tier), F.when(F.col(n) <= most, k).otherwise(sample)
    return volumes.withColumns({"tier": tier, "sample_n": sample})


def source_labels(inv: DataFrame, by: By = ()) -> DataFrame:
    """(label): what the source's folders with an Item below them are called, by title, else by name. An empty folder is a
    fault of the source, which no plan has to keep."""
    from .audit import source_folders

    full = source_folders(inv, by).where("non_empty")
    return full.select(*by, X.conservation_label(F.col("label")).alias("label")).where("label <> ''").distinct()


def rubrics(plan: DataFrame, by: By = ()) -> DataFrame:
    """The plan without a single root that has children, which stands for the holding itself."""
    kids = plan.where("parent IS NOT NULL").select(*by, F.col("parent").alias("folder")).distinct().withColumn("has_kids", F.lit(True))
    roots = plan.groupBy(*by).agg(F.count_if(F.col("parent").isNull()).alias("n_roots"))
    rows = with_holding(merged(plan, kids, [*by, "folder"], "left"), roots, by)
    alone = F.col("parent").isNull() & (F.col("n_roots") == 1) & F.coalesce("has_kids", F.lit(False))
    return rows.where(~alone).select(*plan.columns)


def _planned_labels(plan: DataFrame, by: By) -> DataFrame:
    return rubrics(plan, by).select(*by, X.conservation_label(F.col("folder")).alias("label")).where("label <> ''").distinct()


def retained_folders(inv: DataFrame, plan: DataFrame, by: By = ()) -> DataFrame:
    """(label, retained): labels of the source's folders, and whether the plan has them."""
    planned = _planned_labels(plan, by).withColumn("retained", F.lit(True))
    return merged(source_labels(inv, by), planned, [*by, "label"], "left").withColumn("retained", F.coalesce("retained", F.lit(False)))


def created_folders(inv: DataFrame, plan: DataFrame, by: By = ()) -> DataFrame:
    """(label): labels of the plan's folders that no source folder has."""
    return merged(_planned_labels(plan, by), source_labels(inv, by), [*by, "label"], "left_anti")


def conservation(inv: DataFrame, plans: DataFrame) -> DataFrame:
    """Of each of many plans for one source (plan_id, folder, parent): source_folders, source_retained, source_retained_pct and
    folders_created, by one join of all plans' labels with those of the source."""
    known = source_labels(inv).withColumn("known", F.lit(True))
    total = known.agg(F.count("*").alias("source_folders"))
    each = merged(_planned_labels(plans, ("plan_id",)), known, "label", "left").groupBy("plan_id")
    counts = each.agg(F.count_if("known").alias("source_retained"), F.count_if(F.col("known").isNull()).alias("folders_created"))
    every = merged(plans.select("plan_id").distinct(), counts, "plan_id", "left").na.fill(0)
    pct = F.round(F.try_divide(100 * F.col("source_retained"), F.col("source_folders")), 1)
    return every.crossJoin(F.broadcast(total)).select("plan_id", "source_folders", "source_retained", pct.alias("source_retained_pct"), "folders_created")  # one row


def stale_anchors(directives: DataFrame, plan: DataFrame, by: By = ()) -> DataFrame:
    """Anchors of directives that are no plan folder, each once, in the order of their first use."""
    lost = directives.where(X.text(F.col("folder")) != "").join(plan.select(*by, "folder"), [*by, "folder"], "left_anti")
    return lost.groupBy(*by, "folder").agg(F.min("pos").alias("pos")).orderBy(*by, "pos")


def allowed_parents(directives: DataFrame, plan: DataFrame, by: By = ()) -> DataFrame:
    """Plan folders under which new ones may be created; a directive for the whole holding allows all."""
    allow = directives.where("allow_creation")
    own = plan.select(*by, "folder").distinct()
    anchored = own.join(allow.where(X.text(F.col("folder")) != "").select(*by, "folder"), [*by, "folder"], "left_semi")
    everywhere = allow.where(X.text(F.col("folder")) == "").groupBy(*by).agg((F.count("*") > 0).alias("all"))
    return anchored.unionByName(with_holding(own, everywhere, by).where("all").select(*by, "folder")).distinct()


def expectations_met(classified: DataFrame, cases: DataFrame, by: By = ()) -> DataFrame:
    """Cases (path, folder, under) with landed and followed: the file stands in that folder, or anywhere below it. Whether one
    folder lies below another is told by their intervals."""
    tree = classified.where("level = 'RecordGrp'").select(*by, "id", "parent_id", F.col("path").alias("name"))
    places = materialise(merged(tree, intervals(tree, by), [*by, "id"]), "folder-intervals")
    files = classified.where("level = 'Item'").select(*by, "path", F.col("parent_id").alias("id"))
    at = merged(files, places.select(*by, "id", F.col("name").alias("landed"), F.col("pre").alias("at")), [*by, "id"], "left").drop("id")
    wanted = places.select(*by, F.col("name").alias("folder"), "pre", "post")
    tried = merged(merged(cases.select(*by, "path", "folder").distinct(), at, [*by, "path"]), wanted, [*by, "folder"])
    met = tried.where("at >= pre AND at < post").select(*by, "path", "folder").distinct().withColumn("below", F.lit(True))
    where = at.groupBy(*by, "path").agg(F.collect_set("landed").alias("landed"))
    out = merged(merged(cases, where, [*by, "path"], "left"), met, [*by, "path", "folder"], "left")
    exact = F.coalesce(F.array_contains("landed", F.col("folder")), F.lit(False))
    return out.withColumn("followed", F.when(F.col("under"), F.coalesce("below", F.lit(False))).otherwise(exact)).drop("below")


def match_subtrees(old: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """(plan_id, on, sig, n_old, n_new): equal subtrees of two plans under one parent (on="parent": renamed) or of one name
    (on="name": moved), as groups with the numbers of both sides. Both: plan_id, path, parent, name, sig."""
    key = ["plan_id", on, "sig"]
    return merged(old.groupBy(*key).agg(F.count("*").alias("n_old")), new.groupBy(*key).agg(F.count("*").alias("n_new")), key)


def verify_copy(preview: DataFrame, listing: DataFrame, by: By = ()) -> DataFrame:
    """Expected target paths with present: whether the listing has them."""
    there = listing.select(*by, F.col("path").alias("target_path")).distinct().withColumn("present", F.lit(True))
    return preview.join(there, [*by, "target_path"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def remap_targets(asg: DataFrame, remap: DataFrame, removed: DataFrame, by: By = ()) -> DataFrame:
    """Targets renamed by (old, new); those of removed folders (folder) are emptied."""
    gone = removed.select(*by, F.col("folder").alias("target")).distinct().withColumn("gone", F.lit(True))
    names = remap.select(*by, F.col("old").alias("target"), "new").dropDuplicates([*by, "target"])
    out = asg.join(names, [*by, "target"], "left").join(gone, [*by, "target"], "left")
    return out.withColumn("target", F.when(F.col("gone"), "").otherwise(F.coalesce("new", "target"))).drop("new", "gone")


def filters_equivalent(inv: DataFrame, f: dict, g: dict) -> bool | None:
    """Whether two filters select the same Items; null if one of them is invalid."""
    try:
        a, b = structured_filter(f), structured_filter(g)
    except ValueError:
        return None
    return items(inv).where(F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False))).isEmpty()


def equivalence(inv: DataFrame, f: dict, g: dict) -> DataFrame:
    """only_first, only_second, both: how many Items each filter selects."""
    a, b = structured_filter(f), structured_filter(g)
    return items(inv).agg(F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(a & b).alias("both"))


