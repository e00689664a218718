"""From assignments to a classified inventory: targets resolved, names repaired, every anomaly kept as a row, folders built
and dated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import materialise, merged, sized
from .checks import validate
from .explore import with_holding
from .hierarchy import By, full_paths, items, needed_folders, over_subtrees
from .joins import unclassified
from .sets import assemble, missing, off_plan
from .windows import assign_folder_ids, dedup_names, diverse_examples, keep_first, number_created, strip_folder_numbers

# Kinds of anomaly with their severity, most severe first.
ANOMALIES = (
    ("nonClasse", "danger"),
    ("cibleInconnue", "danger"),
    ("pathIntrouvable", "danger"),
    ("cibleMalformee", "warning"),
    ("horsPlan", "warning"),
    ("nonRealise", "warning"),
    ("sousDossierCree", "info"),
    ("extension", "info"),
    ("autre", "info"),
)


#: Folders of a plan that are broadcast to the assignments, of which a few folders hold most; more are joined by a shuffle.
MOST_FOLDERS = 100_000


@dataclass
class Classified:
    """rows: the classified inventory; status: a row for each assignment; created: new folders with their parents."""

    rows: DataFrame
    status: DataFrame
    created: DataFrame


def resolve_targets(asg: DataFrame, plan: DataFrame, allowed: DataFrame, by: By = ()) -> tuple[DataFrame, DataFrame]:
    """Assignments with folder, and the folders that they create: (folder, parent).

    A target keeps its last part. If that is no plan folder, but the part before is one where creation is allowed, and the
    last part does not look like a file, a numbered folder is created for it."""
    parts = F.filter(F.transform(F.split(X.text(F.col("target")), r"[/\\]"), lambda p: F.trim(p)), lambda p: p != "")
    leaf = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    above = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    split = asg.withColumns({"leaf": leaf, "above": above})
    known = plan.select(*by, F.col("folder").alias("leaf")).distinct().withColumn("in_plan", F.lit(True))
    may = allowed.join(plan.select(*by, "folder"), [*by, "folder"], "left_semi").select(*by, F.col("folder").alias("above")).distinct().withColumn("may_create", F.lit(True))
    split = split.join(sized(known, MOST_FOLDERS), [*by, "leaf"], "left").join(sized(may, MOST_FOLDERS), [*by, "above"], "left").withColumn("slug", X.slug_created(F.col("leaf")))
    asks = F.col("in_plan").isNull() & F.coalesce("may_create", F.lit(False)) & (F.col("slug") != "") & ~X.looks_like_file(F.col("leaf"))
    split = split.withColumn("asks", asks)
    made = materialise(number_created(split.where("asks").select(*by, F.col("above").alias("parent"), "slug"), plan, by), "created-names")
    names = made.select(*by, F.col("parent").alias("above"), "slug", F.col("folder").alias("made"))
    done = split.join(sized(names, MOST_FOLDERS), [*by, "above", "slug"], "left").withColumn("folder", F.when(F.col("asks"), F.col("made")).otherwise(F.col("leaf")))
    return done.drop("above", "slug", "leaf", "in_plan", "may_create", "asks", "made"), made.select(*by, "folder", "parent")


def fix_extensions(asg: DataFrame) -> DataFrame:
    """Adds fixed_title, with the extension of the source, and extension_fixed."""
    fixed = X.preserve_extension(F.col("new_title"), F.col("path"))
    return asg.withColumns({"fixed_title": fixed, "extension_fixed": X.text(F.col("new_title")) != fixed})


def first_items(inv: DataFrame, by: By = ()) -> DataFrame:
    """The first Item of each path, with its place in ``pos``: what assignments are joined with."""
    slim = items(inv).select(*by, "path", "id", "level", "start_date", "end_date", "pos")
    rest = [c for c in slim.columns if c not in (*by, "path", "pos")]
    return slim.groupBy(*by, "path").agg(F.min_by(F.struct(*rest), "pos").alias("r"), F.min("pos").alias("pos")).select(*by, "path", "r.*", "pos")


def route(resolved: DataFrame, inv: DataFrame, plan: DataFrame, by: By = ()) -> DataFrame:
    """Adds status: malformed, unknown_target, unknown_path, off_plan or ok, and the source's first row as the struct source.
    ``plan`` holds created folders too."""
    source = first_items(inv, by)
    known = source.select(*by, "path", F.struct(*[c for c in source.columns if c not in (*by, "path")]).alias("source"))
    in_plan = plan.select(*by, "folder").distinct().withColumn("in_plan", F.lit(True))
    rows = merged(resolved, known, [*by, "path"], "left").join(sized(in_plan, MOST_FOLDERS), [*by, "folder"], "left")
    missing_path, outside = F.col("source").isNull(), F.col("in_plan").isNull()
    status = F.when(F.trim(X.text(F.col("folder"))) == "", "unknown_target").when(missing_path, "unknown_path").when(outside & X.looks_like_file(F.col("folder")), "malformed").when(outside, "off_plan").otherwise("ok")
    return rows.withColumn("status", status).drop("in_plan")


def build_folders(status: DataFrame, plan: DataFrame, inv: DataFrame, by: By = ()) -> DataFrame:
    """Folder rows of the new tree: those used and all above them; titles from the plan, else from the name."""
    used = status.where(F.col("status").isin("ok", "off_plan")).select(*by, "folder").distinct()
    ids = assign_folder_ids(needed_folders(used, plan.select(*by, "folder", "parent"), by), inv, by)
    known = plan.groupBy(*by, "folder").agg(F.min_by("parent", "pos").alias("parent"), F.min_by("title", "pos").alias("plan_title"))
    parents = ids.select(*by, F.col("folder").alias("parent"), F.col("id").alias("pid"))
    rows = with_holding(merged(merged(ids, known, [*by, "folder"], "left"), parents, [*by, "parent"], "left"), root_ids(inv, by), by)
    return rows.select(*by, "id", F.coalesce("pid", "root_id").alias("parent_id"), F.col("folder").alias("path"), F.lit("RecordGrp").alias("level"), F.coalesce(F.nullif("plan_title", F.lit("")), X.humanize(F.col("folder"))).alias("title"))


def root_ids(inv: DataFrame, by: By = ()) -> DataFrame:
    return inv.where("path = '.'").groupBy(*by).agg(F.min("id").alias("root_id"))


def build_items(status: DataFrame, inv: DataFrame, folders: DataFrame, by: By = ()) -> DataFrame:
    """Item rows of the new tree: attributes of the first source row, which ``route`` found; only parent and title change."""
    placed = status.where(F.col("status").isin("ok", "off_plan", "malformed") & F.col("source").isNotNull())
    places = folders.select(*by, F.col("path").alias("folder"), F.col("id").alias("pid"))
    rows = with_holding(placed.join(sized(places, MOST_FOLDERS), [*by, "folder"], "left"), root_ids(inv, by), by)
    return rows.select(*by, "source.id", F.coalesce("pid", "root_id").alias("parent_id"), "path", "source.level", F.col("fixed_title").alias("title"), "source.start_date", "source.end_date", "source.pos", "apos")


def with_dates(folders: DataFrame, new_items: DataFrame, root: DataFrame, by: By = ()) -> DataFrame:
    """Root and folders with the range of the Items below them; of a path assigned twice, the last assignment counts."""
    start, end = (F.nullif(c, F.lit("")) for c in ("start_date", "end_date"))
    last = new_items.groupBy(*by, "path").agg(F.max_by(F.struct(F.col("parent_id").alias("id"), start.alias("s"), end.alias("e")), "apos").alias("r")).select(*by, "r.*")
    # first by folder, so that what climbs the tree is a row for each folder
    direct = last.groupBy(*by, "id").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    tree = root.select(*by, "id", F.lit("").alias("parent_id")).unionByName(folders.select(*by, "id", "parent_id"))
    spans = over_subtrees(merged(tree, direct, [*by, "id"], "left"), {"s": (F.col("s"), F.min), "e": (F.col("e"), F.max)}, by)
    base = root.select(*by, "id", "parent_id", "path", "level", "title").unionByName(folders)
    dated = {"start_date": F.coalesce("s", F.lit("")), "end_date": F.coalesce("e", F.lit(""))}
    return merged(base, spans, [*by, "id"], "left").withColumns(dated).drop("s", "e")


def finalize(asg: DataFrame, inv: DataFrame, plan: DataFrame, allowed: DataFrame | None = None, strip_numbers: bool = False, by: By = ()) -> Classified:
    """The whole pipeline, over one holding or, with ``by``, over many in the same jobs. The inventory is derived once, and the
    status of assignments, with the source row of each, is written once and feeds all that follows."""
    inv = materialise(inv.select(*by, "id", "parent_id", "path", "level", "title", "start_date", "end_date", "pos"), "source")
    plan = materialise(plan.select(*by, "folder", "parent", "title", "pos"), "plan")
    allowed = plan.select(*by, "folder").limit(0) if allowed is None else allowed
    resolved, created = resolve_targets(asg, plan, allowed, by)
    last = F.lit(1 << 30).cast(plan.schema["pos"].dataType).alias("pos")
    whole = plan.unionByName(created.select(*by, "folder", "parent", X.humanize(F.col("folder")).alias("title"), last))
    status = materialise(route(fix_extensions(resolved), inv, whole, by), "status")
    folders = materialise(build_folders(status, whole, inv, by), "folders")
    new_items = build_items(status, inv, folders, by)
    dirs = with_dates(folders, new_items, inv.where("path = '.'"), by)
    rows = assemble(dirs, new_items.drop("apos")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    return Classified(strip_folder_numbers(rows, by) if strip_numbers else rows, status, created)


def conformity(plan: DataFrame, folders: DataFrame, created: DataFrame, by: By = ()) -> DataFrame:
    """plan_folders, output_folders, off_plan, missing, plan_matches; folders created with permission are no deviation. Each
    folder of either side is a row with the sides that have it."""
    sides = [(plan, 1), (folders, 2), (created, 4)]
    rows = assemble(*[d.select(*by, "folder", F.lit(k).alias("side")) for d, k in sides]).groupBy(*by, "folder").agg(F.bit_or("side").alias("side"))
    planned, out = F.col("side").bitwiseAND(1) > 0, F.col("side").bitwiseAND(6) == 2
    n = {"plan_folders": planned, "output_folders": out, "off_plan": out & ~planned, "missing": planned & ~out}
    counted = rows.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    return counted.withColumn("plan_matches", (F.col("plan_folders") > 0) & (F.col("off_plan") == 0) & (F.col("missing") == 0))


def counters(status: DataFrame, inv: DataFrame, by: By = ()) -> DataFrame:
    """total, classified, unclassified, malformed, extensions_fixed, targets_unknown, paths_not_found, refs_unresolved and
    classified_pct. An assignment by ref whose ref no Item has came back with an empty path."""
    own = status.withColumn("ref", F.col("ref").cast("string")) if "ref" in status.columns else status.withColumn("ref", F.lit(None).cast("string"))
    kinds = [
        items(inv).select(*by, F.lit("item").alias("status")),
        unclassified(inv, status, by).select(*by, F.lit("left").alias("status")),
        own.select(*by, "status", "extension_fixed", (F.col("ref").isNotNull() & (F.trim("path") == "")).alias("lost")),
    ]
    placed = F.col("status").isin("ok", "off_plan", "malformed")
    n = {"total": F.col("status") == "item", "unclassified": F.col("status") == "left", "classified": placed, "malformed": F.col("status") == "malformed", "extensions_fixed": placed & F.col("extension_fixed"), "targets_unknown": F.col("status") == "unknown_target", "paths_not_found": F.col("status") == "unknown_path", "refs_unresolved": F.col("lost")}
    row = assemble(*kinds).groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    return row.withColumn("classified_pct", F.round(F.try_divide(100 * F.col("classified"), F.col("total")), 1))


def anomalies(done: Classified, inv: DataFrame, plan: DataFrame, by: By = ()) -> DataFrame:
    """(category, item, detail, is_item) of everything that is not as it should be."""
    s = done.status

    def rows(df: DataFrame, category: str, item, detail, is_item: bool) -> DataFrame:
        return df.select(*by, F.lit(category).alias("category"), item.alias("item"), X.text(detail).alias("detail"), F.lit(is_item).alias("is_item"))

    p, none = F.col("path"), F.lit("")
    out = done.rows.where("level = 'RecordGrp' AND path <> '.'").select(*by, F.col("path").alias("folder"))
    parts = [
        rows(unclassified(inv, s, by), "nonClasse", p, none, True),
        rows(s.where("status = 'unknown_target'"), "cibleInconnue", p, F.col("target"), True),
        rows(s.where("status = 'unknown_path'"), "pathIntrouvable", p, F.col("target"), False),
        rows(s.where("status = 'malformed'"), "cibleMalformee", p, F.col("target"), True),
        rows(off_plan(plan, out.join(done.created.select(*by, "folder"), [*by, "folder"], "left_anti"), by), "horsPlan", F.col("folder"), none, False),
        rows(missing(plan, out, by), "nonRealise", F.col("folder"), none, False),
        rows(done.created, "sousDossierCree", F.col("folder"), F.col("parent"), False),
        rows(s.where("extension_fixed AND status IN ('ok', 'off_plan', 'malformed')"), "extension", p, F.concat_ws(" → ", "new_title", "fixed_title"), True),
    ]
    return assemble(*parts)


def anomaly_counts(found: DataFrame, by: By = ()) -> DataFrame:
    """(category, severity, rank, n), the most severe first; categories without anomaly are left out."""
    kinds = found.sparkSession.createDataFrame([(c, s, k) for k, (c, s) in enumerate(ANOMALIES)], "category string, severity string, rank int")
    return found.groupBy(*by, "category").agg(F.count("*").alias("n")).join(F.broadcast(kinds), "category").orderBy(*by, "rank")


def copy_preview(done: DataFrame, listing: DataFrame | None = None, by: By = ()) -> DataFrame:
    """Of each Item: source, target folder and name after repair, and whether it was sanitised, renamed, at the root, there."""
    dirs = done.where("level = 'RecordGrp' AND path <> '.'")
    inner = with_holding(dirs, root_ids(done, by), by).select(*by, "id", F.when(F.col("parent_id") == F.col("root_id"), "").otherwise(F.col("parent_id")).alias("parent_id"), "path")
    places = full_paths(inner, "path", by).select(*by, F.col("id").alias("parent_id"), F.col("full_path").alias("folder"))
    files = done.where("level = 'Item'").join(sized(places, MOST_FOLDERS), [*by, "parent_id"], "left").withColumn("folder", F.coalesce("folder", F.lit("")))
    wanted = X.preserve_extension(F.when(X.text(F.col("title")) == "", X.basename(F.col("path"))).otherwise(F.col("title")), F.col("path"))
    named = files.select(*by, "pos", F.col("path").alias("source"), "folder", wanted.alias("wanted"), X.sanitize_filename(wanted).alias("name"))
    named = materialise(named.withColumn("clean", F.col("name")), "copied-names")
    out = dedup_names(named, "folder", "name", "pos", by=by)
    out = out.select(*by, "source", "folder", "name", (F.col("wanted") != F.col("clean")).alias("sanitised"), (F.col("clean") != F.col("name")).alias("renamed"), (F.col("folder") == "").alias("at_root"), F.concat_ws("/", F.nullif("folder", F.lit("")), "name").alias("target_path"))
    if listing is None:
        return out
    there = listing.select(*by, F.col("path").alias("source")).distinct().withColumn("present", F.lit(True))
    return out.join(there, [*by, "source"], "left").withColumn("missing_binary", F.col("present").isNull()).drop("present")


def worklist(asg: DataFrame, inv: DataFrame, query: str = "", issues_only: bool = False, by: By = ()) -> DataFrame:
    """Assignments and the files without one, with unclassified and duplicate; searched by text."""
    n = asg.groupBy(*by, "path").agg((F.count("*") > 1).alias("duplicate"))
    own = asg.select(*by, "path", "target", "new_title", F.col("apos").alias("pos")).join(n, [*by, "path"]).withColumn("unclassified", F.lit(False))
    rest = unclassified(inv, asg, by).select(*by, "path", F.lit("").alias("target"), F.col("title").alias("new_title"), "pos", F.lit(False).alias("duplicate"), F.lit(True).alias("unclassified"))
    rows = own.unionByName(rest)
    if query:
        rows = rows.where(F.contains(X.fold(F.concat_ws(" ", "path", "target", "new_title")), X.fold(F.lit(query))))
    return rows.where("duplicate OR unclassified") if issues_only else rows


def clean_exemplars(asg: DataFrame, plan: DataFrame, n: int = 12, by: By = ()) -> DataFrame:
    """Assignments to plan folders, the first of each path, at most n of different targets."""
    good = asg.join(plan.select(*by, F.col("folder").alias("target")), [*by, "target"], "left_semi")
    return diverse_examples(keep_first(good, [*by, "path"], ["apos"]).withColumn("pos", F.col("apos")), n, by)


def pending_batches(refs: DataFrame, stored: DataFrame, by: By = ()) -> DataFrame:
    """Batches (batch, n) of the slicing that have no stored answer, or an empty one; a stored total that differs from the
    slicing's makes all of them pending."""
    wanted = refs.groupBy(*by, "batch").agg(F.count("*").alias("n"))
    done = stored.where(F.trim(X.text(F.col("raw_text"))) != "").select(*by, "batch", F.col("n_rows").alias("n"))
    return wanted.join(done, [*by, "batch", "n"], "left_anti")


def quality(done: Classified, by: By = ()) -> DataFrame:
    """The quality rules over the classified inventory."""
    return validate(done.rows, True, by)
