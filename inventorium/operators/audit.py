"""Measures of an inventory: volumes, formats, noise, repeated names, binary duplicates, empty folders, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..session import materialise
from .explore import beside, most, topk
from .hierarchy import By, _first_labels, _folder_label, empty_folders, folders, items, nonempty_folders


#: What the measures derive from a path. ``prepared`` adds these columns once, and every measure uses them where they are.
_DERIVED = {"__ext": X.extension, "__name": X.basename, "__depth": X.depth, "__noise": X.noise_kind}


def prepared(inv: DataFrame) -> DataFrame:
    """The inventory with what the measures derive from a path."""
    return inv.withColumns({name: of(F.col("path")) for name, of in _DERIVED.items()})


def _derived(inv: DataFrame, name: str) -> Column:
    return F.col(name) if name in inv.columns else _DERIVED[name](F.col("path"))


def volumetry(inv: DataFrame, by: By = ()) -> DataFrame:
    depth = _derived(inv, "__depth")
    return inv.groupBy(*by).agg(F.count_if(F.col("level") == "Item").alias("items"), F.count_if(F.col("level") == "RecordGrp").alias("folders"), F.count("*").alias("all_rows"), F.coalesce(F.max(depth), F.lit(0)).alias("max_depth"))


def top_formats(inv: DataFrame, k: int = 10, by: By = ()) -> DataFrame:
    """(extension, n, distinct_extensions)."""
    ext = _derived(inv, "__ext")
    counts = items(inv).groupBy(*by, F.when(ext == "", "(sans extension)").otherwise(ext).alias("extension")).agg(F.count("*").alias("n"))
    return beside(most(counts, "extension", k, by), counts.groupBy(*by).agg(F.count("*").alias("distinct_extensions")), by)


def _formats(inv: DataFrame, wanted: tuple[str, ...], by: By) -> DataFrame:
    ext = _derived(inv, "__ext")
    return items(inv).where(ext.isin(*wanted)).groupBy(*by, ext.alias("extension")).agg(F.count("*").alias("n"))


def risky_formats(inv: DataFrame, by: By = ()) -> DataFrame:
    return _formats(inv, X.RISKY_EXTENSIONS, by)


def compressed_formats(inv: DataFrame, by: By = ()) -> DataFrame:
    return _formats(inv, X.COMPRESSED_EXTENSIONS, by)


def noise(inv: DataFrame, by: By = ()) -> DataFrame:
    """(kind, n) of lock files, system files and temporary files."""
    return items(inv).withColumn("kind", _derived(inv, "__noise")).where("kind IS NOT NULL").groupBy(*by, "kind").agg(F.count("*").alias("n"))


def noise_examples(inv: DataFrame, k: int = 5, by: By = ()) -> DataFrame:
    found = items(inv).where(_derived(inv, "__noise").isNotNull()).select(*by, "pos", F.col("path").alias("label"))
    return _first_labels(found, k, by, "n_noise", inv)


def name_collisions(inv: DataFrame, min_n: int = 2, by: By = ()) -> DataFrame:
    """(name, n, first_path) of the names, case folded, that several Items have; noise left out. One pass: each task sends a
    count and a first path for each of its names."""
    real = items(inv).where(_derived(inv, "__noise").isNull()).withColumn("name", F.lower(F.trim(_derived(inv, "__name")))).where("name <> ''")
    counts = real.groupBy(*by, "name").agg(F.count("*").alias("n"), F.min(F.struct("pos", "path")).alias("first")).where(F.col("n") >= min_n)
    return counts.select(*by, "name", "n", F.col("first.path").alias("first_path"))


def name_collision_totals(inv: DataFrame, by: By = ()) -> DataFrame:
    names = items(inv).where(_derived(inv, "__noise").isNull()).select(*by, F.lower(F.trim(_derived(inv, "__name"))).alias("name")).where("name <> ''")
    several = F.col("n") >= 2
    return names.groupBy(*by, "name").agg(F.count("*").alias("n")).groupBy(*by).agg(F.count_if(several).alias("groups"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("files"))


def strict_duplicates(inv: DataFrame, by: By = ()) -> DataFrame:
    """(fingerprint, n, names): Items with equal content. Names are at most four, the first by name, kept by a bounded
    aggregate of distinct names per fingerprint."""
    fp = F.lower(F.trim(X.text(F.col("fingerprint"))))
    own = items(inv).withColumn("fp", fp).where("fp <> ''")
    counts = own.groupBy(*by, "fp").agg(F.count("*").alias("n")).where("n >= 2")
    named = own.select(*by, "fp", X.basename(F.col("path")).alias("name")).distinct()
    first = named.withColumn("k", F.row_number().over(Window.partitionBy(*by, "fp").orderBy("name"))).where("k <= 4")
    names = first.groupBy(*by, "fp").agg(F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("names"))
    return counts.join(names, [*by, "fp"]).select(*by, F.substring("fp", 1, 12).alias("fingerprint"), "n", "names")


def strict_duplicate_totals(inv: DataFrame, by: By = ()) -> DataFrame:
    """groups, files, redundant, available; without fingerprints, available is false and the rest zero."""
    if "fingerprint" not in inv.columns:
        none = [F.lit(0).cast("long").alias(c) for c in ("groups", "files", "redundant")]
        holdings = inv.select(*by).distinct() if by else inv.sparkSession.range(1)
        return holdings.select(*by, *none, F.lit(False).alias("available"))
    fp = F.lower(F.trim(X.text(F.col("fingerprint"))))
    counts, several = items(inv).where(fp != "").groupBy(*by, fp.alias("fp")).agg(F.count("*").alias("n")), F.col("n") >= 2
    groups, files = F.count_if(several), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0))
    return counts.groupBy(*by).agg(groups.alias("groups"), files.alias("files"), (files - groups).alias("redundant"), F.lit(True).alias("available"))


def source_folders(inv: DataFrame, by: By = ()) -> DataFrame:
    """(path, label, non_empty) of every folder but the root."""
    full = nonempty_folders(inv, by).withColumnRenamed("folder", "path").withColumn("non_empty", F.lit(True))
    return folders(inv).select(*by, "path", _folder_label().alias("label")).hint("merge").join(full.hint("merge"), [*by, "path"], "left").withColumn("non_empty", F.coalesce("non_empty", F.lit(False)))


def structure(inv: DataFrame, by: By = ()) -> DataFrame:
    """root_items and their share, folders with an order number in front, folder count."""
    is_item = F.col("level") == "Item"
    n_items = F.count_if(is_item)
    at_root = F.count_if(is_item & (_derived(inv, "__depth") == 1))
    folder = (F.col("level") == "RecordGrp") & (F.col("path") != ".")
    return inv.groupBy(*by).agg(
        at_root.alias("root_items"),
        F.coalesce(F.round(F.try_divide(100 * at_root, n_items), 1), F.lit(0.0)).alias("root_items_pct"),
        F.count_if(folder & F.trim(_derived(inv, "__name")).rlike(r"^[0-9]+[\s._)-]")).alias("prefixed_folders"),
        F.count_if(folder).alias("folder_count"),
    )


def crowded_folders(inv: DataFrame, k: int = 5, by_path: bool = False, by: By = ()) -> DataFrame:
    """(folder, n): the folders with most direct files, by name, or by path."""
    name: Column = X.parent_path(F.col("path")) if by_path else F.try_element_at(X.segments(F.col("path")), F.lit(-2))
    return topk(items(inv).where(_derived(inv, "__depth") >= 2).select(*by, name.alias("folder")), "folder", k, by)


def scan_counts(inv: DataFrame, by: By = ()) -> DataFrame:
    """(measure, key, n, folders, below, depth, first): all that the measures of a scan count, from one pass and one shuffle. Each
    row gives its part to each measure, and these parts are summed by measure and key before they leave a task."""
    item, path = F.col("level") == "Item", F.col("path")
    folder = (F.col("level") == "RecordGrp") & (path != ".")
    ext, name, depth, kind = (F.col(c) for c in _DERIVED)
    fingerprint = F.lower(F.trim(X.text(F.col("fingerprint")))) if "fingerprint" in inv.columns else F.lit("")
    plain = F.lower(F.trim(name))

    def part(measure: str, key, when, label=None) -> Column:
        first = F.struct(F.col("pos"), (label if label is not None else F.lit("")).alias("label"))
        return F.when(when, F.struct(F.lit(measure).alias("measure"), key.alias("key"), first.alias("first")))

    parts = [
        part("row", X.text(F.col("level")), F.lit(True)),
        part("format", F.when(ext == "", "(sans extension)").otherwise(ext), item),
        part("noise", kind, item & kind.isNotNull()),
        part("noise_path", path, item & kind.isNotNull(), path),
        part("name", plain, item & kind.isNull() & (plain != "")),
        part("fingerprint", fingerprint, item & (fingerprint != "")),
        part("at_root", F.lit(""), item & (depth == 1)),
        part("crowd", F.try_element_at(X.segments(path), F.lit(-2)), item & (depth >= 2)),
        part("prefixed", F.lit(""), folder & F.trim(name).rlike(r"^[0-9]+[\s._)-]")),
        part("folder", path, folder, _folder_label()),
    ]
    none = F.array().cast("array<struct<measure:string,key:string,first:struct<pos:bigint,label:string>>>")
    above = F.when(item, F.transform(X.ancestor_paths(path), lambda p: F.struct(F.lit("folder").alias("measure"), p.alias("key"), F.lit(None).cast("struct<pos:bigint,label:string>").alias("first")))).otherwise(none)
    wide = prepared(inv.withColumn("pos", F.col("pos").cast("long")))
    each = wide.select(*by, depth.alias("depth"), F.explode(F.concat(F.filter(F.array(*parts), lambda x: x.isNotNull()), above)).alias("p"))
    own = F.col("p.first").isNotNull()
    return each.groupBy(*by, "p.measure", "p.key").agg(F.count("*").alias("n"), F.count_if(own).alias("own"), F.count_if(~own).alias("below"), F.max("depth").alias("depth"), F.min("p.first").alias("first"))


def scan_report(inv: DataFrame, by: By = (), formats: int = 10, crowded: int = 5, examples: int = 5) -> DataFrame:
    """(measure, key, n, pct): all measures of an inventory, or of each holding, as rows. The inventory is read once; what comes
    after reads its counts, which are written to the shared folder. Examples have their rank as n; without fingerprints there
    are no duplicates to count, which ``available`` tells."""
    counts = materialise(scan_counts(inv, by), "scan-counts")
    m, n = F.col("measure"), F.col("n")

    def total(when) -> Column:
        return F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long")

    several, folder = n >= 2, m == "folder"
    item_rows = total((m == "row") & (F.col("key") == "Item"))
    own = F.coalesce(F.sum(F.when(folder, F.col("own"))), F.lit(0)).cast("long")
    full = F.coalesce(F.sum(F.when(folder & (F.col("below") > 0), F.col("own"))), F.lit(0)).cast("long")
    repeated, groups = total((m == "fingerprint") & several), F.count_if((m == "fingerprint") & several)
    numbers = {
        ("volumetry", "items"): item_rows,
        ("volumetry", "folders"): total((m == "row") & (F.col("key") == "RecordGrp")),
        ("volumetry", "all_rows"): total(m == "row"),
        ("volumetry", "max_depth"): F.coalesce(F.max(F.when(m == "row", F.col("depth"))), F.lit(0)).cast("long"),
        ("top_formats", "distinct_extensions"): F.count_if(m == "format"),
        ("name_collisions", "groups"): F.count_if((m == "name") & several),
        ("name_collisions", "files"): total((m == "name") & several),
        ("strict_duplicates", "groups"): groups,
        ("strict_duplicates", "files"): repeated,
        ("strict_duplicates", "redundant"): repeated - groups,
        ("strict_duplicates", "available"): F.lit(int("fingerprint" in inv.columns)).cast("long"),
        ("empty_folders", "n_empty"): own - full,
        ("source_folders", "folders"): own,
        ("source_folders", "non_empty"): full,
        ("structure", "root_items"): total(m == "at_root"),
        ("structure", "prefixed_folders"): total(m == "prefixed"),
        ("structure", "folder_count"): own,
    }
    pct = F.coalesce(F.round(F.try_divide(100 * total(m == "at_root"), item_rows), 1), F.lit(0.0))
    wide = counts.groupBy(*by).agg(*[c.alias(f"__{k}") for k, c in enumerate(numbers.values())], pct.alias("__pct"))
    named = [F.struct(F.lit(a).alias("measure"), F.lit(b).alias("key"), F.col(f"__{k}").alias("n"), (F.col("__pct") if b == "root_items" else F.lit(None).cast("double")).alias("pct")) for k, (a, b) in enumerate(numbers)]
    out = wide.select(*by, F.explode(F.array(*named)).alias("r")).select(*by, "r.*")
    none = F.lit(None).cast("double").alias("pct")

    def listed(rows: DataFrame, measure: str) -> DataFrame:
        return rows.select(*by, F.lit(measure).alias("measure"), "key", "n", none)

    def first(rows: DataFrame, measure: str) -> DataFrame:
        """The first labels, with their ranks."""
        order = Window.partitionBy(*by).orderBy("first")
        some = rows if by else rows.orderBy("first").limit(examples)
        ranked = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= examples)
        return ranked.select(*by, F.lit(measure).alias("measure"), F.col("first.label").alias("key"), F.col("k").cast("long").alias("n"), none)

    of = {k: counts.where(m == k) for k in ("format", "noise", "crowd", "folder", "noise_path")}
    parts = [
        listed(most(of["format"], "key", formats, by), "top_formats"),
        listed(of["format"].where(F.col("key").isin(*X.RISKY_EXTENSIONS)), "risky_formats"),
        listed(of["format"].where(F.col("key").isin(*X.COMPRESSED_EXTENSIONS)), "compressed_formats"),
        listed(of["noise"], "noise"),
        listed(most(of["crowd"], "key", crowded, by), "crowded_folders"),
        first(of["folder"].where("own > 0 AND below = 0"), "empty_folder_examples"),
        first(of["noise_path"], "noise_examples"),
    ]
    for part in parts:
        out = out.unionByName(part)
    return out
