"""Inventories from separated files, directory listings and other dialects; fingerprints; the manifest of a classified tree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import materialise, merged, sized
from .records import read_csv

# Column names outside, and inside Spark, where names have no dots.
COLUMNS = {
    "ID": "id",
    "ParentID": "parent_id",
    "File": "path",
    "Content.DescriptionLevel": "level",
    "Content.Title": "title",
    "Content.StartDate": "start_date",
    "Content.EndDate": "end_date",
    "Content.Description": "description",
    "Content.Fingerprint": "fingerprint",
}
_CORE = list(COLUMNS.values())[:7]


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The most frequent of ; , and tab in the first line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    return max(";,\t", key=line.count)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, canonical names, dialects normalised, null as empty; pos rises in the order of the rows, and
    over several files in that of the files' names first. Large files are read by many tasks, line breaks in fields or not."""
    raw = read_csv(spark, path, sniff_separator(spark, path))
    return normalize_native(raw)


def normalize_native(raw: DataFrame) -> DataFrame:
    """Canonical columns, then any others. Id and ParentId count in any case; ObjectFiles fills an empty File; a table without
    a root path gives it to the rows without parent; backslashes become slashes; if an identifier is no integer, all are
    numbered by first appearance, and unknown parents stay. Does nothing to a canonical table."""
    cols = {c.lower(): c for c in raw.columns}
    names = {}
    for outside, inside in COLUMNS.items():
        if inside not in raw.columns and outside.lower() in cols:
            names[cols[outside.lower()]] = inside
    df = raw.select(*[F.col(f"`{c}`").alias(names.get(c, c.replace(".", "_"))) for c in raw.columns])
    if "pos" not in df.columns:
        df = df.withColumn("pos", F.monotonically_increasing_id())
    if "ObjectFiles" in df.columns:
        path = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.col("ObjectFiles")) if "path" in df.columns else F.col("ObjectFiles")
        df = df.withColumn("path", path).drop("ObjectFiles")
    missing = {c: F.lit("") for c in _CORE if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    df = df.withColumns({c: X.text(F.col(c)) for c in strings})
    flags = df.agg(F.count_if(F.col("path") == ".").alias("roots"), F.count_if(F.col("id").try_cast("long").isNull()).alias("texts")).first()
    path = F.translate("path", "\\", "/")
    df = df.withColumn("path", path if flags.roots else F.when(F.col("parent_id") == "", ".").otherwise(path))
    if flags.texts:
        from ..operators.explore import number_rows

        first = df.groupBy("id").agg(F.min("pos").alias("pos"))
        numbers = number_rows(first, ["pos", "id"], "n").select("id", F.col("n").cast("string").alias("new_id"))
        parents = numbers.select(F.col("id").alias("parent_id"), F.col("new_id").alias("new_parent"))
        df = df.join(numbers, "id").join(parents, "parent_id", "left").withColumns({"id": F.col("new_id"), "parent_id": F.coalesce("new_parent", "parent_id")}).drop("new_id", "new_parent")
    rest = [c for c in df.columns if c not in _CORE]
    return df.select(*_CORE, *rest)


def write_inventory(inv: DataFrame, path: str) -> None:
    """Semicolons, every field quoted, outside column names; one holding's table fits a file, larger ones give several."""
    outside = {v: k for k, v in COLUMNS.items()}
    inv.drop("pos").select(*[F.col(c).alias(outside.get(c, c)) for c in inv.columns if c != "pos"]).write.option("sep", ";").option("quoteAll", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path, header=True)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, date, size) of the files below a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    top = re.sub("^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/") + "/"
    rel = F.split_part(F.col("path"), F.lit(top), F.lit(-1))
    return files.select(F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("path"), F.date_format("modificationTime", "yyyy-MM-dd").alias("date"), F.col("length").alias("size"))


def inventory_of_listing(files: DataFrame) -> DataFrame:
    """Canonical rows of a listing (path, date): root 1, then folders, then files, each by path; hidden, lock and system names
    are left out with all below them; folder dates span their files."""
    from ..operators.explore import number_rows

    hidden: Column = F.exists(F.split("path", "/"), X.is_hidden_or_noise)
    kept = files.where(~hidden)
    spans = kept.select(F.explode(F.concat(F.array(F.lit(".")), X.ancestor_paths(F.col("path")))).alias("path"), "date").groupBy("path").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    dirs = spans.select("path", F.lit("RecordGrp").alias("level"), "start_date", "end_date", F.when(F.col("path") == ".", 0).otherwise(1).alias("rank"))
    rows = dirs.unionByName(kept.select("path", F.lit("Item").alias("level"), F.col("date").alias("start_date"), F.col("date").alias("end_date"), F.lit(2).alias("rank")))
    numbered = number_rows(rows, ["rank", "path"], "n").withColumn("id", F.col("n").cast("string"))
    parents = numbered.where("level = 'RecordGrp'").select(F.col("path").alias("above"), F.col("id").alias("parent_id"))
    out = numbered.withColumn("above", X.parent_path(F.col("path"))).join(parents, "above", "left")
    title = F.when(F.col("level") == "Item", X.title_from_name(F.col("path"))).otherwise(F.translate(X.basename(F.col("path")), "_", " "))
    return out.select("id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "path", "level", title.alias("title"), "start_date", "end_date", F.col("n").alias("pos"))


def folder_inventory(spark: SparkSession, root: str) -> DataFrame:
    return inventory_of_listing(listing(spark, root))


def fingerprint(inv: DataFrame, files: DataFrame, overwrite: bool = False) -> DataFrame:
    """Items with the SHA-256 of their content, and fingerprint_status: hashed, already, missing or skipped (folders).
    ``files``: path, content (binary)."""
    df = inv if "fingerprint" in inv.columns else inv.withColumn("fingerprint", F.lit(""))
    sums = files.groupBy(X.slashed(F.col("path")).alias("path")).agg(F.min(F.sha2("content", 256)).alias("__sum"))
    has = F.trim(X.text(F.col("fingerprint"))) != ""
    status = F.when(F.col("level") != "Item", "skipped").when(has & F.lit(not overwrite), "already").when(F.col("__sum").isNull(), "missing").otherwise("hashed")
    out = df.join(sums, "path", "left").withColumn("fingerprint_status", status)
    return out.withColumn("fingerprint", F.when(F.col("fingerprint_status") == "hashed", F.col("__sum")).otherwise(F.col("fingerprint"))).drop("__sum")


def manifest(classified: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Directories (path, name, title, level, dates) and items (directory, path, name, source, dates) of a classified tree. The
    name of an item is its title, and its path is where it will stand."""
    from ..operators.classify import MOST_FOLDERS, root_ids
    from ..operators.explore import with_holding
    from ..operators.hierarchy import full_paths

    dirs = classified.where("level = 'RecordGrp' AND path <> '.'")
    tree = with_holding(dirs, root_ids(classified, by), by).withColumn("parent_id", F.when(F.col("parent_id") == F.col("root_id"), "").otherwise(F.col("parent_id")))
    paths = materialise(full_paths(tree.select(*by, "id", "parent_id", "path"), "path", by), "directory-paths")
    listed = merged(dirs, paths, [*by, "id"]).select(*by, F.col("full_path").alias("path"), F.col("path").alias("name"), "title", "level", "start_date", "end_date")
    above = paths.select(*by, F.col("id").alias("parent_id"), "full_path")
    files = classified.where("level = 'Item'").join(sized(above, MOST_FOLDERS), [*by, "parent_id"], "left")
    directory, name = F.coalesce("full_path", F.lit("")), X.text(F.col("title"))
    shown = F.concat_ws("/", F.nullif(directory, F.lit("")), name)
    return listed, files.select(*by, directory.alias("directory"), shown.alias("path"), name.alias("name"), F.col("path").alias("source"), "start_date", "end_date")


def write_manifest(classified: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Directories in the order of a walk by name, and items by directory, name and source, as JSON lines; and the summary."""
    from ..operators.runs import manifest_summary

    dirs, files = manifest(classified, by)
    dirs.orderBy(*by, F.split("path", "/")).write.json(f"{path}/directories")
    files.orderBy(*by, F.split("directory", "/"), "name", "source").write.json(f"{path}/items")
    manifest_summary(classified, by).write.json(f"{path}/summary")
