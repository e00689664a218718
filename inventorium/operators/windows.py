"""Operators that depend on the order of rows (pos): numbering, batches, examples, names without clashes, event pairs."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..session import materialise, merged, sized
from .explore import number_rows, with_holding
from .hierarchy import By, items

#: Families of clashing names that are broadcast to the rows; more are joined by a shuffle.
MOST_FAMILIES = 100_000


def assign_ref(inv: DataFrame, by: By = ()) -> DataFrame:
    """Items with ref 1..N in input order."""
    return number_rows(items(inv), ["pos", "path"], "ref", by)


def batch_slices(rows: DataFrame, size: int, by: By = ()) -> DataFrame:
    """Rows with a ref get the number of their batch; size 0 is one batch."""
    return rows.withColumn("batch", F.floor((F.col("ref") - 1) / size) if size else F.lit(0).cast("long"))


def sample_per_folder(inv: DataFrame, n: int, by: By = ()) -> DataFrame:
    """The first n Items of each folder in input order, and all folders; n = 0 keeps everything."""
    if not n:
        return inv
    first = items(inv).withColumn("k", F.row_number().over(Window.partitionBy(*by, "parent_id").orderBy("pos", "path"))).where(F.col("k") <= n).drop("k")
    return inv.where(F.coalesce(F.col("level") != "Item", F.lit(True))).unionByName(first)


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return keep_first(rows, key, [F.desc(o) for o in order])


def diverse_examples(rows: DataFrame, n: int = 12, by: By = ()) -> DataFrame:
    """One correction of each target in input order, then more in input order, n at most (of each holding)."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by, "target").orderBy("pos")))
    if by:
        first = Window.partitionBy(*by).orderBy(F.col("rn") > 1, "pos")
        return ranked.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= n).drop("rn", "__k")
    return ranked.orderBy(F.col("rn") > 1, "pos").limit(n).drop("rn")


def top_ids(inv: DataFrame, by: By = ()) -> DataFrame:
    """(top): the largest identifier of each holding; 100 if some are no integers."""
    number = F.col("id").try_cast("long")
    return inv.groupBy(*by).agg(F.coalesce(F.when(F.count_if(number.isNull()) == 0, F.max(number)), F.lit(100)).alias("top"))


def assign_folder_ids(folders: DataFrame, inv: DataFrame, by: By = ()) -> DataFrame:
    """(folder, id): numbers above the largest identifier, by folder name; from 101 if identifiers are no integers."""
    ranked = number_rows(folders.select(*by, "folder").distinct(), ["folder"], "k", by)
    return with_holding(ranked, top_ids(inv, by), by).select(*by, "folder", (F.col("k") + F.col("top")).cast("string").alias("id"))


def number_within(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """1..n in each group, from one sort of all rows by range, so that a group of any size has many tasks."""
    numbered = materialise(number_rows(rows, [*group, *order], name), "numbered-groups")
    first = numbered.groupBy(*group).agg(F.min(name).alias("__first"))
    return merged(numbered, first, group).withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first")


@dataclass(frozen=True)
class NameStyle:
    """How a name is numbered. ``made``: pattern of a numbered name, whose first group is what it was made from and whose
    second one what stands behind; ``loose``: what is left out to see which names may ever meet."""

    made: str
    loose: str
    before: str
    after: str
    extension: bool


FILE_NAMES = NameStyle(r"^(.*) \([0-9]+\)((?:\.[^.]+)?)$", r" \([0-9]+\)|\.+$", " (", ")", True)
FOLDER_NAMES = NameStyle(r"^(.*)_[0-9]+()$", r"(_[0-9]+)+$", "_", "", False)


def _folded(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("ß"), F.lit("ss"))


def _source_of(name: Column, style: NameStyle) -> Column:
    """What numbers are put behind, and what stands behind them, as one text."""
    if not style.extension:
        return name
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.when(F.contains(name, F.lit(".")), F.concat(stem, F.lit("\n"), ext)).otherwise(F.concat(name, F.lit("\n")))


def _numbered(name: Column, number: Column, style: NameStyle) -> Column:
    mark = F.concat(F.lit(style.before), number.cast("string"), F.lit(style.after))
    if not style.extension:
        return F.concat(name, mark)
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.[^.]+$", 0)
    return F.when(F.contains(name, F.lit(".")), F.concat(stem, mark, ext)).otherwise(F.concat(name, mark))


def _in_turn(style: NameStyle, name: str, order: str):
    """Names of one family in order: a name that is taken gets the first free number."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows, taken, free, out = rows.sort_values(order, kind="stable"), set(), {}, []
        for own in rows[name]:
            made = own
            if _plain_fold(own) in taken:
                stem, dot, ext = own.rpartition(".") if style.extension else (own, "", "")
                base, rest = (stem, f".{ext}" if ext else "") if dot else (own, "")
                key = _plain_fold(f"{base}\n{rest}")
                k = free.get(key, 2)
                while _plain_fold(made := f"{base}{style.before}{k}{style.after}{rest}") in taken:
                    k += 1
                free[key] = k + 1
            taken.add(_plain_fold(made))
            out.append(made)
        rows[name] = out
        return rows

    return settle


def _plain_fold(name: str) -> str:
    return name.lower().replace("ß", "ss")


def dedup_names(rows: DataFrame, folder: str, name: str, order: str = "pos", style: NameStyle = FILE_NAMES, by: By = ()) -> DataFrame:
    """``name`` without case-insensitive clashes in its folder: in the given order, a name that is taken gets the first number
    that is free, stem (2).ext, stem (3).ext.

    Only families of names with a clash are looked at; all other rows pass. Copies of one name are numbered by their place, with
    a sort by range. Where a name that looks numbered already stands among them, that family is settled in turn in one task."""
    key, place = F.col("__key"), [*by, folder]
    keyed = rows.withColumn("__key", _folded(F.col(name)))
    root = F.regexp_replace(key, style.loose, "")
    counts = keyed.groupBy(*place, "__key").agg(F.count("*").alias("n")).where("n > 1")
    clashes = materialise(counts.select(*place, "__key", _source_of(key, style).alias("__source"), root.alias("__root")), "name-clashes")
    if clashes.isEmpty():
        return rows
    made = F.when(key.rlike(style.made), F.concat_ws("\n", F.regexp_extract(key, style.made, 1), F.regexp_replace(F.regexp_extract(key, style.made, 2), r"^\.", "")) if style.extension else F.regexp_extract(key, style.made, 1))
    numbered = keyed.select(*place, made.alias("__source")).where("__source IS NOT NULL").distinct()
    several = clashes.groupBy(*place, "__source").agg(F.count("*").alias("n")).where("n > 1").select(*place, "__source")
    meet = merged(clashes, numbered.unionByName(several).distinct(), [*place, "__source"], "left_semi").select(*place, "__root").distinct().withColumn("__mixed", F.lit(True))
    families = materialise(merged(clashes.select(*place, "__root").distinct(), meet, [*place, "__root"], "left").withColumn("__mixed", F.coalesce("__mixed", F.lit(False))), "name-families")
    placed = keyed.withColumn("__root", root).join(sized(families, MOST_FAMILIES), [*place, "__root"], "left")
    apart = placed.where("__mixed IS NULL").select(*rows.columns)
    alike = number_within(placed.where("NOT __mixed"), [*place, "__key"], [order], "__k")
    alike = alike.withColumn(name, F.when(F.col("__k") == 1, F.col(name)).otherwise(_numbered(F.col(name), F.col("__k"), style))).select(*rows.columns)
    mixed = placed.where("__mixed").groupBy(*place, "__root").applyInPandas(_in_turn(style, name, order), placed.schema).select(*rows.columns)
    return apart.unionByName(alike).unionByName(mixed)


def strip_folder_numbers(classified: DataFrame, by: By = ()) -> DataFrame:
    """Folder names without their numbers; siblings that then clash get _2, _3. Adds renamed."""
    folder = (F.col("level") == "RecordGrp") & (F.col("path") != ".")
    bare = F.regexp_replace(F.col("path"), "^[0-9]+(-[0-9]+)*_", "")
    named = classified.where(folder).withColumn("path", F.when(bare == "", F.col("path")).otherwise(bare))
    done = dedup_names(named.withColumn("__was", F.col("path")), "parent_id", "path", "pos", FOLDER_NAMES, by)
    return classified.where(~folder).withColumn("renamed", F.lit(False)).unionByName(done.withColumn("renamed", F.col("path") != F.col("__was")).drop("__was"))


def number_created(requests: DataFrame, plan: DataFrame, by: By = ()) -> DataFrame:
    """(parent, slug, folder): new sub-folders named prefix-k_slug, k after the highest numbered child, by slug."""
    prefix = F.substring_index("folder", "_", 1)
    kids = plan.select(*by, F.regexp_replace(prefix, "-[0-9]+$", "").alias("prefix"), F.regexp_extract(prefix, "-([0-9]+)$", 1).alias("k")).where("k <> ''").groupBy(*by, "prefix").agg(F.max(F.col("k").cast("long")).alias("top"))
    asked = requests.select(*by, "parent", "slug").distinct().withColumn("prefix", F.substring_index("parent", "_", 1))
    k = F.row_number().over(Window.partitionBy(*by, "parent").orderBy("slug")) + F.coalesce("top", F.lit(0))
    return merged(asked, kids, [*by, "prefix"], "left").select(*by, "parent", "slug", F.concat("prefix", F.lit("-"), k.cast("string"), F.lit("_"), "slug").alias("folder"))


def pair_events(events: DataFrame, run: str = "run_id", case: str = "case_id") -> DataFrame:
    """Each tool result with the call just before it, if that has the same name. Adds call_seq and call_args."""
    order = Window.partitionBy(run, case).orderBy("seq")
    only = events.where(F.col("type").isin("tool", "toolResult"))
    both = only.withColumns({"pt": F.lag("type").over(order), "pn": F.lag("name").over(order), "call_seq": F.lag("seq").over(order), "call_args": F.lag("arguments").over(order)})
    return both.where((F.col("type") == "toolResult") & (F.col("pt") == "tool") & (F.col("pn") == F.col("name"))).drop("pt", "pn")


def redundant_assignments(asg: DataFrame, by: By = ()) -> DataFrame:
    """(path, n): paths assigned more than once; the sum of n - 1 is what is redundant."""
    return asg.groupBy(*by, "path").agg(F.count("*").alias("n")).where("n > 1")


def natural_plan_order(name: Column) -> Column:
    """Sorts numbers as numbers (2_ before 10_), and names without a number last: use with ascending order."""
    prefix = X.number_prefix(name)
    return F.struct((prefix == "").alias("free"), F.when(prefix != "", F.transform(F.split(prefix, "-"), lambda p: p.cast("long"))).alias("numbers"), F.lower(name).alias("name"))


def id_order(id_: Column) -> list[Column]:
    return [id_.try_cast("long").isNull(), id_.try_cast("long"), id_]


def triage_keys() -> dict[str, Column]:
    """Columns to sort a worklist by: duplicates first, together by path; the rest as it was."""
    return {"__single": ~F.col("duplicate"), "__path": F.when(F.col("duplicate"), F.col("path")).otherwise(""), "__pos": F.col("pos")}


def triage_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*triage_keys().values())
