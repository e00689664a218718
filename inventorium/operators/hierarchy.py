"""Operators over the tree of an inventory, which its paths and its parent identifiers both carry.

An inventory has the columns id, parent_id, path, level, title, start_date, end_date (all strings) and pos, the order of the
input. ``by`` names columns that tell several holdings in one table apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..session import materialise, merged

By = tuple[str, ...]


def items(inv: DataFrame) -> DataFrame:
    return inv.where(F.col("level") == "Item")


def folders(inv: DataFrame) -> DataFrame:
    """Folders without the root."""
    return inv.where((F.col("level") == "RecordGrp") & (F.col("path") != "."))


def level_split(inv: DataFrame) -> tuple[DataFrame, DataFrame]:
    return items(inv), folders(inv)


def with_ancestors(inv: DataFrame) -> DataFrame:
    """A row for each Item and folder above it, the root ('.') included."""
    above = F.concat(F.array(F.lit(".")), X.ancestor_paths(F.col("path")))
    return items(inv).withColumn("folder", F.explode(above))


def ancestors(tree: DataFrame, inclusive: bool = True, by: By = ()) -> DataFrame:
    """(path, ancestor, distance) of every node, from its path."""
    chain = F.reverse(X.ancestor_paths(F.col("path"), inclusive=inclusive))
    return tree.select(*by, "path", F.posexplode(chain).alias("distance", "ancestor"))


def closure_by_id(tree: DataFrame, by: By = ()) -> DataFrame:
    """(id, ancestor, distance) from parent identifiers alone, by pointer doubling: a chain of n nodes takes log2(n) joins.
    Cycles end where a node would meet itself."""
    step = tree.where((F.col("parent_id") != "") & (F.col("parent_id") != F.col("id"))).select(*by, "id", F.col("parent_id").alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct()
    known = tree.select(*by, F.col("id").alias("ancestor")).distinct()
    reach = merged(step, known, [*by, "ancestor"], "left_semi").select(*by, "id", "ancestor", "distance")
    size = -1
    while True:
        reach = materialise(reach, "closure")
        now = reach.count()
        if now == size:
            return reach
        size = now
        far = reach.select(*by, F.col("id").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("more"))
        longer = merged(reach, far, [*by, "ancestor"]).where(F.col("top") != F.col("id")).select(*by, "id", F.col("top").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        reach = reach.unionByName(longer).groupBy(*by, "id", "ancestor").agg(F.min("distance").alias("distance"))


def _pointers(tree: DataFrame, values: dict[str, Column], by: By) -> DataFrame:
    """(id, up, values): each node once, with a pointer to its parent; null at the top and where the parent is no node."""
    nodes = tree.select(*by, "id", F.when((F.col("parent_id") != "") & (F.col("parent_id") != F.col("id")), F.col("parent_id")).alias("up"), *[v.alias(n) for n, v in values.items()]).dropDuplicates([*by, "id"])
    known = nodes.select(*by, F.col("id").alias("up"), F.lit(True).alias("known"))
    rows = merged(nodes, known, [*by, "up"], "left")
    return rows.select(*by, "id", F.when(F.col("known"), F.col("up")).alias("up"), *values)


def along_path(tree: DataFrame, values: dict[str, tuple[Column, Callable[[Column, Column], Column]]], by: By = ()) -> DataFrame:
    """(id, values): each value combined along the nodes from the top down to a node, by a function of (above, own). Pointers
    jump twice as far each round and take along what they pass, so a round has a row for each node and a tree of depth d takes
    log2(d) rounds. Nodes on a cycle, or below one, keep their own value."""
    names = list(values)
    rows = _pointers(tree, {n: v for n, (v, _) in values.items()}, by)
    rows = materialise(rows.withColumns({f"__own_{n}": F.col(n) for n in names}), "path-pointers")
    for _ in range(max(1, rows.count()).bit_length() + 1):
        moving = rows.where("up IS NOT NULL")
        if moving.isEmpty():
            break
        target = rows.select(*by, F.col("id").alias("up"), F.col("up").alias("__next"), *[F.col(n).alias(f"__above_{n}") for n in names])
        jumped = merged(moving, target, [*by, "up"]).select(*by, "id", F.col("__next").alias("up"), *[combine(F.col(f"__above_{n}"), F.col(n)).alias(n) for n, (_, combine) in values.items()], *[f"__own_{n}" for n in names])
        rows = materialise(jumped.unionByName(rows.where("up IS NULL")), "path-pointers")
    return rows.select(*by, "id", *[F.when(F.col("up").isNull(), F.col(n)).otherwise(F.col(f"__own_{n}")).alias(n) for n in names])


def over_subtrees(tree: DataFrame, values: dict[str, tuple[Column, Callable[[Column], Column]]], by: By = ()) -> DataFrame:
    """(id, values): each value aggregated (sum, min, max) over a node and all below it. In round k a node has what lies less
    than 2^k below it and hands that to the node 2^k above, where it begins; so a round has a row for each node, and sums count
    nothing twice. On cycles only minima and maxima are defined."""
    names = list(values)
    rows = materialise(_pointers(tree, {n: v for n, (v, _) in values.items()}, by), "subtree-pointers")
    for _ in range(max(1, rows.count()).bit_length() + 1):
        moving = rows.where("up IS NOT NULL")
        if moving.isEmpty():
            break
        handed = moving.select(*by, F.col("up").alias("id"), F.lit(None).cast("string").alias("up"), *names)
        summed = rows.unionByName(handed).groupBy(*by, "id").agg(F.max("up").alias("up"), *[f(F.col(n)).alias(n) for n, (_, f) in values.items()])
        target = rows.select(*by, F.col("id").alias("up"), F.col("up").alias("__next"))
        rows = materialise(merged(summed, target, [*by, "up"], "left").select(*by, "id", F.col("__next").alias("up"), *names), "subtree-pointers")
    return rows.drop("up")


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over the rows before each one, in a sort by range; each partition adds the sums of those before."""
    at = F.spark_partition_id()
    parts = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": at, "__at": F.monotonically_increasing_id()}), "running-sum")
    sums = parts.groupBy("__part").agg(F.sum(value).alias("n"))
    starts = sums.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each partition of the sort
    return parts.withColumn(name, inner).join(F.broadcast(starts), "__part").withColumn(name, F.col(name) + F.col("__start")).drop("__part", "__at", "__start")


def intervals(tree: DataFrame, by: By = ()) -> DataFrame:
    """(id, pre, post, depth): places in a walk from the top, children by id. A node lies below another one if its ``pre`` lies
    between that one's ``pre`` and ``post``; roots follow one another. A row for each node, whatever the depth."""
    sizes = over_subtrees(tree, {"size": (F.lit(1).cast("long"), F.sum)}, by)
    rows = merged(_pointers(tree, {}, by), sizes, [*by, "id"]).withColumn("__parent", F.coalesce("up", F.lit("")))
    # sizes of the siblings before: a sum over all rows, less that at the first sibling
    placed = running_sum(rows, [*by, "__parent", "id"], "size", "before")
    first = placed.groupBy(*by, "__parent").agg(F.min("before").alias("first"))
    own = materialise(merged(placed, first, [*by, "__parent"]).select(*by, "id", F.coalesce("up", F.lit("")).alias("parent_id"), "size", (F.col("before") - F.col("first")).alias("offset")), "sibling-offsets")
    inner = F.when(F.col("parent_id") == "", F.col("offset")).otherwise(F.col("offset") + 1)
    placed = along_path(own, {"pre": (inner, lambda above, own_: above + own_), "depth": (F.lit(0).cast("long"), lambda above, own_: above + own_ + 1)}, by)
    return merged(placed, sizes, [*by, "id"]).select(*by, "id", "pre", (F.col("pre") + F.col("size")).alias("post"), "depth")


def full_paths(tree: DataFrame, name: str = "title", by: By = ()) -> DataFrame:
    """(id, full_path): the chain of names from the top, from parent identifiers."""
    return along_path(tree, {"full_path": (X.text(F.col(name)), lambda above, own: F.concat(above, F.lit("/"), own))}, by)


def rollup_dates(inv: DataFrame, by: By = ()) -> DataFrame:
    """(folder, start_date, end_date): the range of all Items below each folder, empty dates ignored."""
    start, end = F.nullif("start_date", F.lit("")), F.nullif("end_date", F.lit(""))
    return with_ancestors(inv).groupBy(*by, "folder").agg(F.coalesce(F.min(start), F.lit("")).alias("start_date"), F.coalesce(F.max(end), F.lit("")).alias("end_date"))


def nonempty_folders(inv: DataFrame, by: By = ()) -> DataFrame:
    return with_ancestors(inv).where("folder <> '.'").select(*by, "folder").distinct()


def _folder_label() -> Column:
    base = X.basename(F.col("path"))
    return F.when(X.text(F.col("title")) != "", F.col("title")).when(base != "", base).otherwise("(sans titre)")


def empty_folders(inv: DataFrame, examples: int = 5, by: By = ()) -> DataFrame:
    """One row (for each holding): n_empty and the first labels in input order."""
    full = nonempty_folders(inv, by).withColumnRenamed("folder", "path")
    empty = merged(folders(inv), full, [*by, "path"], "left_anti")
    return _first_labels(empty.select(*by, "pos", _folder_label().alias("label")), examples, by, "n_empty", inv)


def _first_labels(rows: DataFrame, k: int, by: By, count: str, inv: DataFrame) -> DataFrame:
    """Counts, and the labels of the first k rows by pos; only those k of each group are gathered. Holdings of the inventory
    without any row have zero and no examples."""
    if by:
        first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("pos", "label"))).where(F.col("nth") <= k)
    else:
        first = rows.orderBy("pos", "label").limit(k)
    shown = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), " | ").alias("examples"))
    total = rows.groupBy(*by).agg(F.count("*").alias(count))
    if not by:
        return total.crossJoin(F.broadcast(shown))  # one row
    every = merged(merged(inv.select(*by).distinct(), total, list(by), "left"), shown, list(by), "left")
    return every.select(*by, F.coalesce(count, F.lit(0)).alias(count), F.coalesce("examples", F.lit("")).alias("examples"))


def has_cycle(tree: DataFrame, by: By = ()) -> DataFrame:
    """has_cycle, in one row, or one for each holding. Every node's pointer jumps twice as far each round, until none is left;
    one that still points at a node after log2(n) + 1 rounds lies on a cycle or leads to one."""
    nodes = tree.select(*by, "id", F.nullif("parent_id", F.lit("")).alias("up")).dropDuplicates([*by, "id"])
    nodes = materialise(nodes, "pointers")
    rounds = max(1, nodes.count()).bit_length() + 1
    for _ in range(rounds):
        if nodes.where("up IS NOT NULL").isEmpty():
            break
        above = nodes.select(*by, F.col("id").alias("up"), F.col("up").alias("next"), F.lit(True).alias("known"))
        # a pointer to no node ends there
        jumped = nodes.where("up IS NOT NULL").hint("merge").join(above.hint("merge"), [*by, "up"], "left").select(*by, "id", F.when(F.col("known"), F.col("next")).alias("up"))
        nodes = materialise(jumped.unionByName(nodes.where("up IS NULL").select(*by, "id", "up")), "pointers")
    return nodes.groupBy(*by).agg(F.coalesce(F.bool_or(F.col("up").isNotNull()), F.lit(False)).alias("has_cycle"))


def max_depth(inv: DataFrame, by: By = ()) -> DataFrame:
    return inv.groupBy(*by).agg(F.coalesce(F.max(X.depth(F.col("path"))), F.lit(0)).alias("max_depth"))


def descendant_counts(inv: DataFrame, by: By = ()) -> DataFrame:
    return with_ancestors(inv).groupBy(*by, "folder").agg(F.count("*").alias("n_items"))


def files_per_folder(inv: DataFrame, parent: str = ".", most: int = 20, by: By = ()) -> DataFrame:
    """(folder, n_items) of the first direct sub-folders of a folder, what lies below them included; of each holding."""
    sub = folders(inv).where(X.fold(X.parent_path(F.col("path"))) == X.fold(F.lit(parent))).select(*by, F.col("path").alias("folder"))
    if by:
        sub = sub.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("folder"))).where(F.col("__k") <= most).drop("__k")
    else:
        sub = sub.orderBy("folder").limit(most)
    return merged(sub, descendant_counts(inv, by), [*by, "folder"], "left").select(*by, "folder", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def list_folder(inv: DataFrame, path: str = ".", page: int = 0, size: int = 20, by: By = ()) -> DataFrame:
    """kind, name, n_items, title: direct sub-folders with the files below them, then a page of direct files. Of many holdings
    those that have the folder give theirs."""
    from .explore import paginate

    known = folders(inv).where(X.fold(F.col("path")) == X.fold(F.lit(path))).limit(1)
    if path != "." and known.isEmpty():
        near = [r.path for r in folders(inv).where(X.fold(F.col("path")).contains(F.lit(path.lower()))).select("path").distinct().orderBy("path").limit(5).collect()]
        raise ValueError(f"no folder {path!r}; near: {near}")
    subs = files_per_folder(inv, path, by=by).select(*by, F.lit("folder").alias("kind"), F.col("folder").alias("name"), "n_items", F.lit(None).cast("string").alias("title"))
    direct = items(inv).where(X.fold(X.parent_path(F.col("path"))) == X.fold(F.lit(path)))
    files = paginate(direct, page, size, by).select(*by, F.lit("file").alias("kind"), F.col("path").alias("name"), F.lit(1).cast("long").alias("n_items"), "title")
    return subs.unionByName(files)


def needed_folders(targets: DataFrame, tree: DataFrame, by: By = ()) -> DataFrame:
    """The plan folders that targets (folder) refer to, with all above them. ``tree``: folder, parent."""
    used = targets.select(*by, F.col("folder").alias("id")).distinct()
    nodes = tree.select(*by, F.col("folder").alias("id"), F.coalesce("parent", F.lit("")).alias("parent_id"))
    marked = merged(nodes, used.withColumn("used", F.lit(1)), [*by, "id"], "left")
    below = over_subtrees(marked, {"used": (F.coalesce("used", F.lit(0)), F.max)}, by).where("used > 0")
    return used.unionByName(below.select(*by, "id")).distinct().select(*by, F.col("id").alias("folder"))


def plan_shape(plan: DataFrame) -> DataFrame:
    """Of each plan (plan_id, folder, parent): folders, depth, max_children, leaves; roots are children of nothing."""
    nodes = plan.select("plan_id", F.col("folder").alias("id"), F.coalesce("parent", F.lit("")).alias("parent_id"))
    depths = along_path(nodes, {"d": (F.lit(1).cast("long"), lambda above, own: above + own)}, ("plan_id",))
    deep = merged(nodes, depths, ["plan_id", "id"], "left").groupBy("plan_id").agg(F.count("*").alias("folders"), F.max("d").alias("depth"))
    kids = nodes.groupBy("plan_id", "parent_id").agg(F.count("*").alias("n"))
    wide = kids.groupBy("plan_id").agg(F.max("n").alias("max_children"))
    leaves = merged(nodes, kids.where("parent_id <> ''").select("plan_id", F.col("parent_id").alias("id")), ["plan_id", "id"], "left_anti").groupBy("plan_id").agg(F.count("*").alias("leaves"))
    return merged(merged(deep, wide, "plan_id"), leaves, "plan_id", "left").select("plan_id", "folders", "depth", "max_children", F.coalesce("leaves", F.lit(0)).alias("leaves"))
