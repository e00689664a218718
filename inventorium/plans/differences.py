"""Differences between two states of plans, of any size: nodes are matched level by level, in groups of equal subtrees.

A subtree's signature is an order-free sum over the paths below it, so equal subtrees meet by a join. A folder that is gone and
one that came may be the same folder renamed (same parent and subtree) or moved (same name and subtree). Renames come first.
The parent of a rename is in both states, so no rename lies below another one, and all groups of (parent, signature) are matched
at once. Moves go by levels of the folders that are gone, the highest first, since a match takes its subtrees along on both
sides. Within a level a group waits only while an earlier folder may take a subtree that holds one of its own candidates; then
come the next rounds of the level, mostly one. A group with a choice is matched in order in one task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators.joins import match_subtrees
from ..session import materialise, merged


def subtree_signatures(paths: DataFrame) -> DataFrame:
    """(plan_id, path, parent, name, sig): equal sums for equal subtrees. A subtree is the multiset of the paths below a node,
    so its sum is an order-free aggregate of their hashes, with their count."""
    nodes = paths.select("plan_id", "path", F.explode(X.ancestor_paths(F.col("path"), inclusive=True)).alias("top"))
    inner = F.when(F.col("path") == F.col("top"), "").otherwise(F.expr("substring(path, length(top) + 2)"))
    sig = nodes.groupBy("plan_id", "top").agg(F.concat_ws("-", F.count("*").cast("string"), F.sum(F.xxhash64(inner).cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64(F.concat(F.lit("x"), inner))).cast("string")).alias("sig"))
    above = X.parent_path(F.col("top"))
    return sig.select("plan_id", F.col("top").alias("path"), F.when(above == ".", "").otherwise(above).alias("parent"), X.basename(F.col("top")).alias("name"), "sig")


def _matcher(id_type: str, differ: str):
    """Of each group: every old path in order takes the free new one whose ``differ`` is most like its own."""

    def match(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        def high(row) -> tuple[int, list[str]]:
            return row.path.count("/"), row.path.split("/")

        free, out = sorted(new.itertuples(), key=high), []
        for row in sorted(old.itertuples(), key=high):
            if not free:
                break
            likeness = [SequenceMatcher(None, getattr(row, differ), getattr(r, differ)).ratio() for r in free]
            best = free.pop(max(range(len(free)), key=likeness.__getitem__))
            out.append((key[0], row.path, best.path))
        return pd.DataFrame(out, columns=["plan_id", "old_path", "new_path"])

    return match, f"plan_id {id_type}, old_path string, new_path string"


def _matched(gone: DataFrame, came: DataFrame, same: str, differ: str, what: str) -> DataFrame:
    """(plan_id, old_path, new_path). A group of one folder on each side leaves no choice and is matched by the join that finds
    it; only groups with a choice go through Python, one by one."""
    f, schema = _matcher(gone.schema["plan_id"].dataType.simpleString(), differ)
    key = ["plan_id", same, "sig"]
    old, new = (x.groupBy(*key).agg(F.count("*").alias(f"n_{side}"), F.min("path").alias(f"{side}_path")) for x, side in ((gone, "old"), (came, "new")))
    groups = materialise(merged(old, new, key), f"{what}-groups")
    plain = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    pairs, chosen = groups.where(plain).select("plan_id", "old_path", "new_path"), groups.where(~plain).select(*key)
    if chosen.isEmpty():
        return pairs
    many = [_in_groups(x, chosen, key).groupBy(*key) for x in (gone, came)]
    return materialise(pairs.unionByName(many[0].cogroup(many[1]).applyInPandas(f, schema)), what)


def _without(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` without the nodes of ``taken`` (plan_id, path) and all below them."""
    above = rows.select("plan_id", "path", F.explode(X.ancestor_paths(F.col("path"), inclusive=True)).alias("top"))
    hit = merged(above, taken.withColumnRenamed("path", "top"), ["plan_id", "top"], "left_semi").select("plan_id", "path").distinct()
    return materialise(merged(rows, hit, ["plan_id", "path"], "left_anti"), "unmatched-folders")


def _in_groups(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    return merged(rows, groups.select(*key).distinct(), key, "left_semi")


def _blocked(waiting: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """(group, blocked): the first folder of other groups that may take a subtree around one of a group's candidates."""
    first = waiting.groupBy(*key).agg(F.min("place").alias("first"))
    held = merged(candidates.select(*key, "path"), first, key).select("plan_id", F.col("path").alias("top"), "first")
    above = candidates.select(*key, F.explode(X.ancestor_paths(F.col("path"))).alias("top"))
    return merged(above, held, ["plan_id", "top"]).groupBy(*key).agg(F.min("first").alias("blocked"))


def _moves(gone: DataFrame, came: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Matches of one round each, and what is left on both sides."""
    key, found = ["plan_id", "name", "sig"], []
    depth = X.depth(F.col("path"))
    levels = [r.d for r in _in_groups(gone, match_subtrees(gone, came, "name"), key).select(depth.alias("d")).distinct().orderBy("d").collect()]
    for level in levels:
        waiting = gone.where(depth == level).withColumn("place", F.split("path", "/"))
        while True:
            waiting = materialise(_in_groups(waiting, came, key), "waiting-folders")
            if waiting.isEmpty():
                break
            candidates = materialise(_in_groups(came, waiting, key), "candidate-folders")
            ready = merged(waiting, _blocked(waiting, candidates, key), key, "left").where("blocked IS NULL OR place < blocked")
            ready = materialise(ready.select(*waiting.columns), "ready-folders")
            match = _matched(ready, candidates, "name", "parent", "moves")
            found.append(match)
            waiting = merged(waiting, ready.select("plan_id", "path"), ["plan_id", "path"], "left_anti")
            gone = _without(gone, match.select("plan_id", F.col("old_path").alias("path")))
            came = _without(came, match.select("plan_id", F.col("new_path").alias("path")))
    return found, gone, came


def diff_plans(old: DataFrame, new: DataFrame) -> DataFrame:
    """(plan_id, old_path, new_path, change) between two states (plan_id, path) of each plan: unchanged, renamed, moved,
    removed, added. Nodes below a match are not listed."""
    a, b = (materialise(subtree_signatures(d), "signatures") for d in (old, new))
    node = ["plan_id", "path"]
    gone, came = (materialise(merged(x, y.select(*node), node, "left_anti"), "changed-folders") for x, y in ((a, b), (b, a)))
    both = merged(a.select(*node), b.select(*node), node, "left_semi").select("plan_id", F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.lit("unchanged").alias("change"))
    renames = _matched(gone, came, "parent", "name", "renames")
    gone = _without(gone, renames.select("plan_id", F.col("old_path").alias("path")))
    came = _without(came, renames.select("plan_id", F.col("new_path").alias("path")))
    found, gone, came = _moves(gone, came)
    none = F.lit(None).cast("string")
    out = both.unionByName(renames.withColumn("change", F.lit("renamed")))
    for match in found:
        out = out.unionByName(match.withColumn("change", F.lit("moved")))
    out = out.unionByName(gone.select("plan_id", F.col("path").alias("old_path"), none.alias("new_path"), F.lit("removed").alias("change")))
    return out.unionByName(came.select("plan_id", none.alias("old_path"), F.col("path").alias("new_path"), F.lit("added").alias("change")))


def summaries(changes: DataFrame) -> DataFrame:
    """Of each plan: how many folders are unchanged, renamed, moved, removed and added, and whether its states are identical."""
    kinds = ("unchanged", "renamed", "moved", "removed", "added")
    counts = changes.groupBy("plan_id").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    return counts.withColumn("identical", sum(F.col(k) for k in kinds[1:]) == 0)
