"""Filing plans: text to tables and back, numbering and comparison.

Texts are (plan_id, text); parsed plans (plan_id, pos, folder, parent, title); nodes (plan_id, id, parent_id, title, slug)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..operators.explore import number_rows
from ..operators.hierarchy import along_path, full_paths, plan_shape
from ..operators.joins import plan_parents, rubrics
from ..operators.runs import plan_ranges
from ..operators.sets import all_folders
from ..operators.windows import id_order
from ..session import materialise, merged

_ARROW = r"\s*(?:→|->)\s*"
_FOLDER = r"([\p{L}\p{N}_][\p{L}\p{N}_-]*)/"
#: The name of the place for a root in a plan's text, which is no folder itself.
ROOT_NAME = "Dossier_racine"


def plan_lines(texts: DataFrame) -> DataFrame:
    """(plan_id, pos, folder, title) of the lines that name a folder, within the block after its heading if there is one."""
    whole = X.text(F.col("text"))
    headed = F.when(whole.rlike(r"[Aa]rborescence\s+technique"), F.regexp_replace(whole, r"(?s)^.*?[Aa]rborescence\s+technique", "")).otherwise(whole)
    block = F.regexp_replace(headed, r"(?s)[Pp]r[ée]conisation.*$", "")
    lines = texts.select("plan_id", F.posexplode(F.split(block, "\n")).alias("pos", "line"))
    parts = F.split(F.col("line"), _ARROW)
    folder = F.regexp_extract(F.element_at(parts, -1), _FOLDER, 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(F.element_at(parts, 1), r"^[│├└─\s]+", ""), r"^[0-9]+(?:\.[0-9]+)*\.?\s*", ""))
    rows = lines.select("plan_id", "pos", folder.alias("folder"), F.when(F.size(parts) > 1, title).otherwise("").alias("title"))
    return rows.where((F.instr("folder", "_") > 0) & (F.col("folder") != ROOT_NAME))


def plan_main_root(parents: DataFrame) -> DataFrame:
    """Parents where the first root with a word of two letters or more in front adopts all other roots."""
    prefix = F.substring_index("folder", "_", 1)
    named = parents.where(F.col("parent").isNull() & ~prefix.rlike("^[0-9]") & (F.length(prefix) > 1))
    main = named.groupBy("plan_id").agg(F.min_by("folder", "pos").alias("main"))
    out = merged(parents, main, "plan_id", "left")
    return out.withColumn("parent", F.when(F.col("parent").isNull() & (F.col("folder") != F.col("main")), F.col("main")).otherwise(F.col("parent"))).drop("main")


def parse_plans(texts: DataFrame) -> DataFrame:
    """(plan_id, pos, folder, parent, title); a folder that is named twice counts once, at its first place."""
    lines = plan_lines(texts)
    first = lines.groupBy("plan_id", "folder").agg(F.min("pos").alias("pos"), F.coalesce(F.max_by("title", F.when(F.col("title") != "", F.col("pos"))), F.lit("")).alias("title"))
    first = materialise(first, "plan-folders")  # texts are read once; what follows are joins of short rows
    parents = plan_main_root(plan_parents(first.select("plan_id", "pos", "folder")))
    return merged(parents, first.select("plan_id", "folder", "title"), ["plan_id", "folder"]).select("plan_id", "pos", "folder", "parent", "title")


def parse_titles(texts: DataFrame) -> DataFrame:
    return parse_plans(texts).where("title <> ''").select("plan_id", "folder", "title")


def plan_nodes(texts: DataFrame) -> DataFrame:
    """Nodes of plan texts, with the name without its number as slug and a title from the text or the name."""
    p = parse_plans(texts)
    return p.select("plan_id", F.col("folder").alias("id"), F.coalesce("parent", F.lit("")).alias("parent_id"), F.when(F.col("title") != "", F.col("title")).otherwise(X.humanize(F.col("folder"))).alias("title"), X.strip_prefix(F.col("folder")).alias("slug"), "pos")


def plan_from_inventory(inv: DataFrame, plan_id: str = "inventory") -> DataFrame:
    """Nodes from the folder rows of an inventory, siblings in the order of their identifiers; those whose parent is no folder
    stand at the top."""
    rows = inv.where("level = 'RecordGrp' AND path <> '.'")
    ids = rows.select(F.col("id").alias("parent_id")).distinct().withColumn("known", F.lit(True))
    base = X.strip_prefix(X.basename(F.col("path")))
    slug = X.slugify(F.when(base != "", base).otherwise(F.col("title")))
    keys = {f"__o{k}": c for k, c in enumerate(id_order(F.col("id")))}
    out = number_rows(merged(rows, ids, "parent_id", "left").drop("pos").withColumns(keys), [*keys], "pos")
    return out.select(F.lit(plan_id).alias("plan_id"), "id", F.when(F.col("known"), F.col("parent_id")).otherwise("").alias("parent_id"), F.when(X.text(F.col("title")) != "", F.col("title")).otherwise(X.humanize(X.basename(F.col("path")))).alias("title"), slug.alias("slug"), "pos")


def plan_import_report(inv: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """folder_count, ignored_items and root_title of a plan that is made from an inventory; Items are ignored."""
    folder = F.col("level") == "RecordGrp"
    root = folder & (F.trim("path") == ".") & (X.text(F.col("parent_id")) == "")
    title = F.coalesce(F.max(F.when(root, F.nullif(F.trim(X.text(F.col("title"))), F.lit("")))), F.lit("Plan de classement"))
    return inv.groupBy(*by).agg(F.count_if(folder & ~root).alias("folder_count"), F.count_if(F.col("level") == "Item").alias("ignored_items"), title.alias("root_title"))


def _placed(nodes: DataFrame) -> DataFrame:
    """Nodes with numbers, the positions of a node and those above it among their siblings by pos, and lasts, whether each of
    these is the last one."""
    order = Window.partitionBy("plan_id", "parent_id").orderBy("pos", "id")
    ranked = materialise(nodes.withColumns({"k": F.row_number().over(order), "last": F.lead("id").over(order).isNull()}), "ranked-nodes")

    def joined(above, own):
        return F.concat(above, own)

    chain = along_path(ranked, {"numbers": (F.array("k"), joined), "lasts": (F.array("last"), joined)}, ("plan_id",))
    return merged(ranked.select(*nodes.columns), chain, ["plan_id", "id"])


def _with_number(placed: DataFrame) -> DataFrame:
    number = F.array_join(F.transform("numbers", lambda n: n.cast("string")), "-")
    return placed.withColumn("number", number).withColumn("folder", F.concat_ws("_", "number", "slug"))


def plan_numbering(nodes: DataFrame) -> DataFrame:
    """Nodes with number ('1-2'), the positions of a node and those above it among their siblings by pos, and folder."""
    return _with_number(_placed(nodes)).drop("lasts")


# How a plan is drawn, and the heading and fence of its block.
ROOT_TITLE = "[Nom du fonds]"
SEPARATOR, INDENT, BRANCH, LAST, UNDER_BRANCH, UNDER_LAST = "  │", "  ", "├──", "└──", "│     ", "      "
BLOCK_HEADER = "**Arborescence technique** *(chaque dossier porte son titre descriptif puis son nom technique, séparés par « → » ; dossiers uniquement, jamais de fichiers individuels)* **:**"


def _safe_title(title) -> Column:
    return F.trim(F.regexp_replace(X.text(title), _ARROW, " - "))


def render_plans(nodes: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(plan_id, text): an outline with glyphs, numbers, titles and names, which parse_plans reads back. The root's line comes
    first, with its title (``titles``: plan_id, title) if there is one, and a bar before each folder of the first level. Below a
    folder that has siblings to follow runs a bar; below the last one there is none."""
    placed = _with_number(_placed(nodes))
    above = F.transform(F.slice("lasts", 1, F.size("lasts") - 1), lambda last: F.when(last, UNDER_LAST).otherwise(UNDER_BRANCH))
    glyph = F.concat(F.lit(INDENT), F.array_join(above, ""), F.when(F.element_at("lasts", -1), LAST).otherwise(BRANCH))
    number = F.concat(F.array_join(F.transform("numbers", lambda n: n.cast("string")), "."), F.lit("."))
    line = F.concat(glyph, F.lit(" "), number, F.lit(" "), _safe_title(F.col("title")), F.lit(" → "), F.col("folder"), F.lit("/"))
    rows = placed.select("plan_id", "numbers", F.when(F.size("numbers") == 1, F.concat(F.lit(SEPARATOR + "\n"), line)).otherwise(line).alias("line"))
    body = rows.groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("numbers", "line"))), lambda x: x["line"]), "\n").alias("body"))
    named = merged(body, titles.select("plan_id", _safe_title(F.col("title")).alias("root")), "plan_id", "left") if titles is not None else body.withColumn("root", F.lit(""))
    root = F.concat(F.lit("Fonds — "), F.coalesce(F.nullif("root", F.lit("")), F.lit(ROOT_TITLE)), F.lit(f" → {ROOT_NAME}/\n"))
    return named.select("plan_id", F.concat(root, "body").alias("text"))


def plan_blocks(rendered: DataFrame) -> DataFrame:
    """(plan_id, text): rendered plans under their heading, in a fence, as a document of their own."""
    return rendered.select("plan_id", F.concat(F.lit(f"{BLOCK_HEADER}\n\n```text\n"), "text", F.lit("\n```")).alias("text"))


def plan_paths(plan: DataFrame) -> DataFrame:
    """(plan_id, folder, path): the whole path of every folder, names without numbers."""
    nodes = plan.select("plan_id", F.col("folder").alias("id"), F.coalesce("parent", F.lit("")).alias("parent_id"), X.strip_prefix(F.col("folder")).alias("name"))
    return full_paths(nodes, "name", ("plan_id",)).select("plan_id", F.col("id").alias("folder"), F.col("full_path").alias("path"))


def rubric_labels(plan: DataFrame) -> DataFrame:
    """(plan_id, label) without a single root that has children."""
    return rubrics(plan, ("plan_id",)).select("plan_id", X.semantic_label(F.col("folder")).alias("label"))


def compare_variants(plans: DataFrame) -> dict[str, DataFrame]:
    shapes = plan_shape(plans)
    return {"shapes": shapes, "ranges": plan_ranges(shapes), "folders": all_folders(plans)}
