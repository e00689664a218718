"""Plans, raw answers, corrections, directives, cases, reports and the ledger of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import merged


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(plan_id, text, kind) of plan files: folders if the name ends in .csv, or its first line has semicolons and no arrow;
    else markdown."""
    files = spark.read.text(path, wholetext=True).select(X.basename(F.input_file_name()).alias("plan_id"), F.col("value").alias("text"))
    first = F.substring_index("text", "\n", 1)
    table = (X.extension(F.col("plan_id")) == "csv") | (F.contains(first, F.lit(";")) & ~F.contains(first, F.lit("→")))
    return files.withColumn("kind", F.when(table, "folders").otherwise("markdown"))


def usable_plans(plans: DataFrame) -> DataFrame:
    """Markdown plans without any folder are rejected."""
    from ..plans.plans import plan_lines

    good = plan_lines(plans.where("kind = 'markdown'")).select("plan_id").distinct()
    return plans.where("kind = 'folders'").unionByName(merged(plans.where("kind = 'markdown'"), good, "plan_id", "left_semi"))


#: Separators of answers, in the order in which they are looked for.
_SEPARATORS = (";", ",", "\t")


def _fields(line: Column, sep: str) -> Column:
    """The fields of a line, trimmed; quoted ones may hold the separator, and doubled quotes stand for one."""
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(sep + r'("(?:[^"]|"")*"|[^' + sep + "]*)"), F.lit(1))
    bare = lambda f: F.when(F.startswith(F.trim(f), F.lit('"')), F.replace(F.regexp_replace(F.trim(f), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(raw, lambda f: F.trim(bare(f)))


def ingest_responses(responses: DataFrame, id_col: str = "Path") -> DataFrame:
    """(batch_id, line, path or ref, target, new_title) of raw answers (batch_id, raw_text).

    The last fenced block counts, or the whole text; lines or keys in brackets are marks and dropped. A batch is separated by
    semicolons, commas or tabs, whichever its header has, or any of its lines if it has none, in that order; a line without
    the separator is prose. Fields are found by the names of the header, and by position without one; missing fields are
    empty, extra ones cut off. One job over all batches."""
    name = "ref" if id_col.lower() == "ref" else "path"
    wanted = (id_col.lower(), "targetfolder", "newtitle")
    text = F.regexp_replace(X.text(F.col("raw_text")), "\ufeff|\r", "")
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```[A-Za-z]*[ \t]*\n(.*?)```"), F.lit(1))
    block = F.filter(F.split(F.coalesce(F.try_element_at(fences, F.lit(-1)), text), "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("```")))
    names = lambda line, sep: F.transform(_fields(line, sep), F.lower)
    is_header = lambda line: F.regexp_replace(F.lower(line), '[ "]', "").rlike("(^|[;,\t])targetfolder([;,\t]|$)")
    batches = responses.select("batch_id", block.alias("block"))
    batches = batches.withColumn("header", F.try_element_at(F.filter("block", is_header), F.lit(1)))
    shown = F.coalesce(F.col("header"), F.array_join("block", " "))
    sep = F.coalesce(*[F.when(F.contains(shown, F.lit(s)), s) for s in _SEPARATORS])
    batches = batches.withColumn("sep", sep).where("sep IS NOT NULL")

    def by_sep(value) -> Column:
        return F.coalesce(*[F.when(F.col("sep") == s, value(s)) for s in _SEPARATORS])

    found = F.array(*[F.array_position(F.col("names"), w) for w in wanted])
    batches = batches.withColumn("names", by_sep(lambda s: names(F.col("header"), s)))
    places = F.when(F.col("header").isNull(), F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>")).when(found[0] > 0, found).otherwise(F.array(F.lit(1).cast("bigint"), found[1], found[2]))
    lines = batches.select("batch_id", "sep", places.alias("places"), F.posexplode("block").alias("line", "raw"))
    lines = lines.where(~is_header(F.col("raw")) & F.contains("raw", F.col("sep"))).withColumn("f", by_sep(lambda s: _fields(F.col("raw"), s)))

    def field(k: int) -> Column:
        at = F.col("places")[k]
        return F.when(at > 0, X.text(F.try_element_at("f", at.cast("int")))).otherwise("")

    rows = lines.select("batch_id", "line", field(0).alias(name), field(1).alias("target"), field(2).alias("new_title"))
    return rows.where((F.col(name) != "") & ~F.col(name).rlike(r"^\[.*\]$"))


def normalise_corrections(raw: DataFrame) -> DataFrame:
    """(path, target, new_title, pos): trimmed, those with a path and a target; names in camel or snake case."""
    aliases = {"path": "path", "targetfolder": "target", "target_folder": "target", "newtitle": "new_title", "new_title": "new_title"}
    names = {c: aliases[c.lower()] for c in raw.columns if c.lower() in aliases}
    if lacking := {"path", "target", "new_title"} - set(names.values()):
        raise ValueError(f"corrections lack {sorted(lacking)}")
    rows = raw.select(*[F.trim(X.text(F.col(c))).alias(n) for c, n in names.items()], *([F.col("pos")] if "pos" in raw.columns else [F.monotonically_increasing_id().alias("pos")]))
    return rows.where("path <> '' AND target <> ''")


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return normalise_corrections(spark.read.csv(path, header=True, sep=";", quote='"', escape='"'))


def parse_directives(lines: DataFrame) -> DataFrame:
    """(pos, folder, text, allow_creation) of lines (pos, value): 'name_of_folder: text' is anchored if the name has an
    underscore and no space; [+sous-dossiers] allows new sub-folders; # starts a comment."""
    flag = "[+sous-dossiers]"
    own = F.trim(X.text(F.col("value")))
    rows = lines.where((own != "") & ~own.startswith("#"))
    body = F.trim(F.replace(own, F.lit(flag), F.lit("")))
    head = F.trim(F.regexp_extract(body, r"^([^:]*?)\s*:", 1))
    anchored = F.contains(head, F.lit("_")) & ~head.rlike(r"\s")
    return rows.select("pos", F.when(anchored, head).otherwise("").alias("folder"), F.when(anchored, F.trim(F.regexp_replace(body, r"^[^:]*:", ""))).otherwise(body).alias("text"), F.contains(own, F.lit(flag)).alias("allow_creation"))


def read_directives(spark: SparkSession, path: str) -> DataFrame:
    from .records import in_file_order

    return parse_directives(in_file_order(spark.read.text(path)))


def read_eval_reports(spark: SparkSession, path: str) -> DataFrame:
    """A row for each run of reports stored as JSON, with the report's date and label."""
    reports = spark.read.option("multiLine", True).json(path)
    return reports.select("generatedAt", "label", F.explode("runs").alias("run")).select("generatedAt", "label", "run.*")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, question, expected) of a corpus that is a list, or an object with cases; missing ids become cas-N."""
    raw = spark.read.text(path, wholetext=True)
    kind = "array<struct<id:string,question:string,attendu:string>>"
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.cases"), kind), F.from_json("value", kind))
    rows = raw.select(F.posexplode(listed).alias("k", "c"))
    out = rows.select(F.coalesce("c.id", F.concat(F.lit("cas-"), (F.col("k") + 1).cast("string"))).alias("case_id"), F.col("c.question").alias("question"), F.col("c.attendu").alias("expected"))
    return out.where("question IS NOT NULL AND expected IS NOT NULL")


def append_ledger(runs: DataFrame, path: str) -> None:
    """Appends run records by day; a failure without anomalies gets one of its own."""
    one = F.array(F.struct(F.lit("autre").alias("category"), F.col("run_id").alias("item"), F.coalesce("error", F.lit("failed")).alias("detail")))
    failed = (F.col("outcome") == "failed") & (F.coalesce(F.size("anomalies"), F.lit(0)) <= 0)
    runs.withColumns({"anomalies": F.when(failed, one).otherwise(F.col("anomalies")), "day": F.to_date("started_at")}).write.mode("append").partitionBy("day").parquet(path)
