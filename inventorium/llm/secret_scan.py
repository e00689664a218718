"""Secret scans over a ledger of blobs: every version of a text is addressed by the SHA-256 of its content, only pairs of a
blob and a rule version that the ledger lacks are scanned, and findings are joined back to all paths that hold the blob.

The scan uses SQL functions only. Positions come from splitting a text at a rule's matches: a match starts after the gaps and
matches before it. The ledger is a Parquet folder with a row for each scanned (blob, rule, version) that found something, and
one row with an empty rule for the blob and the versions scanned.

Defined results: a null text is an empty one. Repeated rows get a row each; equal texts are scanned once. Spans are code
points, end exclusive, by start and then by the order of the rules. An empty table gives no rows. Other columns of the input
are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, new_path, path_exists, table

# What counts as a secret.
_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = f"((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?({_VALUE}+)"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are found leftmost first and do not overlap; one whose ``group`` has fewer than ``least``
    characters is dropped and not retried. ``needs``: a text without any of these strings has no match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()
    base: bool = False


#: A hexadecimal run or an access key is matched whole, so asking for its length in the pattern drops the same matches.
RULES = (
    Rule("assign", 1, _ASSIGN, 2, 6, base=True),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", needs=("AKIA",), base=True),
    Rule("hex", 1, "[0-9a-f]{24,}", base=True),
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", needs=("-----BEGIN ",)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyJ",)),
    Rule("forge_token", 1, "gh[oprsu]_[A-Za-z0-9]{36,}", needs=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("chat_token", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
)

_FOUND = "kind string, version int, start long, end long"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _matches(rule: Rule, text: Column, todo: Column) -> Column:
    """Null, or the rule's matches: arrays of the matched strings, of the group that is measured, and of the gaps."""
    wanted = F.array_contains(todo, f"{rule.kind}@{rule.version}")
    for k, need in enumerate(rule.needs):
        here = text.contains(need)
        some = here if not k else some | here
    if rule.needs:
        wanted = wanted & some
    pattern = F.lit(rule.pattern)
    return F.when(
        wanted & F.rlike(text, pattern),
        F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.version).alias("version"),
            F.lit(rule.least).alias("least"),
            F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("hits"),
            F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("measured"),
            F.transform(F.split(text, rule.pattern, -1), F.length).alias("gaps"),
        ),
    )


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs`` (blob, text, todo) to (blob, kind, version, start, end): the findings of the rule versions in ``todo``."""
    per_rule = F.filter(F.array(*[_matches(r, F.col("text"), F.col("todo")) for r in rules]), lambda x: x.isNotNull())
    some = blobs.select("blob", F.explode(per_rule).alias("m"))
    each = some.select("blob", "m.kind", "m.version", "m.least", F.posexplode(F.arrays_zip(F.col("m.hits").alias("hit"), F.col("m.measured").alias("measured"), F.col("m.gaps").alias("gap"))).alias("k", "x"))
    each = each.where("x.hit IS NOT NULL").select("blob", "kind", "version", "least", "k", "x.hit", "x.measured", "x.gap").distinct()
    before = Window.partitionBy("blob", "kind", "version").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("hit")).cast("long")).over(before)
    return each.withColumn("end", end).where("measured >= least").select("blob", "kind", "version", (F.col("end") - F.col("hit")).alias("start"), "end")


def scan_history(history: DataFrame, ledger_path: str, path_col: str = "path", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at ``ledger_path`` has not seen and appends it there. One row per row of ``history`` comes back:
    path, blob, and its findings as an array of (kind, version, start, end) by start and order of the rules."""
    spark = history.sparkSession
    rows = history.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", blob_of(F.col("text")))
    paths = rows.select("path", "blob")
    wanted = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    # One path of each blob stands for it; hashing both keeps the copies of one text in different tasks.
    heads = paths.groupBy("blob").agg(F.min(F.struct(F.xxhash64("path").alias("h"), F.col("path").isNull().alias("none"))).alias("head")).select("blob", F.col("head.h").alias("h"))
    if path_exists(spark, f"{ledger_path}/scanned"):
        done = spark.read.parquet(f"{ledger_path}/scanned").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))
        heads = heads.hint("merge").join(done.hint("merge"), "blob", "left")
        todo = F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>")))
    else:
        todo = wanted
    heads = heads.select("blob", "h", todo.alias("todo")).where(F.size("todo") > 0)
    new_path_ = new_path(spark, "new-blobs")
    heads.write.parquet(new_path_)
    unseen = spark.read.schema(heads.schema).parquet(new_path_)
    texts = rows.withColumn("h", F.xxhash64("path")).hint("shuffle_hash").join(unseen.hint("shuffle_hash"), ["blob", "h"]).select("blob", "text", "todo")
    scan_blobs(texts, rules).write.mode("append").parquet(f"{ledger_path}/found")
    unseen.select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger_path}/scanned")
    found = spark.read.schema(f"blob string, {_FOUND}").parquet(f"{ledger_path}/found")
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    current = found.where(F.array_contains(wanted, F.concat_ws("@", "kind", "version")))
    per_blob = current.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "version", "end"))).alias("found"))
    per_blob = materialise(per_blob, "blob-findings")  # apart from the join, which Spark may then split where a blob has many paths
    empty = F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,version:int,end:bigint>>")
    return paths.hint("merge").join(per_blob.hint("merge"), "blob", "left").select("path", "blob", F.coalesce("found", empty).alias("found"))


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans, and all spans as text."""
    base = [r.kind for r in rules if r.base]

    def as_text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("found", lambda s: s["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(F.col("path").alias("doc_id"), *map(count, base), F.sha2(as_text(own), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))


def op6_secrets(spark, sf_dir):
    """Secrets in every document, over a new ledger."""
    return digest(scan_history(table(spark, sf_dir, "documents"), new_path(spark, "secret-ledger"), "doc_id"))


def _oracle() -> str:
    kinds = ", ".join(f"('{r.kind}', {k}, {str(r.base).lower()})" for k, r in enumerate(RULES))
    parts = []
    for r in RULES:
        pattern = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {r.group}) AS measured, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(kind, rank, base) AS (VALUES {kinds}),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT doc_id, kind, least, k, length(hits[k]) AS hit, length(measured[k]) AS measured, length(gaps[k]) AS gap FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM m)),
s AS (SELECT *, sum(gap + hit) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop FROM e),
f AS (SELECT doc_id, kind, rank, base, stop - hit AS start, kind || ':' || CAST(stop - hit AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM s JOIN kinds USING (kind) WHERE measured >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(span, ',' ORDER BY start, rank) FILTER (base) AS b, string_agg(span, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP6_SQL = _oracle()
