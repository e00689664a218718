"""Scores of reports, classifications, directives and agent runs against what was expected."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import scalars as X
from ..plans.plans import parse_plans
from ..session import materialise, merged
from .audit import volumetry
from .explore import checked_filter
from .hierarchy import By, plan_shape
from .joins import conservation, expectations_met
from .postings import bitmaps, compared, totals
from .runs import agent_run_metrics
from .windows import pair_events


def audit_metrics(reports: DataFrame, inv: DataFrame | None = None, brief: bool = False) -> DataFrame:
    """Of each report (report_id, text): length, the sections it has and whether all, the verdict, whether a plan was found, in a
    marked block, and its shape; against the source, whether the volumes it states are right (null if it states none) and how
    many of the source's folders with content its plan retains and how many it creates (null without a plan). A brief report has
    no sections to look for, and without ``inv`` there is nothing to compare with."""
    text = X.text(F.col("text"))
    parts = reports.select("report_id", F.length(text).alias("chars"), F.contains(text, F.lit(X.PLAN_MARKS[0])).alias("structure_block"), X.gabarit_sections(F.col("text")).alias("sections"), X.order_verdict(F.col("text")).alias("verdict"), X.volumetry_line(F.col("text")).alias("v"), X.report_sections(F.col("text")).alias("r"))
    parts = materialise(parts, "report-parts")
    plans = materialise(parse_plans(parts.select(F.col("report_id").alias("plan_id"), F.col("r.plan").alias("text"))), "report-plans")
    rows = merged(parts, plan_shape(plans).withColumnRenamed("plan_id", "report_id"), "report_id", "left")
    size, none = F.size("sections"), F.lit(None)
    shown = {"n_sections": none.cast("int") if brief else size, "sections_complete": none.cast("boolean") if brief else size == X.SECTIONS}
    against = {"volumes_match": none.cast("boolean"), **{c: none.cast("long") for c in ("source_folders", "source_retained")}, "source_retained_pct": none.cast("double"), "folders_created": none.cast("long")}
    if inv is not None:
        measured = volumetry(inv).select("items", F.col("folders").alias("n_folders"), F.col("max_depth").alias("n_depth"))
        rows = merged(rows.crossJoin(F.broadcast(measured)), conservation(inv, plans).withColumnRenamed("plan_id", "report_id"), "report_id", "left")  # one row
        same = (F.col("v.items") == F.col("items")) & (F.col("v.folders") == F.col("n_folders")) & (F.col("v.depth") == F.col("n_depth"))
        against = {"volumes_match": same} | {c: F.col(c) for c in ("source_folders", "source_retained", "source_retained_pct", "folders_created")}
    shape = [F.coalesce(c, F.lit(0)).alias(c) for c in ("folders", "depth", "max_children", "leaves")]
    return rows.select("report_id", "chars", *[c.alias(n) for n, c in shown.items()], "verdict", (F.trim("r.plan") != "").alias("plan_extracted"), "structure_block", F.col("folders").isNotNull().alias("plan_found"), *shape, *[c.alias(n) for n, c in against.items()])


def directives_followed(classified: DataFrame, cases: DataFrame, by: By = ()) -> DataFrame:
    """total, followed, pct."""
    met = expectations_met(classified, cases, by)
    return met.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("followed").alias("followed"), F.round(F.try_divide(100 * F.count_if("followed"), F.count("*")), 1).alias("pct"))


def directives_missed(classified: DataFrame, cases: DataFrame, by: By = ()) -> DataFrame:
    """(path, landed_in, expected) of the cases that were not followed; landed_in is empty if the file is nowhere."""
    landed = F.array_join(F.array_sort(F.coalesce("landed", F.array().cast("array<string>"))), " | ")
    return expectations_met(classified, cases, by).where("NOT followed").select(*by, "path", landed.alias("landed_in"), F.col("folder").alias("expected"))


def classement_metrics(counts: DataFrame, by: By = ()) -> DataFrame:
    """Counters with their shares of the total."""
    names = ("classified", "unclassified", "malformed", "extensions_fixed", "targets_unknown", "paths_not_found", "refs_unresolved")
    return counts.select(*by, "total", *names, *[F.round(F.try_divide(100 * F.col(c), F.col("total")), 1).alias(f"{c}_pct") for c in names])


def _canonical(name: str | None, arguments: str | None) -> str | None:
    """The filter that a call selects by, as JSON in one form, or null if it selects by none or is not valid. Searches select
    by their words, a listing by its folder; any other call has a filter, or is one."""
    try:
        given = json.loads(arguments or "{}")
    except ValueError:
        return None
    if not isinstance(given, dict):
        return None
    given = given.get("filter", given) or {}
    if name == "search":
        given = {"keywords": given.get("keywords")}
    elif name == "list_folder":
        given = {"folder": given.get("path")}
    if not isinstance(given, dict):
        return None
    out = {}
    for key, value in given.items():
        if key == "keywords" and isinstance(value, str):
            value = value.split()
        if key == "keywords" and isinstance(value, list) and all(isinstance(w, str) for w in value):
            value = sorted({w.lower() for w in value})
        elif isinstance(value, str):
            value = value.strip().lower().strip("/").lstrip(".") if key in ("extension", "folder") else value
        if value not in (None, "", []):
            out[key] = value
    try:
        checked_filter(out)
    except ValueError:
        return None
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_filter(name: pd.Series, arguments: pd.Series) -> pd.Series:
    """The filter of each call in one form; nothing is computed twice for the calls of a batch."""
    known: dict = {}
    return pd.Series([known[c] if c in known else known.setdefault(c, _canonical(*c)) for c in zip(name, arguments, strict=True)], dtype=object)


def agent_cases(events: DataFrame, cases: DataFrame, inv: DataFrame | None = None) -> DataFrame:
    """Of each run and case: tool_ok, filter_ok, total_ok (null if the case does not ask for it), passed, steps, error.

    ``cases``: case_id, tools, filter (JSON, or null), check_total. ``events``: run_id, case_id, seq, type, name, arguments,
    result. A filter matches if a call of an expected tool selects the Items that the expected one selects; without ``inv``,
    if both are the same filter in some form. The total of the expected filter, or without ``inv`` that of the paired result,
    must stand in the final answer as a whole word."""
    canonical = canonical_filter
    calls = pair_events(events).select("run_id", "case_id", "seq", "name", "call_args", F.get_json_object("result", "$.total").alias("said"))
    forms = materialise(calls.select("name", "call_args").distinct().withColumn("emitted", canonical("name", "call_args")), "emitted-filters")
    asked = cases.select("filter").where("filter IS NOT NULL").distinct()
    asked = materialise(asked.withColumn("expected", canonical(F.lit("filter"), "filter")), "expected-filters")
    same_call = (F.col("name") == F.col("n2")) & F.col("call_args").eqNullSafe(F.col("a2"))
    known = forms.select(F.col("name").alias("n2"), F.col("call_args").alias("a2"), "emitted")
    wanted = cases.hint("merge").join(asked.withColumnRenamed("filter", "f2").hint("merge"), F.col("filter") == F.col("f2"), "left").drop("f2")
    tried = calls.hint("merge").join(known.hint("merge"), same_call, "left").drop("n2", "a2").hint("merge").join(wanted.select("case_id", "tools", "filter", "expected").hint("merge"), "case_id")
    tried = materialise(tried.withColumn("admitted", (F.size("tools") == 0) | F.array_contains("tools", F.col("name"))), "tried-calls")
    alike = F.col("emitted") == F.col("expected")
    if inv is not None:
        differ = tried.where("admitted AND emitted <> expected").select(F.col("emitted").alias("first"), F.col("expected").alias("second")).distinct()
        differ = materialise(differ, "filter-pairs")
        every = asked.select(F.coalesce("expected", F.lit("{}")).alias("filter")).unionByName(inv.sparkSession.sql("SELECT '{}' AS filter")).distinct()
        every = materialise(every, "expected-forms")
        bits = bitmaps(inv, every.unionByName(differ.select(F.col("first").alias("filter"))))
        pairs = compared(bits, differ).select(F.col("first").alias("emitted"), F.col("second").alias("expected"), "equal")
        tried = tried.hint("merge").join(materialise(pairs, "equal-filters").hint("merge"), ["emitted", "expected"], "left")
        alike = alike | F.coalesce("equal", F.lit(False))
    used = tried.groupBy("run_id", "case_id").agg(F.bool_or((F.size("tools") > 0) & F.col("admitted")).alias("tool"), F.bool_or(F.col("admitted") & F.coalesce(alike, F.lit(False))).alias("same"), F.max_by("said", "seq").alias("said"))
    ends = events.groupBy("run_id", "case_id").agg(F.max_by("result", F.when(F.col("type") == "final", F.col("seq"))).alias("answer"), F.count_if(F.col("type") == "tool").alias("steps"), F.max(F.when(F.col("type") == "error", F.col("result"))).alias("error"))
    rows = ends.hint("merge").join(wanted.hint("merge"), "case_id").hint("merge").join(used.hint("merge"), ["run_id", "case_id"], "left")
    total = F.col("said")
    if inv is not None:
        exact = totals(bits, every).select(F.col("filter").alias("form"), F.col("total").alias("exact"))
        rows = rows.withColumn("form", F.coalesce("expected", F.lit("{}"))).hint("merge").join(materialise(exact, "filter-totals").hint("merge"), "form", "left")
        total = F.col("exact").cast("string")
    tool = F.when(F.size("tools") > 0, F.coalesce("tool", F.lit(False)))
    same = F.when(F.col("filter").isNotNull(), F.coalesce("same", F.lit(False)))
    said = F.when(F.col("check_total"), F.coalesce(F.regexp_like(X.text(F.col("answer")), F.concat(F.lit(r"\b"), total, F.lit(r"\b"))), F.lit(False)))
    rows = rows.withColumns({"tool_ok": tool, "filter_ok": same, "total_ok": said})
    measured = F.coalesce(F.col("tool_ok"), F.col("filter_ok"), F.col("total_ok")).isNotNull()
    passed = measured & F.coalesce("tool_ok", F.lit(True)) & F.coalesce("filter_ok", F.lit(True)) & F.coalesce("total_ok", F.lit(True))
    return rows.select("run_id", "case_id", "tool_ok", "filter_ok", "total_ok", passed.alias("passed"), "steps", "error")


def agent_runs(cases: DataFrame) -> DataFrame:
    return agent_run_metrics(cases)
