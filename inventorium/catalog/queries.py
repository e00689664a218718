"""Queries by operator. Each entry: a function of (spark, sf_dir), and SQL for DuckDB or none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..operators import audit, checks, classify, content, evaluate, explore, hierarchy, joins, postings, runs, sets, windows
from ..plans import differences
from ..plans import plans as P
from ..session import materialise, merged, new_path
from ..sources import inventory as inv_io
from ..sources import texts as text_io
from ..streaming import streams
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = T.oracle(sql)
        return f

    return add


def over_inventory(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    register(name, sql)(lambda spark, sf: f(T.inventory(spark, sf)))


def over_both(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None) -> None:
    """f(assignments, inventory)."""
    register(name, sql)(lambda spark, sf: f(T.assignments(spark, sf), T.inventory(spark, sf)))


# DuckDB's side of the scalar functions, over a column p for paths and c for texts.
def _base(p: str = "path") -> str:
    return rf"regexp_extract({p}, '[^\\/]*$')"


def _ext(p: str = "path") -> str:
    return rf"lower(regexp_extract({_base(p)}, '^.+\.([^.]*)$', 1))"


def _fold(c: str) -> str:
    return f"strip_accents(lower({c}))"


def _segs(p: str = "path") -> str:
    return rf"[s FOR s IN string_split_regex({p}, '[\\/]+') IF s <> '' AND s <> '.']"


def _list(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_NOISE = f"CASE WHEN starts_with(lower(trim({_base()})), '~$') OR starts_with(lower(trim({_base()})), '.~lock.') THEN 'lock' WHEN lower(trim({_base()})) IN ({_list(X.SYSTEM_NAMES[:-1])}) THEN 'system' WHEN {_ext()} IN ({_list(X.TEMP_EXTENSIONS)}) THEN 'temp' END"
_ABOVE = "list_concat(['.'], [array_to_string(string_split(path, '/')[1:i], '/') FOR i IN range(1, len(string_split(path, '/')))])"
_CHAIN = f"SELECT *, unnest({_ABOVE}) AS folder FROM inventory WHERE level = 'Item'"
_ITEMS, _FOLDERS = "level = 'Item'", "level = 'RecordGrp' AND path <> '.'"

# scalars

register(
    "x2_x5_path_functions",
    rf"""SELECT id, {_base()} AS basename, {_ext()} AS extension, len({_segs()}) AS depth, CASE WHEN path = '.' THEN '' WHEN NOT contains(path, '/') THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent,
    CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS first_segment, nullif(regexp_extract(start_date, '^([0-9]{{4}})', 1), '') AS year, {_NOISE} AS noise FROM inventory""",
)(
    lambda spark, sf: T.inventory(spark, sf).select(
        "id", X.basename(F.col("path")).alias("basename"), X.extension(F.col("path")).alias("extension"), X.depth(F.col("path")).cast("long").alias("depth"), X.parent_path(F.col("path")).alias("parent"),
        X.first_segment(F.col("path")).alias("first_segment"), X.year(F.col("start_date")).alias("year"), X.noise_kind(F.col("path")).alias("noise"),
    )
)
register("x1_fold", f"SELECT doc_id, md5({_fold('text')}) AS folded FROM documents")(lambda spark, sf: T.source(spark, sf, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded")))
register(
    "x6_x13_names",
    rf"""WITH n AS (SELECT id, path, title, {_base()} AS b, CASE WHEN regexp_matches({_base()}, '^.+\.[^.]*$') THEN regexp_replace({_base()}, '\.[^.]*$', '') ELSE {_base()} END AS stem FROM inventory)
    SELECT id, trim(replace(stem, '_', ' ')) AS title_from_name, regexp_matches(trim(b), '\.[A-Za-z0-9]{{1,6}}$') AS looks_like_file,
    CASE WHEN title = '' OR regexp_extract(b, '\.[^.]*$') = '' THEN title ELSE regexp_replace(title, '\.[^.]*$', '') || regexp_extract(b, '\.[^.]*$') END AS kept_extension,
    coalesce(nullif(trim(regexp_replace(strip_accents(title), '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'Nouveau_dossier') AS slug,
    lower(trim(replace(regexp_replace(b, '^[0-9]+(-[0-9]+)*_', ''), '_', ' '))) AS label FROM n""",
)(
    lambda spark, sf: T.inventory(spark, sf).select(
        "id", X.title_from_name(F.col("path")).alias("title_from_name"), X.looks_like_file(X.basename(F.col("path"))).alias("looks_like_file"), X.preserve_extension(F.col("title"), F.col("path")).alias("kept_extension"),
        X.slugify(F.col("title")).alias("slug"), X.semantic_label(X.basename(F.col("path"))).alias("label"),
    )
)
register(
    "x14_x17_texts",
    r"""WITH c AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '[email]@\1', 'g') AS t FROM documents)
    SELECT doc_id, md5(t) AS cleaned, length(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 0.6 * length(regexp_replace(t, '\s', '', 'g')) AND length(regexp_replace(t, '\s', '', 'g')) > 0 AS is_text,
    CASE WHEN length(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 0.6 * length(regexp_replace(t, '\s', '', 'g')) AND length(regexp_replace(t, '\s', '', 'g')) > 0 THEN substring(t, 1, 220) ELSE '' END AS snippet FROM c""",
)(lambda spark, sf: T.source(spark, sf, "documents").select("doc_id", F.md5(X.clean(F.col("text"))).alias("cleaned"), X.looks_like_text(X.clean(F.col("text"))).alias("is_text"), X.snippet(F.col("text")).alias("snippet")))
register("x10_x20_file_names", r"""SELECT page_id, trim(regexp_replace(url, '[^\p{L}\p{N}_]+', '_', 'g'), '_') AS slug_created, coalesce(nullif(regexp_replace(trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '\.+$', ''), ''), 'sans_nom') AS file_name FROM pages""")(
    lambda spark, sf: T.source(spark, sf, "pages").select("page_id", X.slug_created(F.col("url")).alias("slug_created"), X.sanitize_filename(F.col("url")).alias("file_name"))
)


def _usage_json(spark, sf) -> DataFrame:
    """Usage as three providers write it, with and without the optional counters."""
    e, n, m = T.source(spark, sf, "events"), (F.col("event_id") % 1000).cast("string"), (F.col("user_id") % 50).cast("string")
    chat = F.concat(F.lit('{"prompt_tokens": '), n, F.lit(', "completion_tokens": '), m, F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(', "prompt_tokens_details": {"cached_tokens": '), m, F.lit("}"))).otherwise(""), F.lit("}"))
    plain = F.concat(F.lit('{"input_tokens": '), n, F.lit(', "output_tokens": '), m, F.lit(', "cache_read_input_tokens": '), n, F.lit(', "total_tokens": '), (F.col("event_id") % 1000 + 7).cast("string"), F.lit("}"))
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, chat).when(F.col("event_id") % 3 == 1, plain).otherwise(F.lit("{}")).alias("usage"))


register("x24_usage_json", "WITH e AS (SELECT event_id, event_id % 3 AS kind, event_id % 1000 AS n, user_id % 50 AS m, user_id % 2 = 0 AS cached FROM events) SELECT event_id, CASE WHEN kind < 2 THEN CAST(n AS BIGINT) END AS input_tokens, CASE WHEN kind < 2 THEN CAST(m AS BIGINT) END AS output_tokens, CAST(CASE kind WHEN 0 THEN n + m WHEN 1 THEN n + 7 END AS BIGINT) AS total_tokens, CAST(CASE WHEN kind = 1 THEN n WHEN kind = 0 AND cached THEN m END AS BIGINT) AS cache_read_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens FROM e")(lambda spark, sf: _usage_json(spark, sf).select("event_id", X.normalize_usage(F.col("usage")).alias("u")).select("event_id", "u.*"))
register("x23_action_json", "SELECT event_id, props AS call FROM events")(lambda spark, sf: T.source(spark, sf, "events").select("event_id", X.action_json(F.concat(F.lit("call {not this} "), F.col("props"), F.lit(' done {"later": 1}'))).alias("call")))
register(
    "x26_data_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT doc_id, count(*) FILTER (NOT starts_with(trim(s), '```') AND (length(s) - length(replace(s, ';', '')) >= 2 OR length(s) - length(replace(s, ',', '')) >= 2)) AS data_lines FROM l GROUP BY doc_id""",
)(lambda spark, sf: T.source(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("s")).groupBy("doc_id").agg(F.count_if(X.is_data_line(F.col("s"))).alias("data_lines")))


def _conserved(name: str) -> str:
    bare = f"trim(replace(regexp_replace(regexp_replace({name}, '^[0-9]+([.-][0-9]+)*[.)][ ]+', ''), '^[0-9]+(-[0-9]+)*_', ''), '_', ' '))"
    return f"array_to_string(list_sort(list_distinct([w FOR w IN string_split_regex({_fold(bare)}, '[^a-z0-9]+') IF length(w) > 1 OR regexp_matches(w, '^[0-9]$')])), ' ')"


register("x13_conservation_labels", f"SELECT DISTINCT {_base()} AS name, {_conserved(_base())} AS label FROM inventory WHERE {_FOLDERS}")(lambda spark, sf: hierarchy.folders(T.inventory(spark, sf)).select(X.basename(F.col("path")).alias("name"), X.conservation_label(X.basename(F.col("path"))).alias("label")).distinct())

# filters and exploration

_SPEC = {"keywords": ["EVENEMENT", "order"], "extension": ".PDF", "folder": "2_america", "year_min": 1993, "year_max": 1997}
_SPEC_SQL = f"""{_ITEMS} AND contains({_fold("path || ' ' || title")}, 'evenement') AND contains({_fold("path || ' ' || title")}, 'order') AND {_ext()} = 'pdf' AND starts_with({_fold('path')}, '2_america/')
 AND try_cast(regexp_extract(start_date, '^([0-9]{{4}})', 1) AS INT) BETWEEN 1993 AND 1997"""
over_inventory("f1_structured_filter", lambda inv: explore.filter_items(inv, _SPEC).select("id", "path"), f"SELECT id, path FROM inventory WHERE {_SPEC_SQL}")
over_inventory("f2_keyword_search", lambda inv: explore.keyword_search(inv, "évènement asia"), f"SELECT path, title, CASE WHEN {_ITEMS} THEN 'file' ELSE 'folder' END AS kind, start_date AS date FROM inventory WHERE path <> '.' AND contains({_fold("path || ' ' || title")}, 'evenement') AND contains({_fold("path || ' ' || title")}, 'asia')")
over_inventory(
    "f3_tree_search",
    lambda inv: explore.tree_search(inv, "rapport_12"),
    f"""WITH hit AS (SELECT path FROM inventory WHERE path <> '.' AND contains({_fold("path || ' ' || title")}, 'rapport_12')),
    up AS (SELECT DISTINCT unnest([array_to_string(string_split(path, '/')[1:i], '/') FOR i IN range(1, len(string_split(path, '/')))]) AS path FROM hit)
    SELECT DISTINCT path, true AS matched FROM hit UNION ALL SELECT path, false FROM up WHERE path NOT IN (SELECT path FROM hit)""",
)
over_inventory("f4_exclude_noise_names", lambda inv: explore.exclude_noise_names(inv).select("id"), f"SELECT id FROM inventory WHERE NOT (starts_with({_base()}, '.') AND path <> '' OR starts_with({_base()}, '~$') OR lower({_base()}) IN ({_list(X.EXCLUDED_NAMES)}))")
over_inventory("a11_count_items", lambda inv: explore.count_items(inv, {"folder": "3_ASIA"}), f"WITH f AS (SELECT {_ext()} AS extension FROM inventory WHERE {_ITEMS} AND starts_with({_fold('path')}, '3_asia/')) SELECT extension, count(*) AS n, (SELECT count(*) FROM f) AS total FROM f GROUP BY extension ORDER BY n DESC, extension LIMIT 5")
for _dim, _value in (("extension", f"coalesce(nullif({_ext()}, ''), '(sans extension)')"), ("year", "coalesce(nullif(regexp_extract(start_date, '^([0-9]{4})', 1), ''), '(sans date)')"), ("folder", "CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(racine)' END")):
    over_inventory(
        f"a12_stats_by_{_dim}",
        lambda inv, d=_dim: explore.stats_by(inv, d, max_buckets=4),
        f"WITH c AS (SELECT {_value} AS v, count(*) AS c FROM inventory WHERE {_ITEMS} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, v) AS rn FROM c) SELECT CASE WHEN rn > 4 THEN '(autres)' ELSE v END AS value, CAST(sum(c) AS BIGINT) AS n FROM r GROUP BY 1",
    )
_BARE = "CASE WHEN {e} <> '' THEN regexp_replace({c}, '\\.[^.]*$', '') ELSE {c} END"
over_inventory(
    "a13_frequent_terms",
    lambda inv: explore.frequent_terms(inv, None, 30),
    f"""WITH t AS (SELECT id, unnest(list_distinct(regexp_extract_all({_fold(_BARE.format(e=_ext(), c="path"))} || ' ' || {_fold(_BARE.format(e=_ext("title"), c="title"))}, '\\p{{L}}{{3,}}'))) AS term FROM inventory WHERE {_ITEMS}),
    c AS (SELECT term, count(*) AS n FROM t WHERE term NOT IN (SELECT strip_accents(unnest([{_list(X.STOP_WORDS)}]))) GROUP BY term) SELECT term, n, (SELECT count(*) FROM c) AS distinct_terms FROM c ORDER BY n DESC, term LIMIT 30""",
)
over_inventory("w3_even_sample", lambda inv: explore.even_sample(inv, {"extension": "doc"}, 7).select("nth", "total", "path"), f"WITH r AS (SELECT path, row_number() OVER (ORDER BY pos, path) - 1 AS nth, count(*) OVER () AS total FROM inventory WHERE {_ITEMS} AND {_ext()} = 'doc') SELECT nth, total, path FROM r WHERE nth IN (SELECT CAST(floor(i * total / 7) AS BIGINT) FROM range(7) AS s(i))")
over_inventory("o1_paginate", lambda inv: explore.paginate(hierarchy.folders(inv), 2).select("path", "total", "pages"), f"SELECT path, (SELECT count(*) FROM inventory WHERE {_FOLDERS}) AS total, (SELECT CAST(ceil(count(*) / 20) AS INT) FROM inventory WHERE {_FOLDERS}) AS pages FROM inventory WHERE {_FOLDERS} ORDER BY pos, path LIMIT 20 OFFSET 40")
over_inventory("o4_topk", lambda inv: explore.topk(hierarchy.items(inv).select("title"), "title", 3), f"SELECT title, count(*) AS n FROM inventory WHERE {_ITEMS} GROUP BY title ORDER BY n DESC, title LIMIT 3")
over_inventory("h10_list_folder", lambda inv: hierarchy.list_folder(inv, "1_AFRICA").select("kind", "name", "n_items"), f"WITH c AS (SELECT folder, count(*) AS n FROM ({_CHAIN}) GROUP BY folder) SELECT 'folder' AS kind, path AS name, coalesce(n, 0) AS n_items FROM inventory LEFT JOIN c ON folder = path WHERE {_FOLDERS} AND regexp_replace(path, '/[^/]*$', '') = '1_AFRICA' AND contains(path, '/') ORDER BY path LIMIT 20")
over_inventory("j14_files_per_folder", lambda inv: hierarchy.files_per_folder(inv), f"WITH c AS (SELECT folder, count(*) AS n_items FROM ({_CHAIN}) GROUP BY folder) SELECT path AS folder, coalesce(n_items, 0) AS n_items FROM inventory LEFT JOIN c ON folder = path WHERE {_FOLDERS} AND NOT contains(path, '/') ORDER BY path LIMIT 20")

# audit

over_inventory("a1_volumetry", audit.volumetry, f"SELECT count(*) FILTER ({_ITEMS}) AS items, count(*) FILTER (level = 'RecordGrp') AS folders, count(*) AS all_rows, CAST(max(len({_segs()})) AS INT) AS max_depth FROM inventory")
over_inventory("a2_top_formats", lambda inv: audit.top_formats(inv, 6), f"WITH c AS (SELECT coalesce(nullif({_ext()}, ''), '(sans extension)') AS extension, count(*) AS n FROM inventory WHERE {_ITEMS} GROUP BY 1) SELECT extension, n, (SELECT count(*) FROM c) AS distinct_extensions FROM c ORDER BY n DESC, extension LIMIT 6")
over_inventory("a3_risky_formats", audit.risky_formats, f"SELECT {_ext()} AS extension, count(*) AS n FROM inventory WHERE {_ITEMS} AND {_ext()} IN ({_list(X.RISKY_EXTENSIONS)}) GROUP BY 1")
over_inventory("a4_compressed_formats", audit.compressed_formats, f"SELECT {_ext()} AS extension, count(*) AS n FROM inventory WHERE {_ITEMS} AND {_ext()} IN ({_list(X.COMPRESSED_EXTENSIONS)}) GROUP BY 1")
over_inventory("a5_noise", audit.noise, f"SELECT {_NOISE} AS kind, count(*) AS n FROM inventory WHERE {_ITEMS} AND {_NOISE} IS NOT NULL GROUP BY 1")
over_inventory("a5_noise_examples", audit.noise_examples, f"WITH f AS (SELECT path, row_number() OVER (ORDER BY pos, path) AS k FROM inventory WHERE {_ITEMS} AND {_NOISE} IS NOT NULL) SELECT count(*) AS n_noise, string_agg(path, ' | ' ORDER BY k) FILTER (k <= 5) AS examples FROM f")
over_inventory("a6_name_collisions", audit.name_collisions, f"SELECT lower(trim({_base()})) AS name, count(*) AS n, arg_min(path, pos) AS first_path FROM inventory WHERE {_ITEMS} AND {_NOISE} IS NULL AND trim({_base()}) <> '' GROUP BY 1 HAVING count(*) >= 2")
over_inventory("a6_name_collision_totals", audit.name_collision_totals, f"WITH g AS (SELECT count(*) AS n FROM inventory WHERE {_ITEMS} AND {_NOISE} IS NULL GROUP BY lower(trim({_base()})) HAVING count(*) >= 2) SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS files FROM g")
over_inventory("a7_strict_duplicates", audit.strict_duplicates, f"WITH g AS (SELECT fingerprint AS fp, count(*) AS n, list_sort(list_distinct(list({_base()})))[1:4] AS l FROM inventory WHERE {_ITEMS} AND fingerprint <> '' GROUP BY 1 HAVING count(*) >= 2) SELECT fp[1:12] AS fingerprint, n, array_to_string(l, ' | ') AS names FROM g")
over_inventory("a7_strict_duplicate_totals", audit.strict_duplicate_totals, f"WITH g AS (SELECT count(*) AS n FROM inventory WHERE {_ITEMS} AND fingerprint <> '' GROUP BY fingerprint HAVING count(*) >= 2) SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS files, CAST(coalesce(sum(n), 0) - count(*) AS BIGINT) AS redundant, true AS available FROM g")
over_inventory("a8_source_folders", audit.source_folders, f"WITH u AS (SELECT DISTINCT folder FROM ({_CHAIN})) SELECT path, coalesce(nullif(title, ''), nullif({_base()}, ''), '(sans titre)') AS label, folder IS NOT NULL AS non_empty FROM inventory LEFT JOIN u ON folder = path WHERE {_FOLDERS}")
over_inventory("a9_structure", audit.structure, f"SELECT count(*) FILTER ({_ITEMS} AND len({_segs()}) = 1) AS root_items, round(100.0 * count(*) FILTER ({_ITEMS} AND len({_segs()}) = 1) / count(*) FILTER ({_ITEMS}), 1) AS root_items_pct, count(*) FILTER ({_FOLDERS} AND regexp_matches({_base()}, '^[0-9]+[\\s._)-]')) AS prefixed_folders, count(*) FILTER ({_FOLDERS}) AS folder_count FROM inventory")
over_inventory("a9_crowded_folders", audit.crowded_folders, f"SELECT {_segs()}[-2] AS folder, count(*) AS n FROM inventory WHERE {_ITEMS} AND len({_segs()}) >= 2 GROUP BY 1 ORDER BY n DESC, folder LIMIT 5")
over_inventory("h5_empty_folders", lambda inv: hierarchy.empty_folders(inv), f"WITH u AS (SELECT DISTINCT folder FROM ({_CHAIN})), e AS (SELECT coalesce(nullif(title, ''), nullif({_base()}, ''), '(sans titre)') AS label, row_number() OVER (ORDER BY pos) AS k FROM inventory WHERE {_FOLDERS} AND path NOT IN (SELECT folder FROM u)) SELECT count(*) AS n_empty, string_agg(label, ' | ' ORDER BY k) FILTER (k <= 5) AS examples FROM e")


# a scan as rows; the SQL puts the single measures side by side
_SCAN_SQL = f"""WITH i AS (SELECT *, {_ext()} AS ext, {_base()} AS base, {_NOISE} AS noise, len({_segs()}) AS depth, {_segs()}[-2] AS above FROM inventory), it AS (SELECT * FROM i WHERE {_ITEMS}), fo AS (SELECT * FROM i WHERE {_FOLDERS}), u AS (SELECT DISTINCT folder FROM ({_CHAIN})),
nc AS (SELECT count(*) AS n FROM it WHERE noise IS NULL AND trim(base) <> '' GROUP BY lower(trim(base)) HAVING count(*) >= 2), fp AS (SELECT count(*) AS n FROM it WHERE trim(fingerprint) <> '' GROUP BY lower(trim(fingerprint)) HAVING count(*) >= 2),
ex AS (SELECT coalesce(nullif(ext, ''), '(sans extension)') AS key, count(*) AS n FROM it GROUP BY 1), ne AS (SELECT coalesce(nullif(title, ''), nullif(base, ''), '(sans titre)') AS label, row_number() OVER (ORDER BY pos) AS k FROM fo WHERE path NOT IN (SELECT folder FROM u)), no AS (SELECT path, row_number() OVER (ORDER BY pos) AS k FROM it WHERE noise IS NOT NULL),
r AS (SELECT 'volumetry' AS measure, 'items' AS key, (SELECT count(*) FROM it) AS n UNION ALL SELECT 'volumetry', 'folders', count(*) FILTER (level = 'RecordGrp') FROM i UNION ALL SELECT 'volumetry', 'all_rows', count(*) FROM i UNION ALL SELECT 'volumetry', 'max_depth', max(depth) FROM i
UNION ALL SELECT 'top_formats', 'distinct_extensions', count(*) FROM ex UNION ALL SELECT 'name_collisions', 'groups', count(*) FROM nc UNION ALL SELECT 'name_collisions', 'files', sum(n) FROM nc UNION ALL SELECT 'strict_duplicates', 'groups', count(*) FROM fp UNION ALL SELECT 'strict_duplicates', 'files', sum(n) FROM fp UNION ALL SELECT 'strict_duplicates', 'redundant', sum(n) - count(*) FROM fp UNION ALL SELECT 'strict_duplicates', 'available', 1
UNION ALL SELECT 'empty_folders', 'n_empty', count(*) FROM ne UNION ALL SELECT 'source_folders', 'folders', count(*) FROM fo UNION ALL SELECT 'source_folders', 'non_empty', count(*) FROM fo WHERE path IN (SELECT folder FROM u) UNION ALL SELECT 'structure', 'root_items', count(*) FROM it WHERE depth = 1 UNION ALL SELECT 'structure', 'prefixed_folders', count(*) FROM fo WHERE regexp_matches(trim(base), '^[0-9]+[\\s._)-]') UNION ALL SELECT 'structure', 'folder_count', count(*) FROM fo
UNION ALL (SELECT 'top_formats', key, n FROM ex ORDER BY n DESC, key LIMIT 10) UNION ALL SELECT 'risky_formats', key, n FROM ex WHERE key IN ({_list(X.RISKY_EXTENSIONS)}) UNION ALL SELECT 'compressed_formats', key, n FROM ex WHERE key IN ({_list(X.COMPRESSED_EXTENSIONS)}) UNION ALL SELECT 'noise', noise, count(*) FROM it WHERE noise IS NOT NULL GROUP BY 2
UNION ALL (SELECT 'crowded_folders', above, count(*) FROM it WHERE depth >= 2 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL SELECT 'empty_folder_examples', label, k FROM ne WHERE k <= 5 UNION ALL SELECT 'noise_examples', path, k FROM no WHERE k <= 5)
SELECT measure, key, CAST(n AS BIGINT) AS n, CASE WHEN key = 'root_items' THEN (SELECT round(100.0 * count(*) FILTER (depth = 1) / count(*), 1)::DOUBLE FROM it) END AS pct FROM r"""
over_inventory("a10_scan_all", audit.scan_report, _SCAN_SQL)


# two holdings at once: each function gives for each what it gives for one


def _holdings(inv: DataFrame) -> DataFrame:
    """The inventory as two holdings, by the region of a path."""
    return inv.withColumn("fonds_id", F.when(F.col("path") < "3", "a").otherwise("b"))


_FONDS = "SELECT *, CASE WHEN path < '3' THEN 'a' ELSE 'b' END AS fonds_id FROM inventory"
_BY = ("fonds_id",)


def over_holdings(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """``sql`` reads a table h."""
    register(name, f"WITH h AS ({_FONDS}){', ' + sql[5:] if sql.startswith('WITH ') else ' ' + sql}")(lambda spark, sf: f(_holdings(T.inventory(spark, sf))))


over_holdings("by_a11_count_items", lambda h: explore.count_items(h, None, 3, _BY), f"WITH c AS (SELECT fonds_id, {_ext()} AS extension, count(*) AS n FROM h WHERE {_ITEMS} GROUP BY ALL), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY fonds_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY fonds_id ORDER BY n DESC, extension) AS k FROM c) SELECT fonds_id, extension, n, total FROM r WHERE k <= 3")
over_holdings("by_a12_stats_by", lambda h: explore.stats_by(h, "year", max_buckets=4, by=_BY), f"WITH c AS (SELECT fonds_id, coalesce(nullif(regexp_extract(start_date, '^([0-9]{{4}})', 1), ''), '(sans date)') AS v, count(*) AS c FROM h WHERE {_ITEMS} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY fonds_id ORDER BY c DESC, v) AS rn FROM c) SELECT fonds_id, CASE WHEN rn > 4 THEN '(autres)' ELSE v END AS value, CAST(sum(c) AS BIGINT) AS n FROM r GROUP BY ALL")
over_holdings("by_f3_tree_search", lambda h: explore.tree_search(h, "rapport_12", _BY), f"""WITH hit AS (SELECT DISTINCT fonds_id, path FROM h WHERE path <> '.' AND contains({_fold("path || ' ' || title")}, 'rapport_12')), up AS (SELECT DISTINCT fonds_id, unnest([array_to_string(string_split(path, '/')[1:i], '/') FOR i IN range(1, len(string_split(path, '/')))]) AS path FROM hit) SELECT fonds_id, path, true AS matched FROM hit UNION ALL SELECT fonds_id, path, false FROM up ANTI JOIN hit USING (fonds_id, path)""")
over_holdings("by_o1_paginate", lambda h: explore.paginate(hierarchy.items(h), 1, 10, _BY).select("fonds_id", "path", "total", "pages"), f"WITH r AS (SELECT fonds_id, path, count(*) OVER w AS total, row_number() OVER (PARTITION BY fonds_id ORDER BY pos, path) AS k FROM h WHERE {_ITEMS} WINDOW w AS (PARTITION BY fonds_id)) SELECT fonds_id, path, total, CAST(ceil(total / 10) AS INT) AS pages FROM r WHERE k BETWEEN 11 AND 20")
over_holdings("by_a1_volumetry", lambda h: audit.volumetry(h, _BY), f"SELECT fonds_id, count(*) FILTER ({_ITEMS}) AS items, count(*) FILTER (level = 'RecordGrp') AS folders, count(*) AS all_rows, CAST(max(len({_segs()})) AS INT) AS max_depth FROM h GROUP BY fonds_id")
over_holdings("by_a9_structure", lambda h: audit.structure(h, _BY), f"SELECT fonds_id, count(*) FILTER ({_ITEMS} AND len({_segs()}) = 1) AS root_items, round(100.0 * count(*) FILTER ({_ITEMS} AND len({_segs()}) = 1) / count(*) FILTER ({_ITEMS}), 1) AS root_items_pct, count(*) FILTER ({_FOLDERS} AND regexp_matches({_base()}, '^[0-9]+[\\s._)-]')) AS prefixed_folders, count(*) FILTER ({_FOLDERS}) AS folder_count FROM h GROUP BY fonds_id")
over_holdings("by_a6_name_collisions", lambda h: audit.name_collisions(h, by=_BY), f"SELECT fonds_id, lower(trim({_base()})) AS name, count(*) AS n, arg_min(path, pos) AS first_path FROM h WHERE {_ITEMS} AND {_NOISE} IS NULL AND trim({_base()}) <> '' GROUP BY ALL HAVING count(*) >= 2")
over_holdings("by_q10_validate", lambda h: checks.validate(_broken(h), False, _BY), "WITH b AS (SELECT fonds_id, CASE pos % 1000 WHEN 1 THEN 'Fichier' WHEN 2 THEN NULL ELSE level END AS level, CASE WHEN pos % 1000 = 3 THEN 'dup' ELSE id END AS id, start_date, CASE WHEN pos % 1000 = 5 THEN '1900' ELSE end_date END AS end_date FROM h), i AS (SELECT fonds_id, id, count(*) AS c FROM b GROUP BY ALL) SELECT fonds_id, 'invalid_level' AS rule, count(*) FILTER (coalesce(level NOT IN ('RecordGrp', 'SubGrp', 'Series', 'Subseries', 'File', 'Item', 'OtherLevel'), true)) AS n FROM b GROUP BY fonds_id UNION ALL SELECT fonds_id, 'duplicate_id', CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) FROM i GROUP BY fonds_id UNION ALL SELECT fonds_id, 'start_after_end', count(*) FILTER (start_date <> '' AND end_date <> '' AND start_date > end_date) FROM b GROUP BY fonds_id")
over_holdings("by_h6_has_cycle", lambda h: hierarchy.has_cycle(h.select("fonds_id", "id", F.when((F.col("id") == "10") & (F.col("fonds_id") == "a"), "100").otherwise(F.col("parent_id")).alias("parent_id")), _BY), "SELECT fonds_id, fonds_id = 'a' AND count(*) FILTER (id = '100' AND parent_id = '10') > 0 AS has_cycle FROM h GROUP BY fonds_id")

# hierarchy

over_inventory("h1_rollup_dates", hierarchy.rollup_dates, f"SELECT folder, coalesce(min(nullif(start_date, '')), '') AS start_date, coalesce(max(nullif(end_date, '')), '') AS end_date FROM ({_CHAIN}) GROUP BY folder")
over_inventory("h2_ancestors", lambda inv: hierarchy.ancestors(hierarchy.folders(inv)), f"WITH f AS (SELECT path, string_split(path, '/') AS s FROM inventory WHERE {_FOLDERS}), g AS (SELECT path, s, unnest(range(0, len(s))) AS distance FROM f) SELECT path, CAST(distance AS INT) AS distance, array_to_string(s[1 : len(s) - distance], '/') AS ancestor FROM g")
over_inventory("h2_closure_by_id", lambda inv: hierarchy.closure_by_id(hierarchy.folders(inv).unionByName(inv.where("path = '.'"))), "WITH f AS (SELECT id, parent_id FROM inventory WHERE level = 'RecordGrp'), a AS (SELECT id, parent_id AS ancestor, 1 AS d FROM f WHERE parent_id <> ''), b AS (SELECT a.id, f.parent_id AS ancestor, 2 AS d FROM a JOIN f ON a.ancestor = f.id WHERE f.parent_id <> ''), c AS (SELECT b.id, f.parent_id AS ancestor, 3 AS d FROM b JOIN f ON b.ancestor = f.id WHERE f.parent_id <> '') SELECT id, ancestor, CAST(d AS BIGINT) AS distance FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)")
over_inventory("h3_full_paths", lambda inv: hierarchy.full_paths(hierarchy.folders(inv).select("id", "parent_id", X.basename(F.col("path")).alias("name")), "name"), f"SELECT id, path AS full_path FROM inventory WHERE {_FOLDERS}")
over_inventory("h4_nonempty_folders", hierarchy.nonempty_folders, f"SELECT DISTINCT folder FROM ({_CHAIN}) WHERE folder <> '.'")
over_inventory("h6_has_cycle", lambda inv: hierarchy.has_cycle(inv.select("id", F.when(F.col("id") == "10", "100").otherwise(F.col("parent_id")).alias("parent_id"))).unionByName(hierarchy.has_cycle(inv)), "SELECT unnest([count(*) FILTER (id = '100' AND parent_id = '10') > 0, false]) AS has_cycle FROM inventory")
over_inventory("h7_max_depth", hierarchy.max_depth, f"SELECT CAST(max(len({_segs()})) AS INT) AS max_depth FROM inventory")
over_inventory("h9_descendant_counts", hierarchy.descendant_counts, f"SELECT folder, count(*) AS n_items FROM ({_CHAIN}) GROUP BY folder")
register("h8_plan_shape", "WITH k AS (SELECT parent, count(*) AS n FROM plan GROUP BY parent) SELECT plan_id, count(*) AS folders, CAST(2 AS BIGINT) AS depth, (SELECT max(n) FROM k) AS max_children, count(*) FILTER (folder NOT IN (SELECT parent FROM k WHERE parent IS NOT NULL)) AS leaves FROM plan GROUP BY plan_id")(lambda spark, sf: hierarchy.plan_shape(T.plan(spark, sf)))
register("h11_needed_folders", "WITH u AS (SELECT DISTINCT target AS folder FROM assignments) SELECT folder FROM u UNION SELECT parent FROM plan JOIN u USING (folder) WHERE parent IS NOT NULL")(lambda spark, sf: hierarchy.needed_folders(T.assignments(spark, sf).select(F.col("target").alias("folder")), T.plan(spark, sf)))

# quality rules

over_inventory(
    "q10_validate_output",
    lambda inv: checks.validate(inv, True),
    f"""WITH ids AS (SELECT id, count(*) AS c FROM inventory GROUP BY id) SELECT 'invalid_level' AS rule, count(*) FILTER (level NOT IN ({_list(checks.VALID_LEVELS)})) AS n FROM inventory UNION ALL SELECT 'duplicate_id', CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) FROM ids
    UNION ALL SELECT 'start_after_end', count(*) FILTER (start_date <> '' AND end_date <> '' AND start_date > end_date) FROM inventory UNION ALL SELECT 'orphan', count(*) FILTER (parent_id <> '' AND parent_id NOT IN (SELECT id FROM ids)) FROM inventory
    UNION ALL SELECT 'no_root', CAST(count(*) FILTER (parent_id = '') = 0 AS BIGINT) FROM inventory UNION ALL SELECT 'parent_cycle', 0""",
)


def _broken(inv: DataFrame) -> DataFrame:
    k = F.col("pos") % 1000
    return inv.withColumns({"level": F.when(k == 1, "Fichier").when(k == 2, None).otherwise(F.col("level")), "id": F.when(k == 3, "dup").otherwise(F.col("id")), "parent_id": F.when(k == 4, "nowhere").otherwise(F.col("parent_id")), "end_date": F.when(k == 5, "1900").otherwise(F.col("end_date"))})


over_inventory(
    "q2_q7_broken_inventory",
    lambda inv: sets.assemble(checks.check_levels(_broken(inv)), checks.check_ids(_broken(inv)), checks.check_orphans(_broken(inv)), checks.check_dates(_broken(inv)), checks.check_root(_broken(inv))),
    """WITH b AS (SELECT CASE pos % 1000 WHEN 1 THEN 'Fichier' WHEN 2 THEN NULL ELSE level END AS level, CASE WHEN pos % 1000 = 3 THEN 'dup' ELSE id END AS id, CASE WHEN pos % 1000 = 4 THEN 'nowhere' ELSE parent_id END AS parent_id, start_date, CASE WHEN pos % 1000 = 5 THEN '1900' ELSE end_date END AS end_date FROM inventory), ids AS (SELECT id, count(*) AS c FROM b GROUP BY id)
    SELECT 'invalid_level' AS rule, count(*) FILTER (coalesce(level NOT IN ('RecordGrp', 'SubGrp', 'Series', 'Subseries', 'File', 'Item', 'OtherLevel'), true)) AS n FROM b UNION ALL SELECT 'duplicate_id', CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) FROM ids UNION ALL SELECT 'orphan', count(*) FILTER (parent_id <> '' AND parent_id NOT IN (SELECT id FROM ids)) FROM b
    UNION ALL SELECT 'start_after_end', count(*) FILTER (start_date <> '' AND end_date <> '' AND start_date > end_date) FROM b UNION ALL SELECT 'no_root', CAST(count(*) FILTER (parent_id = '') = 0 AS BIGINT) FROM b""",
)

# preparation and windows

over_inventory("p1_prepare_columns", runs.prepare_columns, "SELECT id, parent_id, path, level, title, start_date, end_date FROM inventory")
over_inventory("p2_blank_item_dates", lambda inv: runs.blank_item_dates(inv).select("id", "start_date", "end_date"), f"SELECT id, CASE WHEN {_ITEMS} THEN '' ELSE start_date END AS start_date, CASE WHEN {_ITEMS} THEN '' ELSE end_date END AS end_date FROM inventory")
over_inventory("p3_tree_only", lambda inv: runs.tree_only(inv).select("id"), "SELECT id FROM inventory WHERE level <> 'Item'")
over_inventory("p4_sample_per_folder", lambda inv: windows.sample_per_folder(inv, 3).select("id"), f"SELECT id FROM (SELECT id, level, row_number() OVER (PARTITION BY parent_id, {_ITEMS} ORDER BY pos) AS k FROM inventory) WHERE level <> 'Item' OR k <= 3")
over_inventory("p5_items_to_classify", lambda inv: runs.items_to_classify(windows.assign_ref(inv)), f"SELECT row_number() OVER (ORDER BY pos, path) AS ref, path, title AS current_title, start_date AS date FROM inventory WHERE {_ITEMS}")
over_inventory("p6_llm_projection", lambda inv: runs.llm_projection(runs.items_to_classify(windows.assign_ref(inv)), False), f"SELECT path, title AS current_title, start_date AS date FROM inventory WHERE {_ITEMS}")
over_inventory("p7_level_split", lambda inv: hierarchy.level_split(inv)[1].select("id", "path"), f"SELECT id, path FROM inventory WHERE {_FOLDERS}")
over_inventory("p8_result_row", lambda inv: explore.result_row(inv), f"SELECT path, title, CASE WHEN {_ITEMS} THEN 'file' ELSE 'folder' END AS kind, start_date AS date FROM inventory")
over_inventory("w1_assign_ref", lambda inv: windows.assign_ref(inv).select("ref", "id"), f"SELECT row_number() OVER (ORDER BY pos, path) AS ref, id FROM inventory WHERE {_ITEMS}")
over_inventory("w2_batch_slices", lambda inv: windows.batch_slices(windows.assign_ref(inv), 400).groupBy("batch").agg(F.count("*").alias("n"), F.min("ref").alias("first")), f"WITH r AS (SELECT row_number() OVER (ORDER BY pos, path) AS ref FROM inventory WHERE {_ITEMS}) SELECT (ref - 1) // 400 AS batch, count(*) AS n, min(ref) AS first FROM r GROUP BY 1")
over_inventory("a21_token_estimate", lambda inv: runs.token_estimate(inv, ["id", "path", "title"], ("level",)), "SELECT level, count(*) AS rows, CAST(ceil(sum(length(id || ';' || path || ';' || title) + 1) / 3.5) AS BIGINT) AS tokens FROM inventory GROUP BY level")
over_inventory(
    "a30_budget_report",
    lambda inv: runs.budget_report(inv, 0, False),
    f"""WITH c AS (SELECT count(*) AS n FROM inventory WHERE {_ITEMS}), b AS (SELECT CASE WHEN n <= 200 THEN 0 WHEN n <= 1000 THEN 5 WHEN n <= 5000 THEN 3 ELSE 2 END AS k FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY parent_id, {_ITEMS} ORDER BY pos) AS rn FROM inventory), w AS (SELECT r.*, k FROM r, b WHERE level <> 'Item' OR k = 0 OR rn <= k)
    SELECT 'current' AS setting, 0 AS sample_n, count(*) AS rows, CAST(ceil(sum(length(id || ';' || parent_id || ';' || path || ';' || level || ';' || title || ';' || start_date || ';' || end_date) + 1) / 3.5) AS BIGINT) AS tokens FROM inventory
    UNION ALL SELECT 'recommended', any_value(k), count(*), CAST(ceil(sum(length(id || ';' || parent_id || ';' || path || ';' || level || ';' || title || ';' || CASE WHEN {_ITEMS} THEN '' ELSE start_date END || ';' || CASE WHEN {_ITEMS} THEN '' ELSE end_date END) + 1) / 3.5) AS BIGINT) FROM w""",
)
over_inventory("j9_recommend_sampling", lambda inv: joins.recommend_sampling(hierarchy.items(inv).groupBy("parent_id").agg((F.count("*") * 20).alias("items"))), f"SELECT parent_id, 20 * count(*) AS items, CASE WHEN 20 * count(*) <= 200 THEN 'petit' WHEN 20 * count(*) <= 1000 THEN 'moyen' WHEN 20 * count(*) <= 5000 THEN 'grand' ELSE 'très grand' END AS tier, CASE WHEN 20 * count(*) <= 200 THEN 0 WHEN 20 * count(*) <= 1000 THEN 5 WHEN 20 * count(*) <= 5000 THEN 3 ELSE 2 END AS sample_n FROM inventory WHERE {_ITEMS} GROUP BY parent_id")
register("w4_diverse_examples", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY apos) AS rn FROM assignments) SELECT path, target, new_title FROM r ORDER BY rn > 1, apos LIMIT 12")(lambda spark, sf: windows.diverse_examples(T.assignments(spark, sf).withColumnRenamed("apos", "pos")).select("path", "target", "new_title"))
register("w5_assign_folder_ids", "WITH f AS (SELECT DISTINCT folder FROM plan) SELECT folder, CAST((SELECT max(CAST(id AS BIGINT)) FROM inventory) + row_number() OVER (ORDER BY folder) AS VARCHAR) AS id FROM f")(lambda spark, sf: windows.assign_folder_ids(T.plan(spark, sf), T.inventory(spark, sf)))
over_inventory("w6_dedup_names", lambda inv: windows.dedup_names(hierarchy.items(inv).select("id", "parent_id", "pos", "title"), "parent_id", "title").select("id", "title"), f"WITH r AS (SELECT id, title, row_number() OVER (PARTITION BY parent_id, lower(title) ORDER BY pos) AS k FROM inventory WHERE {_ITEMS}) SELECT id, CASE WHEN k = 1 THEN title ELSE title || ' (' || k || ')' END AS title FROM r")
over_inventory("w7_strip_folder_numbers", lambda inv: windows.strip_folder_numbers(hierarchy.folders(inv).withColumn("path", F.concat(F.col("pos") % 97, F.lit("_lot_"), F.col("pos") % 5))).select("id", "path", "renamed"), f"WITH r AS (SELECT id, 'lot_' || pos % 5 AS n, row_number() OVER (PARTITION BY parent_id, pos % 5 ORDER BY pos) AS k FROM inventory WHERE {_FOLDERS}) SELECT id, CASE WHEN k = 1 THEN n ELSE n || '_' || k END AS path, k > 1 AS renamed FROM r")
register("w9_pair_events", "WITH e AS (SELECT conv_id, turn, role, lag(role) OVER w AS pr, lag(turn) OVER w AS pt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, pt AS call_turn FROM e WHERE role = 'assistant' AND pr = 'user'")(
    lambda spark, sf: windows.pair_events(_conversation_events(spark, sf)).select(F.col("run_id").alias("conv_id"), F.col("seq").alias("turn"), F.col("call_seq").alias("call_turn"))
)


def _conversation_events(spark, sf) -> DataFrame:
    kind = F.when(F.col("role") == "user", "tool").when(F.col("role") == "assistant", "toolResult").otherwise("tool_other")
    rows = T.source(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.lit("c").alias("case_id"), F.col("turn").alias("seq"), kind.alias("type"), F.lit("search").alias("name"), F.col("text").alias("arguments"), F.col("text").alias("result"))
    return rows.withColumns({"name": F.when(F.col("type") == "tool_other", "other").otherwise("search"), "type": F.when(F.col("type") == "tool_other", "tool").otherwise(F.col("type"))})


over_both("w10_keep_last", lambda asg, inv: windows.keep_last(asg, ["path"], ["apos"]).select("path", "target"), "SELECT path, arg_max(target, apos) AS target FROM assignments GROUP BY path")
over_both("w10_keep_first", lambda asg, inv: windows.keep_first(asg, ["path"], ["apos"]).select("path", "target"), "SELECT path, arg_min(target, apos) AS target FROM assignments GROUP BY path")
over_both("a19_redundant_assignments", lambda asg, inv: windows.redundant_assignments(asg), "SELECT path, count(*) AS n FROM assignments GROUP BY path HAVING count(*) > 1")
register("o2_natural_plan_order", "SELECT folder, row_number() OVER (ORDER BY string_split(folder, '_')[1] = '', [CAST(p AS BIGINT) FOR p IN string_split(string_split(folder, '_')[1], '-')], lower(folder)) AS place FROM plan")(lambda spark, sf: explore.number_rows(T.plan(spark, sf).withColumn("key", windows.natural_plan_order(F.col("folder"))), ["key"], "place").select("folder", "place"))
over_inventory("o3_id_order", lambda inv: _ordered_ids(hierarchy.folders(inv).select(F.when(F.col("pos") % 3 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")).alias("id"))), f"WITH i AS (SELECT CASE WHEN pos % 3 = 0 THEN 'x' || id ELSE id END AS id FROM inventory WHERE {_FOLDERS}) SELECT id, row_number() OVER (ORDER BY try_cast(id AS BIGINT) IS NULL, try_cast(id AS BIGINT), id) AS place FROM i")


def _ordered_ids(ids: DataFrame) -> DataFrame:
    keys = {f"__o{k}": c for k, c in enumerate(windows.id_order(F.col("id")))}
    return explore.number_rows(ids.withColumns(keys), list(keys), "place").select("id", "place")


# joins

over_both("j1_rehydrate_paths", lambda asg, inv: joins.rehydrate_paths(windows.assign_ref(inv).select(F.when(F.col("ref") % 10 == 0, "?").otherwise(F.concat(F.lit(" "), F.col("ref"))).alias("ref"), F.col("title").alias("new_title")), windows.assign_ref(inv)).select("path", "new_title"), f"WITH r AS (SELECT row_number() OVER (ORDER BY pos, path) AS ref, path, title FROM inventory WHERE {_ITEMS}) SELECT CASE WHEN ref % 10 = 0 THEN '' ELSE path END AS path, title AS new_title FROM r")
over_both("j2_attach_source", lambda asg, inv: joins.attach_source(asg, inv).select("path", "apos", "id", "start_date"), f"WITH f AS (SELECT path, arg_min(id, pos) AS id, arg_min(start_date, pos) AS start_date FROM inventory WHERE {_ITEMS} GROUP BY path) SELECT path, apos, id, start_date FROM assignments JOIN f USING (path)")
over_both("j3_unclassified", lambda asg, inv: joins.unclassified(inv, asg).select("id"), f"SELECT id FROM inventory WHERE {_ITEMS} AND path NOT IN (SELECT path FROM assignments)")
over_both("j4_unknown_paths", lambda asg, inv: joins.unknown_paths(inv, asg).select("path", "target"), f"SELECT path, target FROM assignments WHERE path NOT IN (SELECT path FROM inventory WHERE {_ITEMS})")
register("j5_match_targets", "SELECT path, apos, folder AS plan_folder FROM assignments LEFT JOIN plan ON target = folder")(lambda spark, sf: joins.match_targets(T.assignments(spark, sf), T.plan(spark, sf)).select("path", "apos", "plan_folder"))
over_inventory("j6_orphans", lambda inv: checks.orphans(inv.where("pos <> 101")).select("id"), "SELECT id FROM inventory WHERE pos <> 101 AND parent_id <> '' AND parent_id NOT IN (SELECT id FROM inventory WHERE pos <> 101)")
register("j7_plan_parents", "SELECT plan_id, pos, folder, parent FROM plan")(lambda spark, sf: joins.plan_parents(T.plan(spark, sf)))
register("j10_retained_folders", f"WITH u AS (SELECT DISTINCT folder FROM ({_CHAIN})), sl AS (SELECT coalesce(nullif(title, ''), {_base()}) AS b, {_base()} AS base, path, pos FROM inventory WHERE {_FOLDERS}), pl AS (SELECT {_conserved('folder')} AS label FROM plan UNION SELECT {_conserved("coalesce(nullif(trim(regexp_replace(strip_accents(base), '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'Nouveau_dossier')")} FROM sl WHERE pos % 3 = 0), src AS (SELECT DISTINCT {_conserved('b')} AS label FROM sl WHERE path IN (SELECT folder FROM u)) SELECT label, label IN (SELECT label FROM pl) AS retained FROM src WHERE label <> ''")(lambda spark, sf: joins.retained_folders(T.inventory(spark, sf), T.plan(spark, sf).unionByName(hierarchy.folders(T.inventory(spark, sf)).where("pos % 3 = 0").select(F.lit("plan").alias("plan_id"), "pos", X.slugify(X.basename(F.col("path"))).alias("folder"), F.lit(None).cast("string").alias("parent"), "title"))))
over_both("j18_filters_equivalent", lambda asg, inv: joins.equivalence(inv, {"extension": "pdf", "year_min": 1995}, {"extension": ".PDF", "folder": "1_AFRICA"}), f"WITH f AS (SELECT {_ext()} = 'pdf' AND coalesce(try_cast(regexp_extract(start_date, '^([0-9]{{4}})', 1) AS INT) >= 1995, false) AS a, {_ext()} = 'pdf' AND starts_with(lower(path), '1_africa/') AS b FROM inventory WHERE {_ITEMS}) SELECT count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second, count(*) FILTER (a AND b) AS both FROM f")


@register(
    "j18_many_filters",
    rf"""WITH y AS (SELECT DISTINCT try_cast(regexp_extract(start_date, '^([0-9]{{4}})', 1) AS INT) AS year FROM inventory WHERE {_ITEMS}), f AS (SELECT lower(path) AS folder, year, ext FROM inventory, y, (VALUES ('pdf'), ('doc')) e(ext) WHERE {_FOLDERS} AND length(path) - length(replace(path, '/', '')) = 1 AND year IS NOT NULL AND CAST(id AS BIGINT) < 1000),
    i AS (SELECT lower(array_to_string(string_split(path, '/')[1:2], '/')) AS folder, {_ext()} AS ext, try_cast(regexp_extract(start_date, '^([0-9]{{4}})', 1) AS INT) AS year, contains({_fold("path || ' ' || title")}, 'rapport_1') AS hit FROM inventory WHERE {_ITEMS} AND contains(path, '/')),
    c AS (SELECT folder, ext, year, count(*) AS n, count(*) FILTER (hit) AS hits FROM i GROUP BY ALL)
    SELECT f.folder, ext, year, CAST(0 AS BIGINT) AS only_first, CAST(coalesce(n - hits, 0) AS BIGINT) AS only_second, CAST(coalesce(hits, 0) AS BIGINT) AS both, coalesce(n - hits, 0) = 0 AS equal FROM f LEFT JOIN c USING (folder, ext, year)""",
)
def _many_filters(spark, sf):
    """For each nation, year and two formats, the filter with a word against the one without."""
    inv = T.inventory(spark, sf)
    years = hierarchy.items(inv).select(X.year(F.col("start_date")).cast("int").alias("year")).distinct().where("year IS NOT NULL")
    nations = hierarchy.folders(inv).where((X.depth(F.col("path")) == 2) & (F.col("id").cast("long") < 1000)).select(F.lower("path").alias("folder"))
    asked = nations.join(years).join(spark.sql("SELECT explode(array('pdf', 'doc')) AS ext"))  # every combination is asked for
    bounds = [F.col("ext").alias("extension"), F.col("folder"), F.col("year").alias("year_max"), F.col("year").alias("year_min")]
    pairs = materialise(asked.select("folder", "year", "ext", F.to_json(F.struct(*bounds, F.array(F.lit("rapport_1")).alias("keywords"))).alias("first"), F.to_json(F.struct(*bounds)).alias("second")), "asked-filters")
    bits = postings.bitmaps(inv, pairs.select(F.explode(F.array("first", "second")).alias("filter")))
    return merged(pairs, postings.compared(bits, pairs), ["first", "second"]).select("folder", "ext", "year", "only_first", "only_second", "both", "equal")




def _directives(spark, sf) -> DataFrame:
    """A directive for each plan folder, and for folders that the plan lacks."""
    p = T.plan(spark, sf)
    name = F.when(F.col("pos") % 4 == 0, F.concat("folder", F.lit("_ancien"))).otherwise(F.col("folder"))
    text = F.concat(name, F.lit(" : classer par date"), F.when(F.col("pos") % 2 == 0, " [+sous-dossiers]").otherwise(""))
    return text_io.parse_directives(p.select("pos", F.when(F.col("pos") % 5 == 0, "# rien").otherwise(text).alias("value")))


register("s8_read_directives", "SELECT pos, CASE WHEN pos % 4 = 0 THEN folder || '_ancien' ELSE folder END AS folder, 'classer par date' AS text, pos % 2 = 0 AS allow_creation FROM plan WHERE pos % 5 <> 0")(_directives)
register("j11_stale_anchors", "SELECT folder || '_ancien' AS folder, pos FROM plan WHERE pos % 5 <> 0 AND pos % 4 = 0")(lambda spark, sf: joins.stale_anchors(_directives(spark, sf), T.plan(spark, sf)))
register("j12_allowed_parents", "SELECT folder FROM plan WHERE pos % 5 <> 0 AND pos % 2 = 0 AND pos % 4 <> 0")(lambda spark, sf: joins.allowed_parents(_directives(spark, sf), T.plan(spark, sf)))
register("j17_remap_targets", "SELECT path, apos, CASE WHEN target = '9_VIDE' THEN '' WHEN target = 'Hors_plan' THEN '1_STATUT_F' ELSE target END AS target FROM assignments")(
    lambda spark, sf: joins.remap_targets(T.assignments(spark, sf), T.assignments(spark, sf).where("target = 'Hors_plan'").select(F.col("target").alias("old"), F.lit("1_STATUT_F").alias("new")), T.plan(spark, sf).where("folder = '9_VIDE'")).select("path", "apos", "target")
)


def _usage(spark, sf) -> DataFrame:
    model = F.element_at(F.array(*[F.lit(m) for m in ("gpt-5-mini-2025", "Claude-Sonnet-4", "ollama/gemini", "gemini-2.5-flash-lite", "unknown-model")]), (F.col("event_id") % 5 + 1).cast("int"))
    tokens = F.floor(F.abs("value") * 100).cast("long")
    return T.source(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("project_id"), model.alias("model"), "ts", F.when(F.col("event_type") != "error", tokens).alias("input_tokens"), F.lit(10).cast("long").alias("output_tokens"), F.when(F.col("event_type") != "error", tokens + 10).alias("total_tokens"), F.lit(None).cast("long").alias("cache_read_tokens"), F.lit(None).cast("long").alias("reasoning_tokens"), "event_type", "value")


_USAGE_SQL = "WITH u AS (SELECT event_id AS run_id, user_id AS project_id, (['gpt-5-mini-2025', 'Claude-Sonnet-4', 'ollama/gemini', 'gemini-2.5-flash-lite', 'unknown-model'])[event_id % 5 + 1] AS model, ts, event_type, value, CASE WHEN event_type <> 'error' THEN CAST(floor(abs(value) * 100) AS BIGINT) END AS input_tokens, 10 AS output_tokens FROM events)"
register("j8_price_models", f"{_USAGE_SQL} SELECT run_id, CASE event_id5 WHEN 0 THEN 'GPT-5 mini' WHEN 1 THEN 'Claude Sonnet' WHEN 3 THEN 'Gemini Flash' END AS label, CASE event_id5 WHEN 0 THEN 0.23::DOUBLE WHEN 1 THEN 2.8::DOUBLE WHEN 3 THEN 0.28::DOUBLE END AS input_eur_m FROM (SELECT *, run_id % 5 AS event_id5 FROM u)")(lambda spark, sf: joins.price_models(_usage(spark, sf), joins.price_rules(spark)).select("run_id", "label", "input_eur_m"))
register("a20_usage_sum", f"{_USAGE_SQL} SELECT project_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + 10) AS BIGINT) AS total_tokens, CAST(NULL AS BIGINT) AS cache_read_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens FROM u WHERE input_tokens IS NOT NULL GROUP BY project_id")(lambda spark, sf: runs.usage_sum(_usage(spark, sf), ("project_id",)))
register("a22_cost", f"{_USAGE_SQL} SELECT run_id % 5 AS model, round(sum(round(input_tokens / 1e6::DOUBLE * CASE run_id % 5 WHEN 0 THEN 0.23::DOUBLE WHEN 1 THEN 2.8::DOUBLE WHEN 3 THEN 0.28::DOUBLE END, 6)), 1) AS input_eur FROM u GROUP BY 1")(lambda spark, sf: runs.cost(_usage(spark, sf), joins.price_rules(spark)).groupBy((F.col("run_id") % 5).alias("model")).agg(F.round(F.sum("input_eur"), 1).alias("input_eur")))


def _projects(spark, sf) -> DataFrame:
    return _usage(spark, sf).select("project_id", F.when(F.col("event_type") == "purchase", F.lit(3)).cast("long").alias("items"), F.lit(1).cast("long").alias("folders"), F.floor("value").cast("double").alias("duration_s"), "total_tokens", F.when(F.col("event_type") == "click", F.col("value") > 10).alias("plan_matches"))


register("a25_project_metrics", f"{_USAGE_SQL} SELECT project_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 3 END) AS BIGINT) AS items, count(*) AS folders, sum(floor(value)) AS duration_s, CAST(sum(input_tokens + 10) AS BIGINT) AS total_tokens, bool_and(CASE WHEN event_type = 'click' THEN value > 10 END) AS plan_matches FROM u GROUP BY project_id")(lambda spark, sf: runs.project_metrics(_projects(spark, sf)))
register("a24_fonds_dashboard", f"{_USAGE_SQL}, p AS (SELECT project_id, sum(CASE WHEN event_type = 'purchase' THEN 3 END) AS items, sum(floor(value)) AS d, sum(input_tokens + 10) AS t, bool_and(CASE WHEN event_type = 'click' THEN value > 10 END) AS m FROM u GROUP BY project_id) SELECT count(*) AS projects, CAST(sum(items) AS BIGINT) AS items, CAST(sum(t) AS BIGINT) AS tokens, round(sum(d), 3) AS duration_s, count(m) AS measured, count(*) FILTER (m) AS matching, round(count(*) FILTER (m) / count(m), 4) AS conformity_rate FROM p")(lambda spark, sf: runs.fonds_dashboard(runs.project_metrics(_projects(spark, sf))))

# classification

_SPLIT = r"""WITH t AS (SELECT path, target, new_title, apos, [trim(s) FOR s IN string_split_regex(target, '[\\/]') IF trim(s) <> ''] AS p FROM assignments),
r AS (SELECT path, target, new_title, apos, coalesce(p[-1], '') AS folder FROM t),
known AS (SELECT DISTINCT path FROM inventory WHERE level = 'Item'),
s AS (SELECT r.*, CASE WHEN folder = '' THEN 'unknown_target' WHEN r.path NOT IN (SELECT path FROM known) THEN 'unknown_path' WHEN folder NOT IN (SELECT folder FROM plan) AND regexp_matches(folder, '\.[A-Za-z0-9]{1,6}$') THEN 'malformed' WHEN folder NOT IN (SELECT folder FROM plan) THEN 'off_plan' ELSE 'ok' END AS status,
CASE WHEN new_title = '' OR regexp_extract(regexp_extract(r.path, '[^\\/]*$'), '\.[^.]*$') = '' THEN new_title ELSE regexp_replace(new_title, '\.[^.]*$', '') || regexp_extract(regexp_extract(r.path, '[^\\/]*$'), '\.[^.]*$') END AS fixed_title FROM r)"""


def _done(spark, sf, create: bool = False, strip: bool = False) -> classify.Classified:
    p = T.plan(spark, sf)
    return classify.finalize(T.assignments(spark, sf), T.inventory(spark, sf), p, p.select("folder") if create else None, strip)


register("c3_route", f"{_SPLIT} SELECT path, apos, folder, fixed_title, status, fixed_title <> new_title AS extension_fixed FROM s")(lambda spark, sf: _done(spark, sf).status.select("path", "apos", "folder", "fixed_title", "status", "extension_fixed"))
over_both("c2_fix_extensions", lambda asg, inv: classify.fix_extensions(asg).select("path", "apos", "fixed_title"), f"{_SPLIT} SELECT path, apos, fixed_title FROM s")
register("c1_resolve_targets_with_creation")(lambda spark, sf: _done(spark, sf, True).created)
register("c4_build_folders", f"{_SPLIT}, u AS (SELECT DISTINCT folder FROM s WHERE status IN ('ok', 'off_plan')), n AS (SELECT folder FROM u UNION SELECT parent FROM plan WHERE parent IS NOT NULL AND folder IN (SELECT folder FROM u)) SELECT folder AS path, coalesce(parent, '.') AS parent, coalesce(nullif(title, ''), trim(replace(regexp_replace(folder, '^[0-9]+(-[0-9]+)*_', ''), '_', ' '))) AS title FROM n LEFT JOIN plan USING (folder)")(
    lambda spark, sf: _parents(_done(spark, sf).rows).select("path", "parent", "title")
)


def _parents(rows: DataFrame) -> DataFrame:
    dirs = rows.where("level = 'RecordGrp'")
    return dirs.where("path <> '.'").join(dirs.select(F.col("id").alias("parent_id"), F.col("path").alias("parent")), "parent_id", "left")


register("c5_build_items", f"{_SPLIT}, f AS (SELECT path, arg_min(id, pos) AS id, arg_min(start_date, pos) AS start_date FROM inventory WHERE {_ITEMS} GROUP BY path) SELECT id, path, fixed_title AS title, start_date, CASE WHEN status = 'malformed' THEN '.' ELSE folder END AS folder FROM s JOIN f USING (path) WHERE status IN ('ok', 'off_plan', 'malformed')")(
    lambda spark, sf: _placed(_done(spark, sf).rows)
)


def _placed(rows: DataFrame) -> DataFrame:
    dirs = rows.where("level = 'RecordGrp'").select(F.col("id").alias("parent_id"), F.col("path").alias("folder"))
    return rows.where("level = 'Item'").join(dirs, "parent_id").select("id", "path", "title", "start_date", "folder")


register(
    "c6_c7_dates_of_classified",
    f"""{_SPLIT}, f AS (SELECT path, arg_min(start_date, pos) AS a, arg_min(end_date, pos) AS b FROM inventory WHERE {_ITEMS} GROUP BY path),
    l AS (SELECT path, arg_max(CASE WHEN status = 'malformed' THEN '.' ELSE folder END, apos) AS folder FROM s WHERE status IN ('ok', 'off_plan', 'malformed') GROUP BY path),
    d AS (SELECT unnest(list_distinct(['.', l.folder, coalesce(plan.parent, '.')])) AS path, a, b FROM l JOIN f USING (path) LEFT JOIN plan ON plan.folder = l.folder),
    x AS (SELECT path, coalesce(min(nullif(a, '')), '') AS start_date, coalesce(max(nullif(b, '')), '') AS end_date FROM d GROUP BY path),
    u AS (SELECT DISTINCT folder FROM s WHERE status IN ('ok', 'off_plan')), n AS (SELECT folder AS path FROM u UNION SELECT parent FROM plan WHERE parent IS NOT NULL AND folder IN (SELECT folder FROM u) UNION SELECT '.')
    SELECT path, coalesce(start_date, '') AS start_date, coalesce(end_date, '') AS end_date FROM n LEFT JOIN x USING (path)""",
)(lambda spark, sf: _done(spark, sf).rows.where("level = 'RecordGrp'").select("path", "start_date", "end_date"))
register("c7_finalize_with_creation")(lambda spark, sf: _done(spark, sf, True, True).rows.select("id", "parent_id", "path", "level", "title", "start_date", "end_date"))
register(
    "c8_anomalies",
    f"""{_SPLIT}, u AS (SELECT DISTINCT folder FROM s WHERE status IN ('ok', 'off_plan')), n AS (SELECT folder FROM u UNION SELECT parent FROM plan WHERE parent IS NOT NULL AND folder IN (SELECT folder FROM u)),
    a AS (SELECT 'nonClasse' AS category, path AS item, '' AS detail, true AS is_item FROM inventory WHERE {_ITEMS} AND path NOT IN (SELECT path FROM s)
    UNION ALL SELECT 'cibleInconnue', path, target, true FROM s WHERE status = 'unknown_target' UNION ALL SELECT 'pathIntrouvable', path, target, false FROM s WHERE status = 'unknown_path'
    UNION ALL SELECT 'cibleMalformee', path, target, true FROM s WHERE status = 'malformed' UNION ALL SELECT 'horsPlan', folder, '', false FROM n WHERE folder NOT IN (SELECT folder FROM plan)
    UNION ALL SELECT 'nonRealise', folder, '', false FROM plan WHERE folder NOT IN (SELECT folder FROM n) UNION ALL SELECT 'extension', path, new_title || ' → ' || fixed_title, true FROM s WHERE fixed_title <> new_title AND status IN ('ok', 'off_plan', 'malformed'))
    SELECT category, item, detail, is_item FROM a""",
)(lambda spark, sf: classify.anomalies(_done(spark, sf), T.inventory(spark, sf), T.plan(spark, sf)))
register("a18_anomaly_counts")(lambda spark, sf: classify.anomaly_counts(classify.anomalies(_done(spark, sf, True), T.inventory(spark, sf), T.plan(spark, sf))))
register(
    "a17_classification_counters",
    f"""{_SPLIT} SELECT (SELECT count(*) FROM inventory WHERE {_ITEMS}) AS total, count(*) FILTER (status IN ('ok', 'off_plan', 'malformed')) AS classified, (SELECT count(*) FROM inventory WHERE {_ITEMS} AND path NOT IN (SELECT path FROM s)) AS unclassified, count(*) FILTER (status = 'malformed') AS malformed,
    count(*) FILTER (status IN ('ok', 'off_plan', 'malformed') AND fixed_title <> new_title) AS extensions_fixed, count(*) FILTER (status = 'unknown_target') AS targets_unknown, count(*) FILTER (status = 'unknown_path') AS paths_not_found, CAST(0 AS BIGINT) AS refs_unresolved FROM s""",
)(lambda spark, sf: classify.counters(_done(spark, sf).status, T.inventory(spark, sf)).drop("classified_pct"))
_FIGURES = f"""{_SPLIT}, z AS (SELECT (SELECT count(*) FROM inventory WHERE {_ITEMS}) AS total, count(*) FILTER (status IN ('ok', 'off_plan', 'malformed')) AS classified, (SELECT count(*) FROM inventory WHERE {_ITEMS} AND path NOT IN (SELECT path FROM s)) AS unclassified, count(*) FILTER (status = 'malformed') AS malformed,
count(*) FILTER (status IN ('ok', 'off_plan', 'malformed') AND fixed_title <> new_title) AS extensions_fixed, count(*) FILTER (status = 'unknown_target') AS targets_unknown, count(*) FILTER (status = 'unknown_path') AS paths_not_found, CAST(0 AS BIGINT) AS refs_unresolved FROM s)"""
_SHARES = ", ".join(f"{c}, round(100.0 * {c} / total, 1) AS {c}_pct" for c in ("classified", "unclassified", "malformed", "extensions_fixed", "targets_unknown", "paths_not_found", "refs_unresolved"))
register("e2_classement_metrics", f"{_FIGURES} SELECT total, {_SHARES} FROM z")(lambda spark, sf: evaluate.classement_metrics(classify.counters(_done(spark, sf).status, T.inventory(spark, sf))))


@register("a16_conformity", f"{_SPLIT}, u AS (SELECT DISTINCT folder FROM s WHERE status IN ('ok', 'off_plan')), n AS (SELECT folder FROM u UNION SELECT parent FROM plan WHERE parent IS NOT NULL AND folder IN (SELECT folder FROM u)) SELECT (SELECT count(*) FROM plan) AS plan_folders, count(*) AS output_folders, count(*) FILTER (folder NOT IN (SELECT folder FROM plan)) AS off_plan, (SELECT count(*) FROM plan WHERE folder NOT IN (SELECT folder FROM n)) AS missing, false AS plan_matches FROM n")
def _conformity(spark, sf):
    done = _done(spark, sf)
    return classify.conformity(T.plan(spark, sf), done.rows.where("level = 'RecordGrp' AND path <> '.'").select(F.col("path").alias("folder")), done.created)


register("u6_off_plan", "SELECT DISTINCT target AS folder FROM assignments WHERE target NOT IN (SELECT folder FROM plan)")(lambda spark, sf: sets.off_plan(T.plan(spark, sf), T.assignments(spark, sf).select(F.col("target").alias("folder"))))
_KEPT = f"""{_SPLIT}, f AS (SELECT path, arg_min(start_date, pos) AS a, arg_min(end_date, pos) AS b FROM inventory WHERE {_ITEMS} GROUP BY path), y AS (SELECT path, CASE WHEN status = 'malformed' THEN '.' ELSE folder END AS folder, apos, a, b FROM s JOIN f USING (path) WHERE status IN ('ok', 'off_plan', 'malformed')),
u AS (SELECT DISTINCT folder FROM s WHERE status IN ('ok', 'off_plan')), n AS (SELECT folder FROM u UNION SELECT parent FROM plan WHERE parent IS NOT NULL AND folder IN (SELECT folder FROM u))"""
register("a26_coverage_report", f"{_KEPT}, o AS (SELECT count(*) AS c FROM inventory WHERE {_ITEMS}) SELECT c AS original_items, (SELECT count(*) FROM n) AS new_folders, (SELECT count(*) FROM y) AS new_items, (SELECT count(*) FROM y WHERE a = '') AS undated_items, c - (SELECT count(*) FROM y) AS missing FROM o")(lambda spark, sf: runs.coverage_report(T.inventory(spark, sf), _done(spark, sf).rows))
register("a27_manifest_summary", f"{_KEPT} SELECT (SELECT count(*) FROM n) AS folders, count(*) AS items, (SELECT CAST(max(CASE WHEN parent IS NULL THEN 1 ELSE 2 END) AS BIGINT) FROM n LEFT JOIN plan USING (folder)) AS max_depth, coalesce(min(nullif(a, '')), '') AS start_date, coalesce(max(nullif(b, '')), '') AS end_date FROM y")(lambda spark, sf: runs.manifest_summary(_done(spark, sf).rows))
register("c9_copy_preview")(lambda spark, sf: classify.copy_preview(_done(spark, sf).rows))
register("j16_verify_copy")(lambda spark, sf: joins.verify_copy(*_preview_and_listing(spark, sf)))


def _preview_and_listing(spark, sf) -> tuple[DataFrame, DataFrame]:
    preview = classify.copy_preview(_done(spark, sf).rows).select("source", "target_path")
    return preview, preview.where(F.pmod(F.xxhash64("target_path"), F.lit(10)) > 0).select(F.col("target_path").alias("path"))


over_both("c10_worklist", lambda asg, inv: classify.worklist(asg, inv, "", True).select("path", "target", "duplicate", "unclassified"), f"WITH n AS (SELECT path, count(*) AS c FROM assignments GROUP BY path) SELECT path, target, true AS duplicate, false AS unclassified FROM assignments JOIN n USING (path) WHERE c > 1 UNION ALL SELECT path, '', false, true FROM inventory WHERE {_ITEMS} AND path NOT IN (SELECT path FROM n)")
over_both("o5_triage_order", lambda asg, inv: explore.number_rows(classify.worklist(asg, inv).withColumns(windows.triage_keys()), [*windows.triage_keys(), "path"], "place").select("path", "pos", "place"), f"WITH n AS (SELECT path, count(*) AS c FROM assignments GROUP BY path), w AS (SELECT path, apos AS pos, c > 1 AS duplicate FROM assignments JOIN n USING (path) UNION ALL SELECT path, pos, false FROM inventory WHERE {_ITEMS} AND path NOT IN (SELECT path FROM n)) SELECT path, pos, row_number() OVER (ORDER BY NOT duplicate, CASE WHEN duplicate THEN path ELSE '' END, pos, path) AS place FROM w")
register("c11_clean_exemplars", "WITH g AS (SELECT path, arg_min(target, apos) AS target, min(apos) AS apos FROM assignments WHERE target IN (SELECT folder FROM plan) GROUP BY path), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY apos) AS rn FROM g) SELECT path, target FROM r ORDER BY rn > 1, apos LIMIT 12")(lambda spark, sf: classify.clean_exemplars(T.assignments(spark, sf), T.plan(spark, sf)).select("path", "target"))


@register("c12_pending_batches", f"WITH r AS (SELECT row_number() OVER (ORDER BY pos, path) AS ref FROM inventory WHERE {_ITEMS}), b AS (SELECT (ref - 1) // 400 AS batch, count(*) AS n FROM r GROUP BY 1) SELECT batch, n FROM b WHERE batch % 3 = 0 OR batch % 5 = 0")
def _pending(spark, sf):
    refs = materialise(windows.batch_slices(windows.assign_ref(T.inventory(spark, sf)), 400).select("batch"), "refs")
    stored = refs.groupBy("batch").agg(F.count("*").alias("n_rows")).where("batch % 3 <> 0").withColumn("raw_text", F.when(F.col("batch") % 5 == 0, " ").otherwise("x"))
    return classify.pending_batches(refs, stored)


# plans


def _plan_texts(spark, sf) -> DataFrame:
    """A plan for each customer, as text: the priorities of their orders, and a folder in each."""
    rows = spark.sql(T.PLAN_TEXTS, orders=T.source(spark, sf, "orders"))
    k = F.row_number().over(Window.partitionBy("plan_id").orderBy("segment"))
    slug, k = X.slugify(F.initcap("segment")), k.cast("string")
    lines = rows.select("plan_id", F.concat(F.lit("├─ "), k, F.lit(". "), F.initcap("segment"), F.lit(" → "), k, F.lit("_"), slug, F.lit("/\n│  └─ "), k, F.lit(".1. Clients -> "), k, F.lit("-1_Clients_"), slug, F.lit("/")).alias("line"))
    return lines.groupBy("plan_id").agg(F.concat(F.lit("## Arborescence technique\nDossier_racine/\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\nPréconisations\n8_Rien/")).alias("text"))


_PLANS_SQL = "WITH f0 AS (SELECT DISTINCT 'plan_' || o_custkey AS plan_id, replace(o_orderpriority[3:], ' ', '') AS segment FROM orders), g AS (SELECT plan_id, segment, upper(segment[1]) || lower(segment[2:]) AS s FROM f0), h AS (SELECT plan_id, s, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY segment) AS VARCHAR) AS k FROM g), pp AS (SELECT plan_id, k || '_' || s AS folder, CAST(NULL AS VARCHAR) AS parent, s AS title FROM h UNION ALL SELECT plan_id, k || '-1_Clients_' || s, k || '_' || s, 'Clients' FROM h)"
register("r1_parse_plan", f"{_PLANS_SQL} SELECT plan_id, folder, parent FROM pp")(lambda spark, sf: P.parse_plans(_plan_texts(spark, sf)).select("plan_id", "folder", "parent"))
register("r2_parse_titles", f"{_PLANS_SQL} SELECT plan_id, folder, title FROM pp")(lambda spark, sf: P.parse_titles(_plan_texts(spark, sf)))
register("r3_render_plan")(lambda spark, sf: P.render_plans(P.plan_nodes(_plan_texts(spark, sf))))
register("r3_round_trip", f"{_PLANS_SQL} SELECT plan_id, folder, parent, title FROM pp")(lambda spark, sf: P.parse_plans(P.render_plans(P.plan_nodes(_plan_texts(spark, sf)))).select("plan_id", "folder", "parent", "title"))
over_inventory("r4_plan_from_inventory", lambda inv: P.plan_from_inventory(inv).select("id", "parent_id", "title"), f"SELECT id, CASE WHEN parent_id = '1' THEN '' ELSE parent_id END AS parent_id, coalesce(nullif(title, ''), trim(replace(regexp_replace({_base()}, '^[0-9]+(-[0-9]+)*_', ''), '_', ' '))) AS title FROM inventory WHERE {_FOLDERS}")
register("r7_plan_nodes", f"{_PLANS_SQL} SELECT plan_id, folder AS id, coalesce(parent, '') AS parent_id, title, regexp_replace(folder, '^[0-9]+(-[0-9]+)*_', '') AS slug FROM pp")(lambda spark, sf: P.plan_nodes(_plan_texts(spark, sf)).drop("pos"))
register("r8_materialised_paths", f"{_PLANS_SQL} SELECT plan_id, folder, CASE WHEN parent IS NULL THEN '' ELSE regexp_replace(parent, '^[0-9]+(-[0-9]+)*_', '') || '/' END || regexp_replace(folder, '^[0-9]+(-[0-9]+)*_', '') AS path FROM pp")(lambda spark, sf: P.plan_paths(P.parse_plans(_plan_texts(spark, sf))))
register("r9_rubric_labels", f"{_PLANS_SQL}, one AS (SELECT plan_id FROM h GROUP BY plan_id HAVING count(*) = 1) SELECT plan_id, lower(replace(regexp_replace(folder, '^[0-9]+(-[0-9]+)*_', ''), '_', ' ')) AS label FROM pp WHERE NOT (parent IS NULL AND plan_id IN (SELECT plan_id FROM one))")(lambda spark, sf: P.rubric_labels(P.parse_plans(_plan_texts(spark, sf))))
register("r6_plan_shapes", f"{_PLANS_SQL} SELECT plan_id, count(*) AS folders, CAST(2 AS BIGINT) AS depth, count(*) FILTER (parent IS NULL) AS max_children, count(*) FILTER (parent IS NOT NULL) AS leaves FROM pp GROUP BY plan_id")(lambda spark, sf: P.compare_variants(P.parse_plans(_plan_texts(spark, sf)))["shapes"])
register("a28_plan_ranges", f"{_PLANS_SQL}, s AS (SELECT plan_id, count(*) AS f, count(*) FILTER (parent IS NOT NULL) AS l FROM pp GROUP BY plan_id) SELECT min(f) AS min_folders, max(f) AS max_folders, CAST(2 AS BIGINT) AS min_depth, CAST(2 AS BIGINT) AS max_depth, min(l) AS min_leaves, max(l) AS max_leaves FROM s")(lambda spark, sf: P.compare_variants(P.parse_plans(_plan_texts(spark, sf)))["ranges"])
register("u3_u5_folders_of_variants", f"{_PLANS_SQL}, l AS (SELECT DISTINCT plan_id, lower(replace(regexp_replace(folder, '^[0-9]+(-[0-9]+)*_', ''), '_', ' ')) AS label FROM pp) SELECT label, count(*) AS n_plans, count(*) = (SELECT count(DISTINCT plan_id) FROM l) AS common, count(*) = 1 AS \"unique\" FROM l GROUP BY label")(lambda spark, sf: P.compare_variants(P.parse_plans(_plan_texts(spark, sf)))["folders"])
register("w11_plan_numbering", f"{_PLANS_SQL} SELECT plan_id, folder AS id, regexp_extract(folder, '^([0-9]+(-[0-9]+)*)_', 1) AS number FROM pp")(lambda spark, sf: P.plan_numbering(P.plan_nodes(_plan_texts(spark, sf))).select("plan_id", "id", "number"))


def _two_states(spark, sf) -> tuple[DataFrame, DataFrame]:
    old = P.plan_paths(P.parse_plans(_plan_texts(spark, sf))).select("plan_id", "path")
    new = old.select("plan_id", F.regexp_replace("path", "^Urgent", "Pressant").alias("path")).where("path NOT LIKE 'Low%'")
    return old, new


_PATHS = f"{_PLANS_SQL}, p8 AS (SELECT plan_id, CASE WHEN parent IS NULL THEN '' ELSE regexp_replace(parent, '^[0-9]+(-[0-9]+)*_', '') || '/' END || regexp_replace(folder, '^[0-9]+(-[0-9]+)*_', '') AS path FROM pp), new8 AS (SELECT plan_id, regexp_replace(path, '^Urgent', 'Pressant') AS path FROM p8 WHERE path NOT LIKE 'Low%')"
register("u7_plan_path_diff", f"{_PATHS}, a8 AS (SELECT DISTINCT plan_id || '/' || path AS path FROM p8), b8 AS (SELECT DISTINCT plan_id || '/' || path AS path FROM new8) SELECT coalesce(a8.path, b8.path) AS path, CASE WHEN a8.path IS NULL THEN 'added' WHEN b8.path IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM a8 FULL JOIN b8 ON a8.path = b8.path")(lambda spark, sf: sets.plan_path_diff(*[d.select(F.concat_ws("/", "plan_id", "path").alias("path")) for d in _two_states(spark, sf)]))
register("r5_diff_plans", f"{_PATHS} SELECT plan_id, path AS old_path, path AS new_path, 'unchanged' AS change FROM p8 JOIN new8 USING (plan_id, path) UNION ALL SELECT plan_id, path, 'Pressant', 'renamed' FROM p8 WHERE path = 'Urgent' UNION ALL SELECT plan_id, path, NULL, 'removed' FROM p8 WHERE path LIKE 'Low%'")(lambda spark, sf: differences.diff_plans(*_two_states(spark, sf)))
register("r5_summaries", f"{_PATHS}, n8 AS (SELECT plan_id, count(*) FILTER (path NOT LIKE 'Urgent%' AND path NOT LIKE 'Low%') AS u, count(*) FILTER (path = 'Urgent') AS r, count(*) FILTER (path LIKE 'Low%') AS l FROM p8 GROUP BY plan_id) SELECT plan_id, u AS unchanged, r AS renamed, CAST(0 AS BIGINT) AS moved, l AS removed, CAST(0 AS BIGINT) AS added, r + l = 0 AS identical FROM n8")(lambda spark, sf: differences.summaries(differences.diff_plans(*_two_states(spark, sf))))
register("j15_match_subtrees", f"{_PATHS} SELECT plan_id, '' AS parent, CAST(1 AS BIGINT) AS n_old, CAST(1 AS BIGINT) AS n_new FROM p8 WHERE path = 'Urgent'")(lambda spark, sf: _subtrees_gone_and_come(spark, sf))


def _subtrees_gone_and_come(spark, sf) -> DataFrame:
    """Groups of equal subtrees among the top folders that are gone and those that came."""
    a, b = (materialise(differences.subtree_signatures(d), "signatures") for d in _two_states(spark, sf))
    gone, came = (merged(x.where("parent = ''"), y.select("plan_id", "path"), ["plan_id", "path"], "left_anti") for x, y in ((a, b), (b, a)))
    return joins.match_subtrees(gone, came, "parent").drop("sig")


_NUMBER = "regexp_extract({}, '^([0-9]+(-[0-9]+)*)_', 1)"
register("q8_check_plan_text", f"{_PLANS_SQL}, l8 AS (SELECT * FROM pp WHERE NOT starts_with(folder, '2_')) SELECT plan_id, 'missing_parent' AS rule, count(*) AS n FROM l8 WHERE contains({_NUMBER.format('folder')}, '-') AND (plan_id, regexp_replace({_NUMBER.format('folder')}, '-[0-9]+$', '')) NOT IN (SELECT (plan_id, {_NUMBER.format('folder')}) FROM l8) GROUP BY plan_id UNION ALL SELECT plan_id, 'duplicate_name', count(*) FROM (SELECT plan_id, lower(folder) FROM l8 GROUP BY ALL HAVING count(*) > 1) GROUP BY plan_id")(lambda spark, sf: checks.check_plan_text(P.plan_lines(_plan_texts(spark, sf)).where("folder NOT LIKE '2\\_%'")))
register("q9_check_plan_nodes", f"{_PLANS_SQL} SELECT plan_id, 'root_count' AS rule, count(*) FILTER (parent IS NULL) AS n FROM pp GROUP BY plan_id HAVING count(*) FILTER (parent IS NULL) <> 1 UNION ALL SELECT plan_id, 'bad_slug', count(*) FROM pp WHERE NOT regexp_matches(regexp_replace(folder, '^[0-9]+(-[0-9]+)*_', ''), '^[A-Za-z0-9_]+$') GROUP BY plan_id")(lambda spark, sf: checks.check_plan_nodes(P.plan_nodes(_plan_texts(spark, sf))))
register("w8_number_created", "WITH a AS (SELECT DISTINCT folder AS parent, 'Sujet_' || pos % 3 AS slug FROM plan UNION ALL SELECT folder, 'Autre' FROM plan), k AS (SELECT substring(folder, 1, 1) AS p, max(CAST(substring(folder, 3, 1) AS BIGINT)) AS top FROM plan WHERE parent IS NOT NULL GROUP BY 1), r AS (SELECT parent, slug, string_split(parent, '_')[1] AS prefix, row_number() OVER (PARTITION BY parent ORDER BY slug) AS n FROM a) SELECT parent, slug, prefix || '-' || (n + coalesce(top, 0)) || '_' || slug AS folder FROM r LEFT JOIN k ON p = prefix")(
    lambda spark, sf: windows.number_created(T.plan(spark, sf).select(F.col("folder").alias("parent"), F.concat(F.lit("Sujet_"), F.col("pos") % 3).alias("slug")).unionByName(T.plan(spark, sf).select(F.col("folder").alias("parent"), F.lit("Autre").alias("slug"))), T.plan(spark, sf))
)

# sources


def _answers(spark, sf) -> DataFrame:
    """Assignments as raw answers, a fenced block for each batch of about 400."""
    a = T.assignments(spark, sf).withColumn("batch_id", F.floor(F.col("apos") / 800).cast("string"))
    line = F.concat_ws(";", "path", "target", "new_title")
    return a.groupBy("batch_id").agg(F.concat(F.lit("Voici :\n```csv\nPath;TargetFolder;NewTitle\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("apos", line.alias("l")))), lambda x: x["l"]), "\n"), F.lit("\n[FIN LOT]\n```\nVoilà.")).alias("raw_text"))


register("s6_reordered_and_short_rows", "SELECT CAST(apos // 800 AS VARCHAR) AS batch_id, path, CASE WHEN apos // 800 % 3 = 2 THEN '' ELSE target END AS target, CASE WHEN apos // 800 % 3 = 0 THEN new_title ELSE '' END AS new_title FROM assignments WHERE apos // 800 % 3 < 2 OR target <> ''")(lambda spark, sf: text_io.ingest_responses(_odd_answers(spark, sf)).drop("line"))


def _odd_answers(spark, sf) -> DataFrame:
    """Answers with their columns in another order, rows of two fields, and rows with an index whose target is empty."""
    a = T.assignments(spark, sf).withColumns({"batch_id": F.floor(F.col("apos") / 800).cast("string"), "kind": F.floor(F.col("apos") / 800) % 3})
    line = F.when(F.col("kind") == 0, F.concat_ws(";", "target", "path", "new_title")).when(F.col("kind") == 1, F.concat_ws(";", "path", "target")).otherwise(F.concat_ws(";", "apos", "path", F.lit("")))
    head = F.when(F.col("kind") == 0, "TargetFolder;Path;NewTitle").when(F.col("kind") == 1, "Path;TargetFolder;NewTitle").otherwise("#;Path;TargetFolder;NewTitle")
    lines = a.where("kind < 2 OR target <> ''").groupBy("batch_id", head.alias("head")).agg(F.array_sort(F.collect_list(F.struct("apos", line.alias("l")))).alias("rows"))
    return lines.select("batch_id", F.concat(F.lit("Voici :\n```csv\n"), "head", F.lit("\n"), F.array_join(F.transform("rows", lambda x: x["l"]), "\n"), F.lit("\n```")).alias("raw_text"))


register("s6_ingest_responses", "SELECT path, target, new_title, CAST(apos // 800 AS VARCHAR) AS batch_id FROM assignments")(lambda spark, sf: text_io.ingest_responses(_answers(spark, sf)).drop("line"))


@register("s1_s2_write_and_read_inventory", "SELECT id, parent_id, path, level, title, start_date, end_date, fingerprint FROM inventory")
def _round_trip(spark, sf):
    path = new_path(spark, "inventory-csv")
    inv_io.write_inventory(T.inventory(spark, sf), path)
    back = inv_io.read_inventory(spark, path)
    return back.select("id", "parent_id", "path", "level", "title", "start_date", "end_date", "fingerprint")


@register("n1_normalize_native", "WITH r AS (SELECT id, parent_id, path, level, title, row_number() OVER (ORDER BY pos, id) AS n FROM inventory) SELECT CAST(r.n AS VARCHAR) AS id, coalesce(CAST(p.n AS VARCHAR), '') AS parent_id, r.path, r.level, r.title FROM r LEFT JOIN r AS p ON r.parent_id = p.id")
def _native(spark, sf):
    raw = T.inventory(spark, sf).select(F.concat(F.lit("Import-"), "id").alias("Id"), F.when(F.col("parent_id") != "", F.concat(F.lit("Import-"), "parent_id")).alias("ParentId"), F.col("level").alias("Content.DescriptionLevel"), F.col("title").alias("Content.Title"), F.translate("path", "/", "\\").alias("ObjectFiles"), "pos")
    return inv_io.normalize_native(raw).select("id", "parent_id", "path", "level", "title")


@register("s3_inventory_of_listing")
def _listing(spark, sf):
    files = hierarchy.items(T.inventory(spark, sf)).groupBy("path").agg(F.min("start_date").alias("date"))
    return inv_io.inventory_of_listing(files).select("id", "parent_id", "path", "level", "title", "start_date", "end_date")


register("s4_fingerprint", "SELECT doc_id AS id, sha256(text) AS fingerprint, 'hashed' AS fingerprint_status FROM documents")(lambda spark, sf: inv_io.fingerprint(_documents_inventory(spark, sf), T.source(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))).select("id", "fingerprint", "fingerprint_status"))


def _documents_inventory(spark, sf) -> DataFrame:
    return T.source(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d/"), "doc_id").alias("path"), F.lit("Item").alias("level"))


register("s7_normalise_corrections", "SELECT trim(path) AS path, target, trim(new_title) AS new_title FROM assignments WHERE target <> ''")(lambda spark, sf: text_io.normalise_corrections(T.assignments(spark, sf).select(F.concat(F.lit(" "), "path").alias("Path"), F.col("target").alias("targetFolder"), F.col("new_title").alias("new_title"))).drop("pos"))
register("u8_merge_corrections", "SELECT path, arg_max(target, apos + apos % 2 * 10000000000) AS target, arg_max(new_title, apos + apos % 2 * 10000000000) AS new_title FROM assignments GROUP BY path")(lambda spark, sf: sets.merge_corrections(*[T.assignments(spark, sf).where(f"apos % 2 = {k}").withColumnRenamed("apos", "pos") for k in (0, 1)]).drop("place"))
register("s12_manifest", f"{_KEPT}, d AS (SELECT unnest(list_distinct([l.folder, coalesce(plan.parent, l.folder)])) AS folder, a, b FROM (SELECT path, arg_max(folder, apos) AS folder, any_value(a) AS a, any_value(b) AS b FROM y GROUP BY path) AS l LEFT JOIN plan ON plan.folder = l.folder), x AS (SELECT folder, min(nullif(a, '')) AS a, max(nullif(b, '')) AS b FROM d GROUP BY folder) SELECT coalesce(parent || '/', '') || n.folder AS path, coalesce(nullif(title, ''), trim(replace(regexp_replace(n.folder, '^[0-9]+(-[0-9]+)*_', ''), '_', ' '))) AS title, coalesce(a, '') AS start_date, coalesce(b, '') AS end_date FROM n LEFT JOIN plan ON plan.folder = n.folder LEFT JOIN x ON x.folder = n.folder".replace("SELECT coalesce(parent", "SELECT n.folder AS name, 'RecordGrp' AS level, coalesce(parent"))(lambda spark, sf: inv_io.manifest(_done(spark, sf).rows)[0])


@register("s11_run_ledger")
def _ledger(spark, sf):
    path = new_path(spark, "ledger")
    kind = "array<struct<category:string,item:string,detail:string>>"
    rows = _usage(spark, sf).select(F.col("run_id").cast("string").alias("run_id"), F.col("ts").alias("started_at"), "model", "total_tokens", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("outcome"), F.lit(None).cast("string").alias("error"), F.array().cast(kind).alias("anomalies"))
    text_io.append_ledger(rows, path)
    return spark.read.parquet(path).groupBy("day", "outcome").agg(F.count("*").alias("n"), F.sum(F.size("anomalies")).alias("anomalies"))


ORACLE["s11_run_ledger"] = "SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome, count(*) AS n, count(*) FILTER (event_type = 'error') AS anomalies FROM events GROUP BY 1, 2"

# content

_WORDS = f"WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})', '[email]@\\1', 'g'), '[A-Za-zÀ-ÖØ-öø-ÿ]{{3,}}'))) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ({_list((*X.STOP_WORDS, *X.PLACEHOLDER_WORDS))}) GROUP BY ALL HAVING count(*) >= 2)"
register("a14_recurring_keywords", f"{_WORDS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS INT) AS rank FROM c) SELECT doc_id, word, n, rank FROM r WHERE rank <= 6")(lambda spark, sf: content.recurring_keywords(T.source(spark, sf, "documents")))


def _sections(spark, sf) -> DataFrame:
    return T.source(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\n")).alias("section", "text"))


register("a15_boilerplate_lines", r"WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS section FROM documents), c AS (SELECT DISTINCT doc_id, section, regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '[email]@\1', 'g') AS line FROM s) SELECT doc_id, line, count(*) AS n FROM c WHERE length(line) BETWEEN 1 AND 150 GROUP BY ALL HAVING count(*) >= 2")(lambda spark, sf: content.boilerplate_lines(_sections(spark, sf)))
register("x18_pick_title", r"WITH c AS (SELECT doc_id, lang, regexp_replace(trim(regexp_replace(text[1:80], '\s+', ' ', 'g')), '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '[email]@\1', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND lang <> '' THEN 'Bilan ' || lang WHEN t <> '' AND length(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 0.6 * length(regexp_replace(t, '\s', '', 'g')) AND NOT starts_with(lower(t), 'microsoft word -') AND lower(t) NOT IN ('d' || doc_id) THEN t ELSE '' END AS title FROM c")(lambda spark, sf: T.source(spark, sf, "documents").select("doc_id", X.pick_title(_title_candidates(), F.concat(F.lit("x/d"), "doc_id")).alias("title")))


def _title_candidates():
    """A document's first characters, then what a style names a heading, for every third one."""
    said = F.struct(F.substring("text", 1, 80).alias("text"), F.lit("position").alias("style"))
    styled = F.struct(F.concat(F.lit("Bilan "), "lang").alias("text"), F.lit("Heading 1").alias("style"))
    return F.when(F.col("doc_id") % 3 == 0, F.array(said, styled)).otherwise(F.array(said))


register("k1_describe_documents")(lambda spark, sf: content.describe(_described(spark, sf)))
register("a29_enrich_report")(lambda spark, sf: runs.enrich_report(content.statuses(_described(spark, sf))))


def _described(spark, sf) -> DataFrame:
    return T.source(spark, sf, "documents").select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), "text", F.when(F.col("doc_id") % 10 == 0, "connu").otherwise("").alias("description"))


register("k2_sample_positions", "WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 3 THEN array_to_string(range(0, n), ',') ELSE '0,' || n // 2 || ',' || n - 1 END AS positions FROM n")(lambda spark, sf: T.source(spark, sf, "documents").select("doc_id", F.array_join(F.transform(content.sample_positions(F.size(F.split("text", "\n"))), lambda p: p.cast("string")), ",").alias("positions")))

# evaluation


def _reports(spark, sf) -> DataFrame:
    """A report for each plan, which states the volumes of the inventory for some."""
    v = audit.volumetry(T.inventory(spark, sf))
    said = F.concat(F.lit("## 1.1 Volumes\nItems : "), F.when(F.length("plan_id") % 2 == 0, F.col("items")).otherwise(1), F.lit(" | RecordGrp : "), "folders", F.lit(" | Profondeur : "), "max_depth", F.lit("\n## 1.2 Formats\n**Ordre existant : partiellement structuré**\n## PARTIE 2 — PLANS DE CLASSEMENT\n"), "text", F.lit("\n## PARTIE 3 — NOTES\nfin"))
    return _plan_texts(spark, sf).withColumn("text", F.regexp_replace("text", "\n## ", "\n")).crossJoin(F.broadcast(v)).select(F.col("plan_id").alias("report_id"), said.alias("text"))


register("e1_audit_metrics")(lambda spark, sf: evaluate.audit_metrics(_reports(spark, sf), T.inventory(spark, sf)))


@register(
    "e3_directives_followed",
    f"""{_KEPT}, k3 AS (SELECT DISTINCT path, target AS folder, apos % 4 = 0 AS under FROM assignments WHERE target <> ''), l3 AS (SELECT DISTINCT y.path, y.folder AS landed, unnest(list_distinct([y.folder, coalesce(plan.parent, '.'), '.'])) AS above FROM y LEFT JOIN plan ON plan.folder = y.folder),
    m3 AS (SELECT k3.*, CASE WHEN under THEN (path, folder) IN (SELECT (path, above) FROM l3) ELSE (path, folder) IN (SELECT (path, landed) FROM l3) END AS followed FROM k3) SELECT count(*) AS total, count(*) FILTER (followed) AS followed, round(100.0 * count(*) FILTER (followed) / count(*), 1) AS pct FROM m3""",
)
def _followed(spark, sf):
    cases = T.assignments(spark, sf).where("target <> ''").select("path", F.col("target").alias("folder"), (F.col("apos") % 4 == 0).alias("under"))
    return evaluate.directives_followed(_done(spark, sf).rows, cases.distinct())


def _agent(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A log of calls and results, and what was expected, from the events of a user. Right filters come in several forms."""
    inv = T.inventory(spark, sf)
    counts = hierarchy.items(inv).agg(F.count("*").cast("string").alias("all"), F.count_if(X.extension(F.col("path")) == "pdf").cast("string").alias("pdf"))
    args = F.when(F.col("event_id") % 3 == 0, '{"extension":"doc"}').when(F.col("event_id") % 3 == 1, '{"extension": ".PDF", "keywords": []}').otherwise('{"folder": "/", "keywords": ["."], "extension": "pdf"}')
    e = T.source(spark, sf, "events").crossJoin(F.broadcast(counts)).withColumn("args", args)  # one row
    total = F.when(F.col("event_id") % 5 > 0, F.col("pdf")).otherwise(F.col("all"))
    steps = F.array(F.struct(F.lit(0).alias("k"), F.lit("tool").alias("type"), F.lit("count").alias("name"), F.col("args").alias("arguments"), F.lit(None).cast("string").alias("result")), F.struct(F.lit(1).alias("k"), F.lit("toolResult").alias("type"), F.lit("count").alias("name"), F.lit(None).cast("string").alias("arguments"), F.concat(F.lit('{"total":'), total, F.lit("}")).alias("result")), F.struct(F.lit(2).alias("k"), F.lit("final").alias("type"), F.lit("").alias("name"), F.lit(None).cast("string").alias("arguments"), F.concat(F.lit("Il y en a "), F.when(F.col("event_id") % 4 == 0, "7777777").otherwise(total), F.lit(".")).alias("result")))
    log = e.select(F.col("event_type").alias("run_id"), F.col("event_id").cast("string").alias("case_id"), F.explode(steps).alias("s")).select("run_id", "case_id", F.col("s.k").alias("seq"), "s.type", "s.name", "s.arguments", "s.result")
    cases = e.select(F.col("event_id").cast("string").alias("case_id"), F.array(F.lit("count")).alias("tools"), F.when(F.col("event_id") % 5 > 0, '{"extension":"pdf"}').alias("filter"), F.lit(True).alias("check_total"))
    return log, cases, inv


_AGENT_SQL = "WITH c AS (SELECT event_type AS run_id, event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 3 <> 0 END AS filter_ok, event_id % 4 <> 0 AS total_ok FROM events)"
register("e4_agent_cases", f"{_AGENT_SQL} SELECT run_id, CAST(event_id AS VARCHAR) AS case_id, true AS tool_ok, filter_ok, total_ok, coalesce(filter_ok, true) AND total_ok AS passed FROM c")(lambda spark, sf: evaluate.agent_cases(*_agent(spark, sf)).drop("steps", "error"))
register("e5_a23_agent_runs", f"{_AGENT_SQL} SELECT run_id, count(*) AS cases, count(*) FILTER (coalesce(filter_ok, true) AND total_ok) AS passed, count(*) FILTER (filter_ok) AS filter_ok, count(filter_ok) AS filter_measured, count(*) FILTER (total_ok) AS total_ok FROM c GROUP BY run_id")(lambda spark, sf: evaluate.agent_runs(evaluate.agent_cases(*_agent(spark, sf))).select("run_id", "cases", "passed", "filter_ok", "filter_measured", "total_ok"))


@register("e6_run_matrix", "WITH d AS (SELECT DISTINCT c_mktsegment AS dataset FROM customer), m AS (SELECT DISTINCT o_orderpriority AS model FROM orders), o AS (SELECT DISTINCT o_orderstatus AS mode FROM orders), r AS (SELECT c_mktsegment AS dataset, o_orderpriority AS model, o_orderstatus AS mode, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT d.dataset, m.model, o.mode, p.preparation, n FROM d CROSS JOIN m CROSS JOIN o CROSS JOIN (VALUES ('none'), ('blank_dates')) AS p(preparation) LEFT JOIN r ON r.dataset = d.dataset AND r.model = m.model AND r.mode = o.mode AND p.preparation = 'none'")
def _matrix(spark, sf):
    c, o = T.source(spark, sf, "customer"), T.source(spark, sf, "orders")
    results = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("mode"), F.lit("none").alias("preparation")).agg(F.count("*").alias("n"))
    preparations = spark.createDataFrame([("none",), ("blank_dates",)], "preparation string")
    return runs.run_matrix(c.select(F.col("c_mktsegment").alias("dataset")).distinct(), o.select(F.col("o_orderpriority").alias("model")).distinct(), o.select(F.col("o_orderstatus").alias("mode")).distinct(), results, preparations)


# streaming; the same operators take a stream, as the tests show

register("st1_progress", r"WITH l AS (SELECT CAST(apos // 800 AS VARCHAR) AS batch_id, path || ';' || target || ';' || new_title AS v FROM assignments) SELECT batch_id, count(*) AS n FROM l GROUP BY batch_id")(lambda spark, sf: streams.progress(_answers(spark, sf).select("batch_id", F.explode(F.split("raw_text", "\n")).alias("value"))))
register("st2_usage_quota", f"{_USAGE_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(input_tokens + 10) AS BIGINT) AS tokens, sum(input_tokens + 10) > 200000 AS over_cap FROM u GROUP BY 1")(lambda spark, sf: streams.usage_quota(_usage(spark, sf).select("ts", F.col("total_tokens").alias("tokens"))))
register("st2_usage_tries", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS client, event_type AS stage, count(*) AS tries, count(*) > 2 AS over FROM events GROUP BY 1, 2, 3")(lambda spark, sf: streams.usage_tries(T.source(spark, sf, "events").select("ts", F.col("user_id").alias("client"), F.col("event_type").alias("stage"))))
register("st3_sessions", "WITH e AS (SELECT user_id, ts, CAST(floor(value) AS BIGINT) AS t, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1800 SECONDS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id AS session_key, min(ts) AS started, count(*) AS turns, CAST(sum(t) AS BIGINT) AS tokens FROM s GROUP BY user_id, k")(
    lambda spark, sf: streams.sessions(T.source(spark, sf, "events").select(F.col("user_id").alias("session_key"), "ts", F.floor("value").cast("long").alias("tokens")))
)


@register("st4_incremental_ingest", "SELECT path, target, new_title, CAST(apos // 800 AS VARCHAR) AS batch_id FROM assignments")
def _ingested(spark, sf):
    base = new_path(spark, "ingest")
    _answers(spark, sf).withColumn("ts", F.current_timestamp()).write.json(f"{base}/in")
    for _ in range(2):  # the second run finds nothing new
        streams.ingest(spark, f"{base}/in", f"{base}/checkpoint", f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("path", "target", "new_title", "batch_id")
