"""More queries: many holdings in one job, deep plans, created folders, streams in micro-batches; and SQL for queries registered
without it. QUERIES and ORACLE hold those of ``queries`` as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import checks, classify, evaluate, explore, hierarchy, joins, sets, windows
from ..plans import plans as P
from ..session import materialise, new_path
from ..sources import inventory as inv_io
from ..sources import texts as text_io
from ..streaming import streams
from . import tables as T
from .queries import _BY, _CHAIN, _FOLDERS, _ITEMS, _KEPT, _PLANS_SQL, ORACLE, QUERIES, _conserved, _done, _holdings, _plan_texts, _reports, over_inventory, register

__all__ = ["ORACLE", "QUERIES"]

# trees

over_inventory(
    "h2_intervals",
    lambda inv: hierarchy.intervals(hierarchy.folders(inv).unionByName(inv.where("path = '.'"))),
    """WITH RECURSIVE f AS (SELECT id, parent_id FROM inventory WHERE level = 'RecordGrp'), t(id, chain) AS (SELECT id, [id] FROM f WHERE parent_id = '' UNION ALL SELECT f.id, list_append(t.chain, f.id) FROM f JOIN t ON f.parent_id = t.id),
    n AS (SELECT id, chain, row_number() OVER (ORDER BY chain) - 1 AS pre FROM t), s AS (SELECT unnest(chain) AS id FROM t), c AS (SELECT id, count(*) AS size FROM s GROUP BY id)
    SELECT n.id, pre, pre + size AS post, CAST(len(chain) - 1 AS BIGINT) AS depth FROM n JOIN c USING (id)""",
)

# plans of three levels: of each region its nations, their customers, and the priorities of their orders

DEEP_NODES = """
SELECT r_name AS plan_id, 'n' || CAST(n_nationkey AS STRING) AS id, '' AS parent_id, n_name AS title, 'N_' || CAST(n_nationkey AS STRING) AS slug, CAST(n_nationkey AS BIGINT) AS pos FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 'c' || CAST(c_custkey AS STRING), 'n' || CAST(n_nationkey AS STRING), 'Client ' || CAST(c_custkey AS STRING), 'C_' || CAST(c_custkey AS STRING), CAST(c_custkey AS BIGINT) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT r_name, 'p' || CAST(c_custkey AS STRING) || SUBSTR(o_orderpriority, 1, 1), 'c' || CAST(c_custkey AS STRING), SUBSTR(o_orderpriority, 3) || ' -> actes', 'P_' || REPLACE(SUBSTR(o_orderpriority, 3), ' ', '_'), CAST(SUBSTR(o_orderpriority, 1, 1) AS BIGINT) FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""
_PLAIN = DEEP_NODES.format(**{n: n for n in ("region", "nation", "customer", "orders")})
_LEVELS = f"""WITH n AS ({_PLAIN}), a AS (SELECT *, row_number() OVER (PARTITION BY plan_id, parent_id ORDER BY pos, id) AS k, row_number() OVER (PARTITION BY plan_id, parent_id ORDER BY pos DESC, id DESC) = 1 AS last FROM n),
l1 AS (SELECT *, [k] AS ks, '  ' AS indent FROM a WHERE parent_id = ''), l2 AS (SELECT a.*, list_append(l1.ks, a.k) AS ks, l1.indent || CASE WHEN l1.last THEN '      ' ELSE '│     ' END AS indent FROM a JOIN l1 ON l1.plan_id = a.plan_id AND l1.id = a.parent_id),
l3 AS (SELECT a.*, list_append(l2.ks, a.k) AS ks, l2.indent || CASE WHEN l2.last THEN '      ' ELSE '│     ' END AS indent FROM a JOIN l2 ON l2.plan_id = a.plan_id AND l2.id = a.parent_id), u AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


def _deep(spark, sf) -> DataFrame:
    return spark.sql(DEEP_NODES, **{n: T.source(spark, sf, n) for n in ("region", "nation", "customer", "orders")})


def _titles(spark, sf) -> DataFrame:
    """Root titles of some plans."""
    return T.source(spark, sf, "region").where("r_regionkey % 2 = 0").select(F.col("r_name").alias("plan_id"), F.concat(F.lit("Archives "), "r_name").alias("title"))


register(
    "r3_render_deep_plans",
    f"""{_LEVELS}, lines AS (SELECT plan_id, ks, CASE WHEN len(ks) = 1 THEN '  │' || chr(10) ELSE '' END || indent || CASE WHEN last THEN '└──' ELSE '├──' END || ' ' || array_to_string(ks, '.') || '. ' || replace(title, ' -> ', ' - ') || ' → ' || array_to_string(ks, '-') || '_' || slug || '/' AS line FROM u),
    t AS (SELECT plan_id, string_agg(line, chr(10) ORDER BY ks) AS body FROM lines GROUP BY plan_id) SELECT plan_id, 'Fonds — ' || CASE WHEN r_regionkey % 2 = 0 THEN 'Archives ' || r_name ELSE '[Nom du fonds]' END || ' → Dossier_racine/' || chr(10) || body AS text FROM t JOIN region ON r_name = plan_id""",
)(lambda spark, sf: P.render_plans(_deep(spark, sf), _titles(spark, sf)))
ORACLE["r3_render_plan"] = f"""{_PLANS_SQL}, n AS (SELECT plan_id, folder, parent, title, string_split(string_split(folder, '_')[1], '-') AS ks, lead(k) OVER (PARTITION BY plan_id ORDER BY CAST(k AS INT)) IS NULL AS last FROM (SELECT pp.*, string_split(string_split(folder, '_')[1], '-')[1] AS k FROM pp WHERE parent IS NULL)
UNION ALL SELECT plan_id, folder, parent, title, string_split(string_split(folder, '_')[1], '-'), NULL FROM pp WHERE parent IS NOT NULL),
t AS (SELECT n.plan_id, CASE WHEN n.parent IS NULL THEN '  │' || chr(10) || '  ' || CASE WHEN n.last THEN '└──' ELSE '├──' END ELSE '  ' || CASE WHEN p.last THEN '      ' ELSE '│     ' END || '└──' END || ' ' || array_to_string(n.ks, '.') || '. ' || n.title || ' → ' || n.folder || '/' AS line, [CAST(x AS INT) FOR x IN n.ks] AS place FROM n LEFT JOIN n p ON p.plan_id = n.plan_id AND p.folder = n.parent)
SELECT plan_id, 'Fonds — [Nom du fonds] → Dossier_racine/' || chr(10) || string_agg(line, chr(10) ORDER BY place) AS text FROM t GROUP BY plan_id"""
register("r3_deep_round_trip", f"{_LEVELS} SELECT u.plan_id, array_to_string(u.ks, '-') || '_' || u.slug AS folder, array_to_string(p.ks, '-') || '_' || p.slug AS parent, replace(u.title, ' -> ', ' - ') AS title FROM u LEFT JOIN u p ON p.plan_id = u.plan_id AND p.id = u.parent_id")(
    lambda spark, sf: P.parse_plans(P.plan_blocks(P.render_plans(_deep(spark, sf)))).select("plan_id", "folder", "parent", "title")
)
register("w11_deep_numbering", f"{_LEVELS} SELECT plan_id, id, array_to_string(ks, '-') AS number FROM u")(lambda spark, sf: P.plan_numbering(_deep(spark, sf)).select("plan_id", "id", "number"))
register("r6_deep_shapes", f"{_LEVELS}, w AS (SELECT plan_id, parent_id, count(*) AS n FROM u GROUP BY ALL) SELECT plan_id, count(*) AS folders, CAST(max(len(ks)) AS BIGINT) AS depth, (SELECT max(n) FROM w WHERE w.plan_id = u.plan_id) AS max_children, count(*) FILTER (NOT EXISTS (SELECT 1 FROM n WHERE n.parent_id = u.id)) AS leaves FROM u GROUP BY plan_id")(
    lambda spark, sf: hierarchy.plan_shape(_deep(spark, sf).select("plan_id", F.col("id").alias("folder"), F.nullif("parent_id", F.lit("")).alias("parent")))
)
over_inventory("r4_import_report", P.plan_import_report, f"SELECT count(*) FILTER ({_FOLDERS}) AS folder_count, count(*) FILTER ({_ITEMS}) AS ignored_items, 'Fonds' AS root_title FROM inventory")
register("w12_plan_main_root", f"{_PLANS_SQL} SELECT plan_id, 'Commune_de_' || plan_id AS folder, CAST(NULL AS VARCHAR) AS parent FROM (SELECT DISTINCT plan_id FROM pp) UNION ALL SELECT plan_id, folder, coalesce(parent, 'Commune_de_' || plan_id) FROM pp")(
    lambda spark, sf: P.parse_plans(_plan_texts(spark, sf).select("plan_id", F.replace("text", F.lit("Dossier_racine/\n"), F.concat(F.lit("Commune → Commune_de_"), "plan_id", F.lit("/\n"))).alias("text"))).select("plan_id", "folder", "parent")
)

# targets that create folders

_CREATED = r"""WITH t AS (SELECT path, target, new_title, apos, [trim(s) FOR s IN string_split_regex(target, '[\\/]') IF trim(s) <> ''] AS p FROM assignments), pf AS (SELECT DISTINCT folder FROM plan),
q AS (SELECT *, coalesce(p[-1], '') AS leaf, coalesce(p[-2], '') AS above, trim(regexp_replace(coalesce(p[-1], ''), '[^\p{L}\p{N}_]+', '_', 'g'), '_') AS slug FROM t),
q2 AS (SELECT *, leaf NOT IN (SELECT folder FROM pf) AND above IN (SELECT folder FROM pf) AND slug <> '' AND NOT regexp_matches(leaf, '\.[A-Za-z0-9]{1,6}$') AS asks FROM q),
kids AS (SELECT regexp_replace(string_split(folder, '_')[1], '-[0-9]+$', '') AS prefix, max(CAST(regexp_extract(string_split(folder, '_')[1], '-([0-9]+)$', 1) AS BIGINT)) AS top FROM pf WHERE contains(string_split(folder, '_')[1], '-') GROUP BY 1),
made AS (SELECT above AS parent, slug, string_split(above, '_')[1] || '-' || CAST(row_number() OVER (PARTITION BY above ORDER BY slug) + coalesce(top, 0) AS VARCHAR) || '_' || slug AS folder FROM (SELECT DISTINCT above, slug FROM q2 WHERE asks) LEFT JOIN kids ON prefix = string_split(above, '_')[1]),
r AS (SELECT path, target, new_title, apos, CASE WHEN asks THEN made.folder ELSE leaf END AS folder FROM q2 LEFT JOIN made ON asks AND made.parent = above AND made.slug = q2.slug),
known AS (SELECT DISTINCT path FROM inventory WHERE level = 'Item'), whole AS (SELECT folder, parent, title FROM plan UNION ALL SELECT folder, parent, trim(replace(slug, '_', ' ')) FROM made),
s AS (SELECT r.*, CASE WHEN folder = '' THEN 'unknown_target' WHEN r.path NOT IN (SELECT path FROM known) THEN 'unknown_path' WHEN folder NOT IN (SELECT folder FROM whole) AND regexp_matches(folder, '\.[A-Za-z0-9]{1,6}$') THEN 'malformed' WHEN folder NOT IN (SELECT folder FROM whole) THEN 'off_plan' ELSE 'ok' END AS status,
CASE WHEN new_title = '' OR regexp_extract(regexp_extract(r.path, '[^\\/]*$'), '\.[^.]*$') = '' THEN new_title ELSE regexp_replace(new_title, '\.[^.]*$', '') || regexp_extract(regexp_extract(r.path, '[^\\/]*$'), '\.[^.]*$') END AS fixed_title FROM r),
u AS (SELECT DISTINCT folder FROM s WHERE status IN ('ok', 'off_plan')), up AS (SELECT whole.folder, whole.parent, top.parent AS grand FROM whole LEFT JOIN plan top ON top.folder = whole.parent),
n AS (SELECT folder FROM u UNION SELECT parent FROM up WHERE parent IS NOT NULL AND folder IN (SELECT folder FROM u) UNION SELECT grand FROM up WHERE grand IS NOT NULL AND folder IN (SELECT folder FROM u))"""
ORACLE["c1_resolve_targets_with_creation"] = T.oracle(f"{_CREATED} SELECT folder, parent FROM made")
ORACLE["a18_anomaly_counts"] = T.oracle(
    f"""{_CREATED}, k AS (SELECT 'nonClasse' AS category, 'danger' AS severity, 0 AS rank, count(*) AS n FROM inventory WHERE {_ITEMS} AND path NOT IN (SELECT path FROM s) UNION ALL SELECT 'cibleInconnue', 'danger', 1, count(*) FROM s WHERE status = 'unknown_target' UNION ALL SELECT 'pathIntrouvable', 'danger', 2, count(*) FROM s WHERE status = 'unknown_path'
    UNION ALL SELECT 'cibleMalformee', 'warning', 3, count(*) FROM s WHERE status = 'malformed' UNION ALL SELECT 'horsPlan', 'warning', 4, count(*) FROM n WHERE folder NOT IN (SELECT folder FROM whole) UNION ALL SELECT 'nonRealise', 'warning', 5, count(*) FROM pf WHERE folder NOT IN (SELECT folder FROM n)
    UNION ALL SELECT 'sousDossierCree', 'info', 6, count(*) FROM made UNION ALL SELECT 'extension', 'info', 7, count(*) FROM s WHERE fixed_title <> new_title AND status IN ('ok', 'off_plan', 'malformed')) SELECT category, severity, CAST(rank AS INT) AS rank, n FROM k WHERE n > 0"""
)

# of a path that is assigned twice the last assignment dates the folders; numbers of folder names are left out at the end
ORACLE["c7_finalize_with_creation"] = T.oracle(
    rf"""{_CREATED}, f AS (SELECT path, arg_min(id, pos) AS id, arg_min(start_date, pos) AS a, arg_min(end_date, pos) AS b FROM inventory WHERE {_ITEMS} GROUP BY path), y AS (SELECT f.id, path, CASE WHEN status = 'malformed' THEN '.' ELSE folder END AS folder, apos, fixed_title, a, b FROM s JOIN f USING (path) WHERE status IN ('ok', 'off_plan', 'malformed')),
    l AS (SELECT path, arg_max(folder, apos) AS folder, any_value(a) AS a, any_value(b) AS b FROM y GROUP BY path), d AS (SELECT unnest(list_distinct(['.', l.folder, coalesce(up.parent, '.'), coalesce(up.grand, '.')])) AS path, a, b FROM l LEFT JOIN up ON up.folder = l.folder), x AS (SELECT path, min(nullif(a, '')) AS a, max(nullif(b, '')) AS b FROM d GROUP BY path),
    ids AS (SELECT folder, CAST((SELECT max(CAST(id AS BIGINT)) FROM inventory) + row_number() OVER (ORDER BY folder) AS VARCHAR) AS id FROM n), dirs AS (SELECT ids.id, coalesce(p.id, '1') AS parent_id, ids.folder, regexp_replace(ids.folder, '^[0-9]+(-[0-9]+)*_', '') AS bare, coalesce(nullif(whole.title, ''), trim(replace(regexp_replace(ids.folder, '^[0-9]+(-[0-9]+)*_', ''), '_', ' '))) AS title FROM ids LEFT JOIN whole USING (folder) LEFT JOIN ids p ON p.folder = whole.parent)
    SELECT '1' AS id, '' AS parent_id, '.' AS path, 'RecordGrp' AS level, 'Fonds' AS title, coalesce(a, '') AS start_date, coalesce(b, '') AS end_date FROM (SELECT '.' AS path) LEFT JOIN x USING (path) UNION ALL SELECT dirs.id, parent_id, bare, 'RecordGrp', title, coalesce(a, ''), coalesce(b, '') FROM dirs LEFT JOIN x ON x.path = dirs.folder
    UNION ALL SELECT y.id, coalesce(ids.id, '1'), path, 'Item', fixed_title, a, b FROM y LEFT JOIN ids USING (folder)"""
)

# copies

_PREVIEW = rf"""{_KEPT}, ft AS (SELECT path, apos, fixed_title, CASE WHEN status = 'malformed' THEN '.' ELSE folder END AS folder FROM s WHERE status IN ('ok', 'off_plan', 'malformed')), w0 AS (SELECT path, fixed_title, CASE WHEN ft.folder = '.' THEN '' ELSE coalesce(parent || '/', '') || ft.folder END AS folder, m.place AS pos FROM ft JOIN (SELECT path, min(pos) AS place FROM inventory WHERE {_ITEMS} GROUP BY path) AS m USING (path) LEFT JOIN plan ON plan.folder = ft.folder),
w1 AS (SELECT *, CASE WHEN fixed_title = '' THEN regexp_extract(path, '[^\\/]*$') ELSE fixed_title END AS wanted FROM w0), w2 AS (SELECT *, coalesce(nullif(regexp_replace(trim(regexp_replace(wanted, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '\.+$', ''), ''), 'sans_nom') AS clean FROM w1),
w3 AS (SELECT *, row_number() OVER (PARTITION BY folder, lower(clean) ORDER BY pos) AS k FROM w2), w4 AS (SELECT *, CASE WHEN k = 1 THEN clean WHEN contains(clean, '.') THEN regexp_replace(clean, '\.[^.]*$', '') || ' (' || k || ')' || regexp_extract(clean, '\.[^.]*$') ELSE clean || ' (' || k || ')' END AS name FROM w3),
pv AS (SELECT path AS source, folder, name, wanted <> clean AS sanitised, clean <> name AS renamed, folder = '' AS at_root, CASE WHEN folder = '' THEN name ELSE folder || '/' || name END AS target_path FROM w4)"""
ORACLE["c9_copy_preview"] = T.oracle(f"{_PREVIEW} SELECT * FROM pv")


@register("j16_verify_copy", f"{_PREVIEW} SELECT source, target_path, length(target_path) % 10 > 0 AS present FROM pv")
def _verified(spark, sf):
    """The preview against a listing that lacks some files."""
    preview = materialise(classify.copy_preview(_done(spark, sf).rows).select("source", "target_path"), "preview")
    return joins.verify_copy(preview, preview.where(F.length("target_path") % 10 > 0).select(F.col("target_path").alias("path")))


# two holdings through the whole classification

_BY_SPLIT = r"""WITH h AS (SELECT *, CASE WHEN path < '3' THEN 'a' ELSE 'b' END AS fonds_id FROM inventory), hp AS (SELECT f AS fonds_id, plan.* FROM plan, (VALUES ('a'), ('b')) v(f) WHERE f = 'a' OR NOT contains(folder, 'LOW')),
t AS (SELECT path, target, new_title, apos, CASE WHEN path < '3' THEN 'a' ELSE 'b' END AS fonds_id, [trim(s) FOR s IN string_split_regex(target, '[\\/]') IF trim(s) <> ''] AS p FROM assignments), r AS (SELECT *, coalesce(p[-1], '') AS folder FROM t), pf AS (SELECT fonds_id, folder FROM hp),
s AS (SELECT r.*, CASE WHEN folder = '' THEN 'unknown_target' WHEN NOT EXISTS (SELECT 1 FROM h WHERE h.fonds_id = r.fonds_id AND h.path = r.path AND level = 'Item') THEN 'unknown_path' WHEN (fonds_id, folder) NOT IN (SELECT (fonds_id, folder) FROM pf) AND regexp_matches(folder, '\.[A-Za-z0-9]{1,6}$') THEN 'malformed' WHEN (fonds_id, folder) NOT IN (SELECT (fonds_id, folder) FROM pf) THEN 'off_plan' ELSE 'ok' END AS status,
CASE WHEN new_title = '' OR regexp_extract(regexp_extract(r.path, '[^\\/]*$'), '\.[^.]*$') = '' THEN new_title ELSE regexp_replace(new_title, '\.[^.]*$', '') || regexp_extract(regexp_extract(r.path, '[^\\/]*$'), '\.[^.]*$') END AS fixed_title FROM r),
u AS (SELECT DISTINCT fonds_id, folder FROM s WHERE status IN ('ok', 'off_plan')), n AS (SELECT fonds_id, folder FROM u UNION SELECT hp.fonds_id, parent FROM hp JOIN u ON u.fonds_id = hp.fonds_id AND u.folder = hp.folder WHERE parent IS NOT NULL),
f AS (SELECT fonds_id, path, arg_min(start_date, pos) AS a, arg_min(end_date, pos) AS b FROM h WHERE level = 'Item' GROUP BY ALL), y AS (SELECT s.fonds_id, s.path, CASE WHEN status = 'malformed' THEN '.' ELSE folder END AS folder, apos, fixed_title, a, b FROM s JOIN f ON f.fonds_id = s.fonds_id AND f.path = s.path WHERE status IN ('ok', 'off_plan', 'malformed')),
l AS (SELECT fonds_id, path, arg_max(folder, apos) AS folder, any_value(a) AS a, any_value(b) AS b FROM y GROUP BY ALL), d AS (SELECT l.fonds_id, unnest(list_distinct(['.', l.folder, coalesce(hp.parent, '.')])) AS path, a, b FROM l LEFT JOIN hp ON hp.fonds_id = l.fonds_id AND hp.folder = l.folder),
x AS (SELECT fonds_id, path, min(nullif(a, '')) AS a, max(nullif(b, '')) AS b FROM d GROUP BY ALL)"""


def _two_holdings(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assignments, inventory and plans of two holdings, by the region of a path; the second one's plan lacks some folders."""
    fonds = spark.sql("SELECT explode(array('a', 'b')) AS fonds_id")
    plan = T.plan(spark, sf).crossJoin(F.broadcast(fonds)).where("fonds_id = 'a' OR NOT contains(folder, 'LOW')")  # two rows
    return _holdings(T.assignments(spark, sf)), _holdings(T.inventory(spark, sf)), plan


@register(
    "by_c7_finalize",
    f"""{_BY_SPLIT} SELECT n.fonds_id, n.folder AS path, 'RecordGrp' AS level, coalesce(hp.parent, '.') AS parent, coalesce(nullif(title, ''), trim(replace(regexp_replace(n.folder, '^[0-9]+(-[0-9]+)*_', ''), '_', ' '))) AS title, coalesce(a, '') AS start_date, coalesce(b, '') AS end_date FROM n LEFT JOIN hp ON hp.fonds_id = n.fonds_id AND hp.folder = n.folder LEFT JOIN x ON x.fonds_id = n.fonds_id AND x.path = n.folder
    UNION ALL SELECT h.fonds_id, '.', 'RecordGrp', '', title, coalesce(a, ''), coalesce(b, '') FROM h LEFT JOIN x ON x.fonds_id = h.fonds_id AND x.path = '.' WHERE h.path = '.' UNION ALL SELECT fonds_id, path, 'Item', folder, fixed_title, a, b FROM y""",
)
def _classified_holdings(spark, sf):
    asg, inv, plan = _two_holdings(spark, sf)
    rows = classify.finalize(asg, _with_roots(inv), plan, by=_BY).rows
    dirs = rows.where("level = 'RecordGrp'").select(*_BY, F.col("id").alias("parent_id"), F.col("path").alias("parent"))
    return rows.join(dirs, [*_BY, "parent_id"], "left").select(*_BY, "path", "level", F.coalesce("parent", F.lit("")).alias("parent"), "title", "start_date", "end_date")


def _with_roots(inv: DataFrame) -> DataFrame:
    """The root of the derived inventory belongs to each holding."""
    return inv.where("path <> '.' OR fonds_id = 'a'").unionByName(inv.where("path = '.'").withColumn("fonds_id", F.lit("b")))


ORACLE["by_c7_finalize"] = ORACLE["by_c7_finalize"].replace("h AS (SELECT *, CASE WHEN path < '3' THEN 'a' ELSE 'b' END AS fonds_id FROM inventory)", "h AS (SELECT *, CASE WHEN path < '3' THEN 'a' ELSE 'b' END AS fonds_id FROM inventory UNION ALL SELECT *, 'b' FROM inventory WHERE path = '.')")


@register(
    "by_a17_counters",
    f"""{_BY_SPLIT}, i AS (SELECT fonds_id, count(*) AS total, count(*) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.fonds_id = h.fonds_id AND s.path = h.path)) AS unclassified FROM h WHERE level = 'Item' GROUP BY fonds_id) SELECT fonds_id, any_value(total) AS total, any_value(unclassified) AS unclassified, count(*) FILTER (status IN ('ok', 'off_plan', 'malformed')) AS classified, count(*) FILTER (status = 'malformed') AS malformed,
    count(*) FILTER (status IN ('ok', 'off_plan', 'malformed') AND fixed_title <> new_title) AS extensions_fixed, count(*) FILTER (status = 'unknown_target') AS targets_unknown, count(*) FILTER (status = 'unknown_path') AS paths_not_found, CAST(0 AS BIGINT) AS refs_unresolved FROM s JOIN i USING (fonds_id) GROUP BY fonds_id""",
)
def _holding_counters(spark, sf):
    asg, inv, plan = _two_holdings(spark, sf)
    return classify.counters(classify.finalize(asg, inv, plan, by=_BY).status, inv, _BY).drop("classified_pct")


@register("by_a16_conformity", f"{_BY_SPLIT} SELECT v.f AS fonds_id, (SELECT count(*) FROM hp WHERE fonds_id = v.f) AS plan_folders, (SELECT count(*) FROM n WHERE fonds_id = v.f) AS output_folders, (SELECT count(*) FROM n WHERE fonds_id = v.f AND (fonds_id, folder) NOT IN (SELECT (fonds_id, folder) FROM pf)) AS off_plan, (SELECT count(*) FROM hp WHERE fonds_id = v.f AND (fonds_id, folder) NOT IN (SELECT (fonds_id, folder) FROM n)) AS missing, false AS plan_matches FROM (VALUES ('a'), ('b')) v(f)")
def _holding_conformity(spark, sf):
    asg, inv, plan = _two_holdings(spark, sf)
    done = classify.finalize(asg, inv, plan, by=_BY)
    return classify.conformity(plan, done.rows.where("level = 'RecordGrp' AND path <> '.'").select(*_BY, F.col("path").alias("folder")), done.created, _BY)


@register("a17_refs_unresolved", f"SELECT count(*) AS total, count(*) - CAST(count(*) // 10 AS BIGINT) AS classified, CAST(count(*) // 10 AS BIGINT) AS refs_unresolved FROM inventory WHERE {_ITEMS}")
def _unresolved(spark, sf):
    """Assignments by ref, of which every tenth ref is none."""
    inv, plan = T.inventory(spark, sf), T.plan(spark, sf)
    refs = materialise(windows.assign_ref(inv).select("ref", "path", "title", "pos"), "refs")
    asked = refs.select(F.when(F.col("ref") % 10 == 0, "?").otherwise(F.col("ref").cast("string")).alias("ref"), F.lit("1_STATUT_F").alias("target"), F.col("title").alias("new_title"), F.col("pos").alias("apos"))
    status = classify.route(classify.fix_extensions(classify.resolve_targets(joins.rehydrate_paths(asked, refs), plan, plan.select("folder").limit(0))[0]), inv, plan)
    return classify.counters(status, inv).select("total", "classified", "refs_unresolved")


# reports

_LABEL = _conserved("folder")
ORACLE["e1_audit_metrics"] = T.oracle(
    f"""{_PLANS_SQL}, lines AS (SELECT plan_id, '├─ ' || k || '. ' || s || ' → ' || k || '_' || s || '/' || chr(10) || '│  └─ ' || k || '.1. Clients -> ' || k || '-1_Clients_' || s || '/' AS line FROM h), texts AS (SELECT plan_id, length('## Arborescence technique' || chr(10) || 'Dossier_racine/' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) || 'Préconisations' || chr(10) || '8_Rien/') AS chars FROM lines GROUP BY plan_id),
    vol AS (SELECT count(*) FILTER ({_ITEMS}) AS items, count(*) FILTER (level = 'RecordGrp') AS folders, max(length(path) - length(replace(path, '/', '')) + CASE WHEN path = '.' THEN 0 ELSE 1 END) AS depth FROM inventory),
    full_ AS (SELECT DISTINCT folder FROM ({_CHAIN})), src AS (SELECT DISTINCT {_conserved("coalesce(nullif(title, ''), regexp_extract(path, '[^/]*$'))")} AS label FROM inventory WHERE {_FOLDERS} AND path IN (SELECT folder FROM full_)), src2 AS (SELECT label FROM src WHERE label <> ''),
    shape AS (SELECT plan_id, count(*) AS folders, count(*) FILTER (parent IS NULL) AS roots FROM pp GROUP BY plan_id), lab AS (SELECT DISTINCT plan_id, {_LABEL} AS label FROM pp JOIN shape USING (plan_id) WHERE NOT (parent IS NULL AND roots = 1)),
    con AS (SELECT plan_id, count(*) FILTER (label IN (SELECT label FROM src2)) AS kept, count(*) FILTER (label NOT IN (SELECT label FROM src2)) AS made FROM lab WHERE label <> '' GROUP BY plan_id)
    SELECT plan_id AS report_id, CAST(chars + length('## 1.1 Volumes' || chr(10) || 'Items : ' || CASE WHEN length(plan_id) % 2 = 0 THEN items ELSE 1 END || ' | RecordGrp : ' || vol.folders || ' | Profondeur : ' || vol.depth || chr(10) || '## 1.2 Formats' || chr(10) || '**Ordre existant : partiellement structuré**' || chr(10) || '## PARTIE 2 — PLANS DE CLASSEMENT' || chr(10) || chr(10) || '## PARTIE 3 — NOTES' || chr(10) || 'fin') AS INT) AS chars,
    CAST(2 AS INT) AS n_sections, false AS sections_complete, 'PARTIELLEMENT STRUCTURÉ' AS verdict, true AS plan_extracted, false AS structure_block, true AS plan_found, shape.folders, CAST(2 AS BIGINT) AS depth, roots AS max_children, roots AS leaves, length(plan_id) % 2 = 0 OR items = 1 AS volumes_match,
    (SELECT count(*) FROM src2) AS source_folders, kept AS source_retained, round(100.0 * kept / (SELECT count(*) FROM src2), 1)::DOUBLE AS source_retained_pct, made AS folders_created FROM texts JOIN shape USING (plan_id) JOIN con USING (plan_id), vol"""
)


@register(
    "e3_misses",
    f"""{_KEPT}, k3 AS (SELECT DISTINCT path, target AS folder, apos % 4 = 0 AS under FROM assignments WHERE target <> ''), l3 AS (SELECT DISTINCT y.path, y.folder AS landed, unnest(list_distinct([y.folder, coalesce(plan.parent, '.'), '.'])) AS above FROM y LEFT JOIN plan ON plan.folder = y.folder),
    m3 AS (SELECT k3.*, CASE WHEN under THEN (path, folder) IN (SELECT (path, above) FROM l3) ELSE (path, folder) IN (SELECT (path, landed) FROM l3) END AS followed FROM k3), at3 AS (SELECT path, string_agg(DISTINCT landed, ' | ' ORDER BY landed) AS landed FROM l3 GROUP BY path) SELECT m3.path, coalesce(landed, '') AS landed_in, folder AS expected FROM m3 LEFT JOIN at3 USING (path) WHERE NOT followed""",
)
def _missed(spark, sf):
    cases = T.assignments(spark, sf).where("target <> ''").select("path", F.col("target").alias("folder"), (F.col("apos") % 4 == 0).alias("under"))
    return evaluate.directives_missed(_done(spark, sf).rows, cases.distinct())


# sources


@register("s9_read_eval_reports", "SELECT c_mktsegment AS label, o_orderpriority AS model, count(*) AS items, CAST(date '2024-01-01' AS VARCHAR) AS \"generatedAt\" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def _eval_reports(spark, sf):
    """Stored reports, a file for each market segment with a run for each priority."""
    path = new_path(spark, "eval-reports")
    o, c = T.source(spark, sf, "orders"), T.source(spark, sf, "customer")
    runs_ = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    report = runs_.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.to_json(F.struct(F.lit("2024-01-01").alias("generatedAt"), F.first("c_mktsegment").alias("label"), F.collect_list(F.struct(F.col("o_orderpriority").alias("model"), F.col("n").alias("items"))).alias("runs"))).alias("value"))
    report.write.partitionBy("segment").text(path)
    return text_io.read_eval_reports(spark, f"{path}/*").select("generatedAt", "label", "model", "items")


@register("s10_read_cases", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'cas-' || CAST(k AS VARCHAR) ELSE n_name END AS case_id, 'Combien ? ' || n_name AS question FROM c WHERE n_nationkey % 7 <> 0")
def _stored_cases(spark, sf):
    """A corpus for each region; some cases have no id, and some no expectation."""
    path = new_path(spark, "cases")
    n = T.source(spark, sf, "nation")
    said = F.struct(F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("id"), F.concat(F.lit("Combien ? "), "n_name").alias("question"), F.when(F.col("n_nationkey") % 7 != 0, F.struct(F.lit("total").alias("type"))).alias("attendu"))
    corpus = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", said.alias("c")))), lambda x: x["c"]).alias("cases"))).alias("value"))
    corpus.write.partitionBy("n_regionkey").text(path)
    return text_io.read_cases(spark, f"{path}/*").select("case_id", "question")


@register("s5_read_plans", "SELECT r_name || CASE WHEN r_regionkey % 2 = 0 THEN ' table' ELSE ' plan' END AS first, CASE WHEN r_regionkey % 2 = 0 THEN 'folders' ELSE 'markdown' END AS kind FROM region")
def _stored_plans(spark, sf):
    """A plan file for each region, as a table of folders or as an outline."""
    path = new_path(spark, "plan-files")
    r = T.source(spark, sf, "region")
    table = F.concat("r_name", F.lit(" table;ParentID;File\n1;;."))
    outline = F.concat("r_name", F.lit(" plan\nTitre → 1_"), "r_name", F.lit("/"))
    r.select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, table).otherwise(outline).alias("value")).write.partitionBy("r_regionkey").text(path)
    found = text_io.usable_plans(text_io.read_plans(spark, f"{path}/*"))
    return found.select(F.regexp_extract("text", "^([A-Z ]+ (?:table|plan))", 1).alias("first"), "kind")


@register("s3_listing_of_input_files", "SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM documents GROUP BY lang")
def _listed_files(spark, sf):
    """Files of texts in a folder for each language, listed with their sizes."""
    path = new_path(spark, "text-files")
    T.source(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    files = inv_io.listing(spark, path).where(~F.startswith(X.basename(F.col("path")), F.lit("_")))
    return files.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(F.sum("size").alias("size"))


over_inventory(
    "by_h10_list_folder",
    lambda inv: hierarchy.list_folder(_holdings(inv), "1_AFRICA", by=_BY).select("fonds_id", "kind", "name", "n_items"),
    f"WITH c AS (SELECT folder, count(*) AS n FROM ({_CHAIN}) GROUP BY folder) SELECT 'a' AS fonds_id, 'folder' AS kind, path AS name, coalesce(n, 0) AS n_items FROM inventory LEFT JOIN c ON folder = path WHERE {_FOLDERS} AND regexp_matches(path, '^1_AFRICA/[^/]*$') ORDER BY path LIMIT 20",
)
over_inventory(
    "by_w3_even_sample",
    lambda inv: explore.even_sample(_holdings(inv), {"extension": "doc"}, 7, _BY).select("fonds_id", "nth", "total", "path"),
    rf"WITH r AS (SELECT CASE WHEN path < '3' THEN 'a' ELSE 'b' END AS fonds_id, path, row_number() OVER (PARTITION BY path < '3' ORDER BY pos, path) - 1 AS nth, count(*) OVER (PARTITION BY path < '3') AS total FROM inventory WHERE {_ITEMS} AND lower(regexp_extract(path, '\.([^.]*)$', 1)) = 'doc') SELECT fonds_id, nth, total, path FROM r WHERE nth IN (SELECT CAST(floor(i * total / 7) AS BIGINT) FROM range(7) t(i))",
)
over_inventory(
    "u2_concat_batches",
    lambda inv: sets.concat_batches([hierarchy.items(inv).where(F.col("pos") % 3 == k).select("path", F.col("pos").alias("apos")) for k in (2, 0, 1)]).select("path", "pos"),
    f"SELECT path, row_number() OVER (ORDER BY (pos + 1) % 3, pos) AS pos FROM inventory WHERE {_ITEMS}",
)


@register("q1_check_required", "SELECT unnest(['parent_id', 'title']) AS missing, (SELECT count(*) FROM inventory) AS rows")
def _required(spark, sf):
    inv = T.inventory(spark, sf).drop("title", "parent_id")
    lost = F.array(*[F.lit(c) for c in checks.check_required(inv)])
    return inv.agg(F.count("*").alias("rows")).select(F.explode(lost).alias("missing"), "rows")


ORACLE["s3_inventory_of_listing"] = T.oracle(
    rf"""WITH f AS (SELECT path, min(start_date) AS date FROM inventory WHERE {_ITEMS} AND NOT list_any_value([true FOR s IN string_split(path, '/') IF starts_with(s, '.') OR starts_with(s, '~$') OR lower(s) IN ('thumbs.db', 'desktop.ini', '.ds_store')]) IS NOT NULL GROUP BY path),
    d AS (SELECT unnest(list_concat(['.'], [array_to_string(string_split(path, '/')[1:i], '/') FOR i IN range(1, len(string_split(path, '/')))])) AS path, date FROM f), g AS (SELECT path, 'RecordGrp' AS level, min(date) AS start_date, max(date) AS end_date, CASE WHEN path = '.' THEN 0 ELSE 1 END AS rank FROM d GROUP BY path UNION ALL SELECT path, 'Item', date, date, 2 FROM f),
    n AS (SELECT *, CAST(row_number() OVER (ORDER BY rank, path) AS VARCHAR) AS id FROM g), m AS (SELECT *, CASE WHEN path = '.' THEN '' WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS above FROM n)
    SELECT m.id, coalesce(p.id, '') AS parent_id, m.path, m.level, CASE WHEN m.level = 'Item' THEN trim(replace(CASE WHEN regexp_matches(regexp_extract(m.path, '[^\\/]*$'), '^.+\.[^.]*$') THEN regexp_replace(regexp_extract(m.path, '[^\\/]*$'), '\.[^.]*$', '') ELSE regexp_extract(m.path, '[^\\/]*$') END, '_', ' ')) ELSE replace(regexp_extract(m.path, '[^\\/]*$'), '_', ' ') END AS title, m.start_date, m.end_date FROM m LEFT JOIN n p ON p.path = m.above AND p.level = 'RecordGrp'"""
)


_PROGRESS_SQL = "WITH l AS (SELECT CAST(apos // 800 AS VARCHAR) AS batch_id FROM assignments) SELECT batch_id, count(*) AS n FROM l GROUP BY batch_id"

# streams in micro-batches: each run reads what has come, stops, and the next one goes on from the checkpoint


def _in_batches(spark, rows: DataFrame, batch, start, sink_columns: list[str]) -> DataFrame:
    """Writes rows batch by batch, each batch with its own restart of the stream, and reads the sink."""
    base = new_path(spark, "stream")
    placed = materialise(rows.withColumn("__batch", batch), "stream-rows")
    for k in range(4):
        placed.where(F.col("__batch") == k).drop("__batch").write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(placed.drop("__batch").schema).parquet(f"{base}/in")
        start(source).writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*sink_columns)


def _dated_batches(events: DataFrame) -> tuple[DataFrame, F.Column]:
    """Events in two batches by time, then copies of the earliest day, which come too late, then one far ahead, after which the
    windows of all others are closed."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    rows = events.crossJoin(F.broadcast(span))  # one row
    middle = F.timestamp_seconds((F.unix_timestamp("lo") + F.unix_timestamp("hi")) / 2)
    own = rows.withColumn("k", F.when(F.col("ts") < middle, 0).otherwise(1))
    late = rows.where(F.col("ts") < F.expr("lo + INTERVAL 1 DAY")).withColumn("k", F.lit(2))
    ahead = rows.orderBy("event_id").limit(1).withColumns({"ts": F.expr("hi + INTERVAL 30 DAYS"), "k": F.lit(3)})
    return own.unionByName(late).unionByName(ahead).drop("lo", "hi"), F.col("k")


@register("st2_quota_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, sum(CAST(floor(value) AS BIGINT)) > 2000 AS over_cap FROM events GROUP BY 1")
def _quota_stream(spark, sf):
    rows, batch = _dated_batches(T.source(spark, sf, "events").select("event_id", "ts", F.floor("value").cast("long").alias("tokens")))
    return _in_batches(spark, rows, batch, lambda s: streams.usage_quota(s, cap=2000), ["day", "tokens", "over_cap"])


@register("st2_tries_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS client, event_type AS stage, count(*) AS tries, count(*) > 2 AS over FROM events GROUP BY 1, 2, 3")
def _tries_stream(spark, sf):
    rows, batch = _dated_batches(T.source(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("client"), F.col("event_type").alias("stage")))
    return _in_batches(spark, rows, batch, streams.usage_tries, ["day", "client", "stage", "tries", "over"])


@register("st3_session_stream", ORACLE["st3_sessions"])
def _session_stream(spark, sf):
    rows, batch = _dated_batches(T.source(spark, sf, "events").select("event_id", F.col("user_id").alias("session_key"), "ts", F.floor("value").cast("long").alias("tokens")))
    return _in_batches(spark, rows, batch, streams.sessions, ["session_key", "started", "turns", "tokens"]).withColumn("started", F.col("started").cast("timestamp_ntz"))


@register("st1_progress_stream", _PROGRESS_SQL)
def _progress_stream(spark, sf):
    """Answers grow over four restarts of the stream; each epoch stores the batches that changed."""
    base = new_path(spark, "progress")
    lines = T.assignments(spark, sf).select(F.floor(F.col("apos") / 800).cast("string").alias("batch_id"), F.concat_ws(";", "path", "target", "new_title").alias("value"), (F.col("apos") % 4).alias("k"))
    lines = materialise(lines, "answer-lines")
    for k in range(4):
        lines.where(F.col("k") == k).drop("k").write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema("batch_id string, value string").parquet(f"{base}/in")
        streams.store_progress(streams.progress(source), f"{base}/checkpoint", f"{base}/out").awaitTermination()
    return streams.latest_progress(spark, f"{base}/out")
