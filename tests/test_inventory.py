"""Facts about a small inventory of our own wording, and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from inventorium.functions import scalars as X
from inventorium.operators import audit, checks, classify, content, evaluate, explore, hierarchy, joins, postings, runs, sets, windows
from inventorium.plans import differences
from inventorium.plans import plans as P
from inventorium.sources import inventory as inv_io
from inventorium.sources import texts as text_io
from inventorium.streaming import streams

ROWS = [
    ("1", "", ".", "RecordGrp", "École", "", ""),
    ("2", "1", "inscriptions", "RecordGrp", "inscriptions", "", ""),
    ("3", "1", "cantine", "RecordGrp", "cantine", "", ""),
    ("4", "1", "divers", "RecordGrp", "divers", "", ""),
    ("5", "2", "inscriptions/liste élèves 2022.xlsx", "Item", "liste élèves 2022", "2022-09-01", "2022-09-05"),
    ("6", "2", "inscriptions/liste élèves 2023.xlsx", "Item", "liste élèves 2023", "2023-09-01", "2023-09-04"),
    ("7", "3", "cantine/menus_semaine.docx", "Item", "menus semaine", "2022-01-03", "2022-01-03"),
    ("8", "3", "cantine/facture.pdf", "Item", "facture", "2021-11-15", "2021-12-01"),
    ("9", "4", "divers/IMG_kermesse.jpg", "Item", "kermesse", "2022-06-18", "2022-06-18"),
    ("10", "4", "divers/compte rendu.doc", "Item", "compte rendu", "2019-01-10", "2019-01-10"),
]
NAMES = ["id", "parent_id", "path", "level", "title", "start_date", "end_date", "pos"]


@pytest.fixture(scope="module")
def inv(spark):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(ROWS)], NAMES).cache()


def dicts(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_search_folds_accents_and_case(inv):
    assert explore.keyword_search(inv, "Élèves").count() == 2
    assert explore.keyword_search(inv, "eleves 2023").count() == 1
    assert explore.keyword_search(inv, "CANTINE").count() == 3
    assert {(r.path, r.matched) for r in explore.tree_search(inv, "facture").collect()} == {("cantine/facture.pdf", True), ("cantine", False)}


@pytest.mark.parametrize(("spec", "n"), [(None, 6), ({"extension": "pdf"}, 1), ({"extension": ".XLSX"}, 2), ({"folder": "divers"}, 2), ({"folder": "."}, 6), ({"year_min": 2022}, 4), ({"year_max": 2019}, 1), ({"year_min": 2021, "year_max": 2021}, 1), ({"keywords": "liste"}, 2)])
def test_counts(inv, spec, n):
    assert explore.filter_items(inv, spec).count() == n
    rows = explore.count_items(inv, spec).collect()
    assert not rows or rows[0].total == n


@pytest.mark.parametrize("spec", [{"colour": 1}, {"year_min": True}, {"year_max": "2020"}, {"extension": 3}, {"keywords": [1]}, {"folder": 1}])
def test_wrong_filters_are_errors(inv, spec):
    with pytest.raises(ValueError):
        explore.structured_filter(spec)


def test_distributions_and_terms(inv):
    assert dicts(explore.stats_by(inv, "extension"), "value", "n") == {"xlsx": 2, "docx": 1, "pdf": 1, "jpg": 1, "doc": 1}
    assert dicts(explore.stats_by(inv, "year"), "value", "n") == {"2022": 3, "2023": 1, "2021": 1, "2019": 1}
    small = dicts(explore.stats_by(inv, "extension", max_buckets=2), "value", "n")
    assert small["(autres)"] == 3 and sum(small.values()) == 6
    terms = explore.frequent_terms(inv, None, 5).collect()
    assert [r.term for r in terms][:2] == ["cantine", "divers"] and {"eleves", "inscriptions", "liste"} == {r.term for r in terms[2:]}
    with pytest.raises(ValueError):
        explore.stats_by(inv, "size")


def test_pages_and_samples(spark, inv):
    more = spark.createDataFrame([(str(100 + k), "4", f"divers/f{k:02d}.txt", "Item", "f", "", "", 100 + k) for k in range(44)], NAMES)
    all_items = hierarchy.items(inv.unionByName(more))
    last = explore.paginate(all_items, 2)
    assert last.count() == 10 and last.first().total == 50 and last.first().pages == 3
    assert explore.paginate(all_items, -4).first().pos == 4
    with pytest.raises(ValueError, match="50 rows"):
        explore.paginate(all_items, 3)
    assert sorted(r.nth for r in explore.even_sample(inv.unionByName(more), None, 7).collect()) == [i * 50 // 7 for i in range(7)]
    assert explore.even_sample(inv, None, 20).count() == 6


def test_listing_a_folder(inv):
    top = hierarchy.list_folder(inv).collect()
    assert [(r.name, r.n_items) for r in top] == [("cantine", 2), ("divers", 2), ("inscriptions", 2)]
    assert sorted(r.name for r in hierarchy.list_folder(inv, "CANTINE").collect()) == ["cantine/facture.pdf", "cantine/menus_semaine.docx"]
    with pytest.raises(ValueError, match="cantine"):
        hierarchy.list_folder(inv, "cant")


def test_dates_roll_up(inv):
    spans = {r.folder: (r.start_date, r.end_date) for r in hierarchy.rollup_dates(inv).collect()}
    assert spans["."] == ("2019-01-10", "2023-09-04") and spans["cantine"] == ("2021-11-15", "2022-01-03")


def test_empty_dates_do_not_count(spark):
    df = spark.createDataFrame([("1", "", "a", "RecordGrp", "a", "", "", 0), ("2", "1", "a/x", "Item", "x", "", "", 1), ("3", "1", "a/y", "Item", "y", "2020", "", 2)], NAMES)
    assert {tuple(r) for r in hierarchy.rollup_dates(df).collect()} == {(".", "2020", ""), ("a", "2020", "")}


def test_cycles_and_long_chains(spark):
    def tree(edges):
        return spark.createDataFrame(edges, "id string, parent_id string")

    assert hierarchy.has_cycle(tree([("1", "2"), ("2", "1"), ("3", "")])).first().has_cycle
    assert hierarchy.has_cycle(tree([("1", "2"), ("2", "3"), ("3", "2"), ("4", "9")])).first().has_cycle
    assert not hierarchy.has_cycle(tree([(str(k), str(k - 1) if k else "") for k in range(2000)])).first().has_cycle
    assert not hierarchy.has_cycle(tree([])).first().has_cycle


def test_closure_matches_a_walk(spark):
    rng = random.Random(3)
    parents = {k: rng.randrange(k) if k else None for k in range(60)}
    got = {(int(r.id), int(r.ancestor), r.distance) for r in hierarchy.closure_by_id(spark.createDataFrame([(str(k), "" if p is None else str(p)) for k, p in parents.items()], "id string, parent_id string")).collect()}
    want = set()
    for k in parents:
        p, d = parents[k], 1
        while p is not None:
            want.add((k, p, d))
            p, d = parents[p], d + 1
    assert got == want


def test_audit_measures(spark, inv):
    extra = [("20", "4", "divers/Thumbs.db", "Item", "", "", "", 20), ("21", "4", "divers/~$x.doc", "Item", "", "", "", 21), ("22", "4", "divers/a.tmp", "Item", "", "", "", 22), ("23", "1", "vide", "RecordGrp", "", "", "", 23), ("24", "3", "cantine/FACTURE.pdf", "Item", "f", "", "", 24), ("25", "1", "seul.zip", "Item", "s", "", "", 25), ("26", "1", "01_ordre", "RecordGrp", "Ordre", "", "", 26)]
    df = inv.unionByName(spark.createDataFrame(extra, NAMES))
    assert dicts(audit.noise(df), "kind", "n") == {"system": 1, "lock": 1, "temp": 1}
    assert dicts(audit.name_collisions(df), "name", "n") == {"facture.pdf": 2}
    assert dicts(audit.risky_formats(df), "extension", "n") == {"doc": 2}
    assert dicts(audit.compressed_formats(df), "extension", "n") == {"zip": 1}
    s = audit.structure(df).first()
    assert (s.root_items, s.prefixed_folders, s.folder_count) == (1, 1, 5) and s.root_items_pct == 9.1
    e = hierarchy.empty_folders(df).first()
    assert (e.n_empty, e.examples) == (2, "vide | Ordre")
    assert not audit.strict_duplicate_totals(df).first().available
    fp = df.withColumn("fingerprint", F.when(F.col("level") == "Item", F.upper(F.substring("title", 1, 1))).otherwise(""))
    d = audit.strict_duplicate_totals(fp).first()
    assert d.available and d.files - d.groups == d.redundant
    told = {(r.measure, r.key): r.n for r in audit.scan_report(fp).collect()}
    assert told[("strict_duplicates", "redundant")] == d.redundant and told[("empty_folders", "n_empty")] == 2 and told[("empty_folder_examples", "Ordre")] == 2
    assert {(r.measure, r.key): r.n for r in audit.scan_report(df).collect()}[("strict_duplicates", "available")] == 0
    both = fp.withColumn("fonds_id", F.lit("a")).unionByName(fp.where("id <> '8'").withColumn("fonds_id", F.lit("b")))
    for f, own in (("a", fp), ("b", fp.where("id <> '8'"))):
        want = sorted(map(tuple, audit.scan_report(own).collect()), key=str)
        assert sorted(map(tuple, audit.scan_report(both, ("fonds_id",)).where(F.col("fonds_id") == f).drop("fonds_id").collect()), key=str) == want


def test_rules(spark, inv):
    assert all(r.n == 0 for r in checks.validate(inv, True).collect())
    bad = inv.unionByName(spark.createDataFrame([("5", "99", "x", None, "", "2021", "2020", 50)], inv.schema))
    assert dicts(checks.validate(bad, True), "rule", "n") == {"invalid_level": 1, "duplicate_id": 2, "start_after_end": 1, "orphan": 1, "no_root": 0, "parent_cycle": 0}
    with pytest.raises(ValueError):
        checks.validate(inv.drop("title"))


PLAN = """Préambule 9_faux/
## Arborescence technique
```text
Dossier_racine/
├─ 1. Scolarité → 1_Scolarite/
│  └─ 1.1. Élèves -> 1-1_Eleves/
├─ 2. Restauration → 2_Restauration/
└─ 10. Vie → 10_Vie_locale/
```
Préconisations : 8_rien/
"""


def test_plan_text_is_parsed_and_rendered_back(spark):
    texts = spark.createDataFrame([("p", PLAN), ("q", "Mairie_X/\n1_A_b/\n1-1_C/"), ("r", "rien"), ("n", None)], "plan_id string, text string")
    plan = P.parse_plans(texts)
    got = {(r.plan_id, r.folder): (r.parent, r.title) for r in plan.collect()}
    assert got == {
        ("p", "1_Scolarite"): (None, "Scolarité"), ("p", "1-1_Eleves"): ("1_Scolarite", "Élèves"), ("p", "2_Restauration"): (None, "Restauration"), ("p", "10_Vie_locale"): (None, "Vie"),
        ("q", "Mairie_X"): (None, ""), ("q", "1_A_b"): ("Mairie_X", ""), ("q", "1-1_C"): ("1_A_b", ""),
    }
    again = P.parse_plans(P.render_plans(P.plan_nodes(texts.where("plan_id = 'p'"))))
    assert {r.title for r in again.collect()} == {"Scolarité", "Élèves", "Restauration", "Vie"} and again.where("parent IS NULL").count() == 3
    shape = hierarchy.plan_shape(plan).where("plan_id = 'p'").first()
    assert (shape.folders, shape.depth, shape.max_children, shape.leaves) == (4, 2, 3, 3)


def test_natural_order(spark):
    names = spark.createDataFrame([(n,) for n in ("10_Z", "2_B", "1-10_C", "1-2_D", "Annexe")], "n string")
    assert [r.n for r in names.orderBy(windows.natural_plan_order(F.col("n"))).collect()] == ["1-2_D", "1-10_C", "2_B", "10_Z", "Annexe"]


def test_plan_differences(spark):
    old = spark.createDataFrame([("a", p) for p in ("x", "x/1", "x/2", "y", "y/k", "z")], "plan_id string, path string")
    new = spark.createDataFrame([("a", p) for p in ("X2", "X2/1", "X2/2", "w", "w/y", "w/y/k", "z")], "plan_id string, path string")
    got = {(r.old_path, r.new_path, r.change) for r in differences.diff_plans(old, new).collect()}
    assert got == {("x", "X2", "renamed"), ("y", "w/y", "moved"), ("z", "z", "unchanged"), (None, "w", "added")}
    # the closest name is the rename, though a move would fit the same leaf, and the closest parent is the move
    old = spark.createDataFrame([("a", p) for p in ("Budget", "Conseil", "Conseil/Actes", "Ecole", "Ecole/Menus", "Mairie")], "plan_id string, path string")
    new = spark.createDataFrame([("a", p) for p in ("Budgets", "Conseil", "Ecole", "Mairie", "Mairie/Actes", "Archives", "Ecoles", "Ecoles/Menus", "Archives/Menus")], "plan_id string, path string")
    got = {(r.old_path, r.new_path) for r in differences.diff_plans(old, new).where("change IN ('renamed', 'moved')").collect()}
    assert got == {("Budget", "Budgets"), ("Conseil/Actes", "Mairie/Actes"), ("Ecole/Menus", "Ecoles/Menus")}


def test_classification_keeps_account_of_every_row(spark, inv):
    plan = P.parse_plans(spark.createDataFrame([("p", PLAN)], "plan_id string, text string"))
    asg = spark.createDataFrame(
        [
            ("inscriptions/liste élèves 2022.xlsx", "1_Scolarite/1-1_Eleves", "Liste 2022.pdf", 1),
            ("inscriptions/liste élèves 2023.xlsx", "1-1_Eleves", "Liste 2023", 2),
            ("cantine/menus_semaine.docx", "2_Restauration/Menus d'hiver", "Menus.docx", 3),
            ("cantine/facture.pdf", "scan.pdf", "Facture.PDF", 4),
            ("divers/nulle_part.doc", "2_Restauration", "x", 5),
            ("divers/IMG_kermesse.jpg", None, "k", 6),
        ],
        "path string, target string, new_title string, apos long",
    )
    allowed = spark.createDataFrame([("2_Restauration",)], "folder string")
    done = classify.finalize(asg, inv, plan, allowed)
    by = {r.path: (r.status, r.folder, r.fixed_title) for r in done.status.collect()}
    assert by["inscriptions/liste élèves 2022.xlsx"] == ("ok", "1-1_Eleves", "Liste 2022.xlsx")
    assert by["cantine/menus_semaine.docx"] == ("ok", "2-1_Menus_d_hiver", "Menus.docx")
    assert by["cantine/facture.pdf"][0] == "malformed" and by["cantine/facture.pdf"][2] == "Facture.pdf"
    assert by["divers/nulle_part.doc"][0] == "unknown_path" and by["divers/IMG_kermesse.jpg"][0] == "unknown_target"
    rows = {r.path: r for r in done.rows.collect()}
    assert rows["."].start_date == "2021-11-15" and rows["1_Scolarite"].end_date == "2023-09-04"
    assert rows["2-1_Menus_d_hiver"].parent_id == rows["2_Restauration"].id and rows["cantine/facture.pdf"].parent_id == "1"
    assert all(r.n == 0 for r in checks.validate(done.rows, True).collect())
    c = classify.counters(done.status, inv).first()
    assert (c.total, c.classified, c.unclassified, c.malformed, c.targets_unknown, c.paths_not_found) == (6, 4, 1, 1, 1, 1)
    counts = dicts(classify.anomaly_counts(classify.anomalies(done, inv, plan)), "category", "n")
    assert counts == {"nonClasse": 1, "cibleInconnue": 1, "pathIntrouvable": 1, "cibleMalformee": 1, "nonRealise": 1, "sousDossierCree": 1, "extension": 3}
    assert not classify.conformity(plan, done.rows.where("level = 'RecordGrp' AND path <> '.'").select(F.col("path").alias("folder")), done.created).first().plan_matches
    preview = {r.source: r.target_path for r in classify.copy_preview(done.rows).collect()}
    assert preview["cantine/menus_semaine.docx"] == "2_Restauration/2-1_Menus_d_hiver/Menus.docx"
    bare = windows.strip_folder_numbers(done.rows)
    assert {"Scolarite", "Eleves", "Restauration"} <= {r.path for r in bare.collect()}
    f = joins.expectations_met(done.rows, spark.createDataFrame([("cantine/menus_semaine.docx", "2_Restauration", True), ("cantine/menus_semaine.docx", "2_Restauration", False), ("inscriptions/liste élèves 2023.xlsx", "1-1_Eleves", False)], "path string, folder string, under boolean"))
    assert sorted((r.under, r.followed) for r in f.collect()) == [(False, False), (False, True), (True, True)]
    assert evaluate.directives_followed(done.rows, f.select("path", "folder", "under")).first().followed == 2


def test_names_that_clash_are_numbered(spark):
    rows = spark.createDataFrame([("d", n, k) for k, n in enumerate(["a.txt", "A.txt", "a (2).txt", "a.txt", "b", "B", ".x", "e.tar.gz"])] + [("e", "a.txt", 9)], "dir string, name string, pos long")
    got = [r.name for r in windows.dedup_names(rows, "dir", "name").orderBy("pos").collect()]
    # in turn: the second name takes (2), so the one that is called so already is numbered itself
    assert got == ["a.txt", "A (2).txt", "a (2) (2).txt", "a (3).txt", "b", "B (2)", ".x", "e.tar.gz", "a.txt"]


@pytest.mark.parametrize("style", [windows.FILE_NAMES, windows.FOLDER_NAMES])
def test_names_are_numbered_as_if_in_turn(spark, style):
    rng = random.Random(3)
    bits = ["a", "a (2)", "a_2", "A", "b", "a (2) (2)", "a_2_2", "a_3", "Straße", "STRASSE", "a. (2)"]
    rows = [(rng.choice("xyz"), rng.choice(bits) + rng.choice(["", ".txt", ".", ".TXT", ".b.txt"]), k) for k in range(260)] + [("big", "Facture.pdf", 1000 + k) for k in range(90)]

    def in_turn(names):
        taken, out = set(), []
        for n in names:
            made, k = n, 2
            stem, dot, ext = n.rpartition(".") if style.extension else ("", "", "")
            while made.casefold() in taken:
                made = f"{stem if dot else n}{style.before}{k}{style.after}{'.' + ext if dot and ext else ''}"
                k += 1
            taken.add(made.casefold())
            out.append(made)
        return out

    want = {}
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        want |= dict(zip([r[2] for r in own], in_turn([r[1] for r in own]), strict=True))
    frame = spark.createDataFrame(rows, "dir string, name string, pos long").repartition(4)
    got = dicts(windows.dedup_names(frame, "dir", "name", style=style), "pos", "name")
    assert got == want


def test_trees_are_walked_without_a_closure(spark):
    rng = random.Random(6)
    parents = {}
    for h in "ab":
        for k in range(60):
            parents[h, k] = None if not k or rng.random() < 0.05 else rng.randrange(k)
        for k in range(100, 400):
            parents[h, k] = k - 1 if k > 100 else 3
    parents["a", 990] = 5555  # a parent that is no node
    rows = [(h, str(k), "" if p is None else str(p), k % 17) for (h, k), p in parents.items()]
    tree = spark.createDataFrame(rows, "fonds string, id string, parent_id string, v int")

    def chain(h, k):
        while k is not None and (h, k) in parents:
            yield k
            k = parents[h, k]

    above = {(h, k): list(chain(h, k)) for h, k in parents}
    below = {}
    for (h, k), up in above.items():
        for u in up:
            below.setdefault((h, u), []).append(k)
    by = ("fonds",)
    paths = {(r.fonds, int(r.id)): r.full_path for r in hierarchy.full_paths(tree, "id", by).collect()}
    assert paths == {x: "/".join(map(str, reversed(up))) for x, up in above.items()}
    sums = {(r.fonds, int(r.id)): (r.n, r.low) for r in hierarchy.over_subtrees(tree, {"n": (F.lit(1), F.sum), "low": (F.col("v"), F.min)}, by).collect()}
    assert sums == {x: (len(b), min(k % 17 for k in b)) for x, b in below.items()}
    found = {(r.fonds, int(r.id)): (r.pre, r.post, r.depth) for r in hierarchy.intervals(tree, by).collect()}
    assert {x: f[2] for x, f in found.items()} == {x: len(up) - 1 for x, up in above.items()}
    for x, (pre, post, _) in found.items():
        inside = {y for y, f in found.items() if y[0] == x[0] and pre <= f[0] < post}
        assert inside == {(x[0], k) for k in below[x]}
    cycle = spark.createDataFrame([("1", "2", "x"), ("2", "1", "y"), ("3", "2", "z"), ("4", "", "w"), ("5", "4", "v")], "id string, parent_id string, title string")
    assert dicts(hierarchy.full_paths(cycle), "id", "full_path") == {"1": "x", "2": "y", "3": "z", "4": "w", "5": "w/v"}


def test_two_holdings_are_classified_in_one_job(spark, inv):
    plans = spark.createDataFrame([("a", PLAN), ("b", PLAN.replace("Eleves", "Enfants"))], "plan_id string, text string")
    plan = P.parse_plans(plans).withColumn("fonds_id", F.col("plan_id"))
    said = [("inscriptions/liste élèves 2022.xlsx", "1_Scolarite/1-1_Eleves", "Liste.pdf", 1), ("cantine/menus_semaine.docx", "2_Restauration/Menus d'hiver", "Menus.docx", 2), ("cantine/facture.pdf", "scan.pdf", "F", 3), ("nulle/part.doc", "2_Restauration", "x", 4), ("divers/IMG_kermesse.jpg", None, "k", 5)]
    asg = spark.createDataFrame([(f, *r) for f in "ab" for r in said if (f, r[3]) != ("b", 2)], "fonds_id string, path string, target string, new_title string, apos long")
    both = inv.withColumn("fonds_id", F.lit("a")).unionByName(inv.where("id <> '8'").withColumn("fonds_id", F.lit("b")))
    allowed = plan.where("folder = '2_Restauration'").select("fonds_id", "folder")
    by = ("fonds_id",)
    done = classify.finalize(asg, both, plan, allowed, True, by)
    for f in "ab":
        own = [d.where(F.col("fonds_id") == f).drop("fonds_id") for d in (asg, both, plan, allowed)]
        alone = classify.finalize(*own, True)
        for part, want in ((done.rows, alone.rows), (done.created, alone.created), (classify.anomalies(done, both, plan, by), classify.anomalies(alone, own[1], own[2])), (classify.counters(done.status, both, by), classify.counters(alone.status, own[1])), (classify.copy_preview(done.rows, by=by), classify.copy_preview(alone.rows))):
            got = part.where(F.col("fonds_id") == f).select(*want.columns)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_answers_are_read_as_they_come(spark):
    fence = "```"
    raw = [
        ("1", f"Avant\n{fence}csv\nPath;TargetFolder;NewTitle\nx/old;1_A;t\n{fence}\nencore\n{fence}\nPath;TargetFolder;NewTitle\na/b.txt;1_A;Titre\n\"c;d.txt\";2_B;\"Un; deux\"\n[FIN LOT]\n{fence}\nfin"),
        ("2", "a,1_A,Titre\nb,2_B,T,extra"),
        ("3", "#;Path;TargetFolder;NewTitle\n1;p/q;1_A;T"),
        ("4", "Je ne peux pas."),
        ("5", None),
        ("6", "p;1_A"),
        ("7", f"{fence}\nTargetFolder;Path;NewTitle\n2_B;r/s;Un\n3_C;[FIN];\n1_A;t/u\n{fence}"),
        ("8", "\ufeff\"Path\";\"TargetFolder\";\"NewTitle\"\r\n\"v \"\"w\"\"\";\"1_A\";\"\"\r\nVoilà, terminé."),
        ("9", "Path\tTargetFolder\tNewTitle\nx\t1_A\tT, de, plus"),
        ("10", "a.pdf;1_X\nc.pdf;2_Y;T"),
    ]
    got = {(r.batch_id, r.path, r.target, r.new_title) for r in text_io.ingest_responses(spark.createDataFrame(raw, "batch_id string, raw_text string")).collect()}
    assert got == {("1", "a/b.txt", "1_A", "Titre"), ("1", "c;d.txt", "2_B", "Un; deux"), ("2", "a", "1_A", "Titre"), ("2", "b", "2_B", "T"), ("3", "p/q", "1_A", "T"), ("6", "p", "1_A", ""), ("7", "r/s", "2_B", "Un"), ("7", "t/u", "1_A", ""), ("8", 'v "w"', "1_A", ""), ("9", "x", "1_A", "T, de, plus"), ("10", "a.pdf", "1_X", ""), ("10", "c.pdf", "2_Y", "T")}


def test_files_round_trip(spark, inv, tmp_path):
    inv_io.write_inventory(inv, str(tmp_path / "out"))
    back = inv_io.read_inventory(spark, str(tmp_path / "out"))
    assert {tuple(r)[:7] for r in back.collect()} == {tuple(r)[:7] for r in inv.collect()}
    native = tmp_path / "native.csv"
    native.write_text('Id;ParentId;Content.DescriptionLevel;Content.Title;Content.StartDate;Content.EndDate;ObjectFiles;Extra\n"Import-1";"";"RecordGrp";"École";"";"";"";"e"\n"Import-2";"Import-1";"Item";"x";"2020";"";"a\\x.txt";""\n', encoding="utf-8-sig")
    rows = inv_io.read_inventory(spark, str(native)).orderBy("pos").collect()
    assert [(r.id, r.parent_id, r.path, r.Extra) for r in rows] == [("1", "", ".", "e"), ("2", "1", "a/x.txt", "")]


def test_folders_become_inventories(spark, tmp_path):
    (tmp_path / "t" / "sub dir").mkdir(parents=True)
    for name in ("a_b.txt", "sub dir/c.pdf", "sub dir/Thumbs.db"):
        (tmp_path / "t" / name).write_text("x")
    got = {r.path: (r.level, r.title) for r in inv_io.folder_inventory(spark, str(tmp_path / "t")).collect()}
    assert got == {".": ("RecordGrp", "."), "sub dir": ("RecordGrp", "sub dir"), "a_b.txt": ("Item", "a b"), "sub dir/c.pdf": ("Item", "c")}


def test_fingerprints(spark, inv):
    files = spark.createDataFrame([("cantine\\facture.pdf", bytearray(b"abc"))], "path string, content binary")
    got = inv_io.fingerprint(inv, files)
    assert dicts(got.groupBy("fingerprint_status").count(), "fingerprint_status", "count") == {"hashed": 1, "missing": 5, "skipped": 4}
    assert got.where("fingerprint_status = 'hashed'").first().fingerprint.startswith("ba7816bf")


def test_corrections_directives_cases_and_reports(spark, tmp_path):
    (tmp_path / "c.csv").write_text("path;targetFolder;new_title\n a ; 1_A ;T\nb;;T\n")
    assert [(r.path, r.target) for r in text_io.read_corrections(spark, str(tmp_path / "c.csv")).collect()] == [("a", "1_A")]
    with pytest.raises(ValueError):
        text_io.normalise_corrections(spark.createDataFrame([("a",)], "path string"))
    (tmp_path / "d.txt").write_text("# note\n1_A : trier [+sous-dossiers]\nToujours dater : oui\n\n")
    assert [(r.folder, r.text, r.allow_creation) for r in text_io.read_directives(spark, str(tmp_path / "d.txt")).collect()] == [("1_A", "trier", True), ("", "Toujours dater : oui", False)]
    (tmp_path / "k.json").write_text('{"cases": [{"question": "q", "attendu": {"type": "x"}}, {"id": "z", "question": "r", "attendu": {}}, {"question": "s"}]}')
    assert [r.case_id for r in text_io.read_cases(spark, str(tmp_path / "k.json")).collect()] == ["cas-1", "z"]
    (tmp_path / "r.json").write_text('{"generatedAt": "2024", "label": "l", "runs": [{"model": "m"}, {"model": "n"}]}')
    assert text_io.read_eval_reports(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans" / "a.md").write_text("1_A_b/")
    (tmp_path / "plans" / "b.md").write_text("rien")
    (tmp_path / "plans" / "c.csv").write_text("ID;File\n1;x")
    assert {r.plan_id for r in text_io.usable_plans(text_io.read_plans(spark, str(tmp_path / "plans"))).collect()} == {"a.md", "c.csv"}


def test_scalars(spark):
    row = spark.createDataFrame([(1,)], "k int").select(
        X.fold(F.lit("ÀÉÎõü Œuf")).alias("fold"), X.extension(F.lit("a/.hidden")).alias("hidden"), X.extension(F.lit("a\\b.TXT")).alias("ext"), X.slugify(F.lit("L'été – 2024 !")).alias("slug"), X.slugify(F.lit("—")).alias("none"),
        X.preserve_extension(F.lit("Titre.pdf"), F.lit("x/y.DOCX")).alias("kept"), X.preserve_extension(F.lit("Titre"), F.lit("x/y")).alias("bare"), X.conservation_label(F.lit("2. Conseils d'école 2")).alias("label"), X.redact_emails(F.lit("à jean.dupont@mairie.fr.")).alias("mail"),
        X.sanitize_filename(F.lit(' a:b/c?.. ')).alias("safe"), X.sanitize_filename(F.lit("..")).alias("void"), X.order_verdict(F.lit("**Ordre existant :** Partiellement structuré")).alias("verdict"), X.volumetry_line(F.lit("Items : 12 | RecordGrp : 3 | Profondeur : 4 niveaux")).alias("v"),
        X.pick_title(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(s).alias("style")) for t, s in (("document", "Title"), ("y", "position"), ("@@## 12", "Heading 1"), ("Première ligne", "position"), ("Vrai titre", "Heading 2"))]), F.lit("x/y.doc")).alias("title"), X.action_json(F.lit('ok {"a": "}{", "b": {"c": 1}} fin {}')).alias("call"), X.normalize_usage(F.lit('{"prompt_tokens": 3, "completion_tokens": 4, "prompt_tokens_details": {"cached_tokens": 1}}')).alias("u"),
        X.gabarit_sections(F.lit("# 1.1 A\n## 1.3 B\ntext 1.2")).alias("sections"), X.report_sections(F.lit("# Partie 2 : plan\na <!-- PLAN_STRUCTURE_START -->\nX_y/\n<!-- PLAN_STRUCTURE_END -->\n# Partie 3\nnotes\n")).alias("r"), X.format_description([("A", F.lit("x")), ("B", F.lit(""))], 10).alias("d"),
    ).first()
    assert row.fold == "aeiou œuf" and row.hidden == "" and row.ext == "txt" and row.slug == "L_ete_2024" and row.none == "Nouveau_dossier"
    assert row.kept == "Titre.DOCX" and row.bare == "Titre" and row.label == "2 conseils ecole" and row.mail == "à [email]@mairie.fr."
    assert row.safe == "a_b_c_" and row.void == "sans_nom" and row.verdict == "PARTIELLEMENT STRUCTURÉ" and tuple(row.v) == (12, 3, 4)
    assert row.title == "Vrai titre" and row.call == '{"a": "}{", "b": {"c": 1}}' and tuple(row.u) == (3, 4, 7, 1, None) and row.sections == ["1.1", "1.3"]
    assert tuple(row.r) == ("X_y/", "notes") and row.d == "A : x"


def test_actions_are_the_first_object_that_is_json(spark):
    said = [
        ('{"reponse": "ok"}', '{"reponse": "ok"}'), ("Voici :\n```json\n{\"outil\": {\"a\": [\"}{\"]}}\n```", '{"outil": {"a": ["}{"]}}'), ("{not json} {\"tool\": 1} {}", '{"tool": 1}'),
        ("rien", None), ('{"cassé": ', None), ("", None), (None, None), ("{" * 3000, None), ('{"a": {"b": 1}', '{"b": 1}'), ("[1] {} {", "{}"),
    ]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(said)], "k int, t string").select("k", X.action_json(F.col("t")).alias("a"))
    assert dicts(got, "k", "a") == {k: a for k, (_, a) in enumerate(said)}


def test_sections_of_a_report(spark):
    said = ["# 1.1 Volumes\n## PLANS  DE CLASSEMENT proposés\nA_b/\n\nB_c/\n## Partie 3\nune note\nune autre\n═══ FIN ═══\nreste", "## NOTES POUR la suite\nseules", "texte", None, "# Plan de classement\nseul"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string").select("k", X.report_sections(F.col("t")).alias("r")).orderBy("k").collect()
    assert [tuple(r.r) for r in got] == [("A_b/\n\nB_c/", "une note\nune autre"), ("", "seules"), ("", ""), ("", ""), ("seul", "")]


def test_order_over_several_files(spark, tmp_path):
    (tmp_path / "many").mkdir()
    head = "ID;ParentID;File;Content.DescriptionLevel;Content.Title;Content.StartDate;Content.EndDate\n"
    for k, n in (("a", 2), ("b", 400), ("c", 1)):  # Spark reads the largest first
        (tmp_path / "many" / f"{k}.csv").write_text(head + "".join(f"{k}{j};0;{k}/{j:03d};Item;t;;\n" for j in range(n)))
    rows = inv_io.read_inventory(spark, str(tmp_path / "many")).orderBy("pos").collect()
    assert [r.path for r in rows] == [f"a/{j:03d}" for j in range(2)] + [f"b/{j:03d}" for j in range(400)] + ["c/000"]
    (tmp_path / "lines").mkdir()
    for k, n in (("a", 1), ("b", 300)):
        (tmp_path / "lines" / f"{k}.txt").write_text("".join(f"{k}_{j} : note\n" for j in range(n)))
    assert [r.folder for r in text_io.read_directives(spark, str(tmp_path / "lines")).orderBy("pos").collect()] == ["a_0"] + [f"b_{j}" for j in range(300)]


def test_descriptions_are_whole(spark):
    kind = "doc_id int, path string, sections array<string>, description string, title string, headings array<struct<text:string,style:string>>, error string"
    page = "Mairie de X — page\n{}\nvoirie voirie et travaux {}"
    rows = [
        (1, "p/a.pdf", [page.format("Plan des rues", "un"), "non lue", page.format("suite", "deux"), "non lue", page.format("fin", "trois")], "", "Rapport annuel", [], None),
        (2, "p/b.pdf", ["premier corps de texte"], None, "b", [("Titre du style", "Heading 1")], None),
        (3, "p/c.pdf", ["x"], "déjà", None, [], None),
        (4, "p/d.pdf", [], None, None, [], "illisible"),
        (5, "p/e.pdf", [], None, None, None, None),
    ]
    got = {r.doc_id: r for r in content.describe(spark.createDataFrame(rows, kind)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "enriched", 2: "enriched", 3: "already", 4: "error", 5: "missing"}
    said = got[1].description
    assert said.startswith("Titre interne : Rapport annuel · Titre (contenu) : Plan des rues · Mots du contenu : voirie") and "En-tête/pied de page : Mairie de X — page" in said and "non lue" not in said
    assert " · Extrait : " in said and len(said) <= 300
    assert got[2].description.startswith("Titre (contenu) : Titre du style · Extrait : premier corps")
    assert got[3].description == "déjà" and got[5].description is None


def test_a_description_reads_its_text_once(spark):
    """The plan names each step of a description once, however many parts need it."""
    docs = spark.createDataFrame([(1, "d/1", "Alpha beta\fBeta alpha", "")], "doc_id long, path string, text string, description string")
    plan = content.describe(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 2, plan.count("regexp_extract_all(")
    assert plan.count("split(") <= 12, plan.count("split(")
    report = runs.enrich_report(content.describe(docs))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 2, plan.count("regexp_extract_all(")
    assert [tuple(r) for r in report.collect()] == [("enriched", 1)]


def test_a_report_puts_no_description_together(spark):
    """The statuses are those of the descriptions, whichever part alone is not empty, and the plan builds none."""
    kind = "doc_id int, path string, sections array<string>, description string, title string, keywords string, subject string, headings array<struct<text:string,style:string>>, error string, supported boolean"
    digits = ["12 34 56", "78 90"]
    rows = [
        (1, "p/a", digits, "", "Rapport", "", "", [], None, None),
        (2, "p/b", digits, "", "b", "voirie", "", [], None, True),
        (3, "p/c", digits, None, None, None, "plans", None, "", None),
        (4, "p/d", digits, "", "", "", "", [("Titre du style", "Heading 1")], None, None),
        (5, "p/e", ["12 34\n5", "12 34\n6"], "", "", "", "", [], None, None),
        (6, "p/f", ["mairie 1234567890 mairie 1234567890"], "", "", "", "", [], None, None),
        (7, "p/g", ["Un texte lisible\r\net sa suite"], "", "", "", "", [], None, None),
        (8, "p/h", digits, " ", "h", " ", None, [], None, None),
        (9, "p/i", [None, ""], "", "Rapport", "", "", [], None, None),
        (10, "p/j", ["x"], "connu", "", "", "", [], "illisible", False),
        (11, "p/k", ["x"], "", "", "", "", [], "illisible", False),
        (12, "p/l", ["x"], "", "", "", "", [], "illisible", None),
        (13, "p/m", None, "", "", "", "", [], None, None),
    ]
    docs = spark.createDataFrame(rows, kind)
    want = {1: "enriched", 2: "enriched", 3: "enriched", 4: "enriched", 5: "enriched", 6: "enriched", 7: "enriched", 8: "no_text", 9: "missing", 10: "already", 11: "unsupported", 12: "error"}
    for overwrite in (False, True):
        got = dicts(content.statuses(docs, overwrite), "doc_id", "status")
        assert got == dicts(content.describe(docs, overwrite), "doc_id", "status")
        assert {k: got[k] for k in want if k != 10} == {k: v for k, v in want.items() if k != 10} and got[10] == ("unsupported" if overwrite else "already")
    plan = runs.enrich_report(content.statuses(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws(" not in plan and plan.count("regexp_extract_all(") == 1


def test_agent_filters_are_judged_by_what_they_select(spark, inv):
    def turn(case, name, arguments, answer):
        return [("r", case, 0, "tool", name, arguments, None), ("r", case, 1, "toolResult", name, None, '{"total": 1}'), ("r", case, 2, "final", None, None, answer)]

    events = [
        *turn("form", "count", '{"keywords": [], "extension": ".PDF"}', "Il y a 1 fichier."), *turn("same", "count", '{"filter": {"keywords": ["facture"]}}', "1 fichier"),
        *turn("search", "search", '{"keywords": "FACTURE"}', "1"), *turn("other", "count", '{"extension": "xlsx"}', "Il y a 2 fichiers."), *turn("tool", "stats", '{"extension": "pdf"}', "10 fichiers"), *turn("bad", "count", "{oops", "1"),
    ]
    log = spark.createDataFrame(events, "run_id string, case_id string, seq int, type string, name string, arguments string, result string")
    cases = spark.createDataFrame([(c, ["count", "search"], '{"extension":"pdf"}', True) for c in ("form", "same", "search", "other", "tool", "bad")], "case_id string, tools array<string>, filter string, check_total boolean")
    got = {r.case_id: (r.tool_ok, r.filter_ok, r.total_ok, r.passed) for r in evaluate.agent_cases(log, cases, inv).collect()}
    assert got == {"form": (True, True, True, True), "same": (True, True, True, True), "search": (True, True, True, True), "other": (True, False, False, False), "tool": (False, False, False, False), "bad": (True, False, True, False)}
    plain = {r.case_id: r.filter_ok for r in evaluate.agent_cases(log, cases).collect()}
    assert plain["form"] and not plain["same"]


def test_each_holding_has_its_own_figures(spark, inv):
    both = inv.withColumn("fonds_id", F.lit("a")).unionByName(inv.where("id <> '8'").withColumn("fonds_id", F.lit("b")))
    by = ("fonds_id",)
    for f in (lambda d, *b: audit.volumetry(d, *b), lambda d, *b: audit.top_formats(d, 3, *b), lambda d, *b: explore.stats_by(d, "year", None, 2, *b), lambda d, *b: checks.validate(d, True, *b), lambda d, *b: hierarchy.has_cycle(d, *b), lambda d, *b: explore.count_items(d, None, 2, *b), lambda d, *b: audit.name_collision_totals(d, *b)):
        found = f(both, by)
        for holding, own in (("a", inv), ("b", inv.where("id <> '8'"))):
            want = f(own)
            assert sorted(map(tuple, found.where(F.col("fonds_id") == holding).select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_content(spark):
    docs = spark.createDataFrame([(1, "p/a.txt", "École école mairie mairie mairie une une seul a@b.fr a@b.fr", ""), (2, "p/b.txt", "", None), (3, "p/c.txt", "x", "déjà"), (4, "p/d.txt", "1 2 3 4", None)], "doc_id int, path string, text string, description string")
    words = {r.word: r.rank for r in content.recurring_keywords(docs).collect()}
    assert words == {"mairie": 1, "école": 2}
    status = dicts(content.describe(docs), "doc_id", "status")
    assert status == {1: "enriched", 2: "missing", 3: "already", 4: "no_text"}
    sections = spark.createDataFrame([(1, 0, "Pied\nun"), (1, 1, "Pied \ndeux"), (2, 0, "Pied\nPied")], "doc_id int, section int, text string")
    assert [(r.doc_id, r.line, r.n) for r in content.boilerplate_lines(sections).collect()] == [(1, "Pied", 2)]
    sizes = spark.createDataFrame([(0,), (2,), (10,)], "n int").select(content.sample_positions(F.col("n")).alias("p"), content.sample_positions(F.col("n"), around=1).alias("w"))
    assert [(r.p, r.w) for r in sizes.collect()] == [([], []), ([0, 1], [0, 1]), ([0, 5, 9], [0, 1, 4, 5, 6, 8, 9])]


def test_runs_and_prices(spark):
    logs = spark.createDataFrame([("gpt-5-mini", 1_000_000, 10), ("Gemini-2.5-Flash", 1_000_000, 0), ("ollama/x-mini", 5, 5), ("inconnu", 5, 5)], "model string, input_tokens long, output_tokens long")
    got = dicts(runs.cost(logs, joins.price_rules(spark)), "model", "input_eur")
    assert got == {"gpt-5-mini": 0.23, "Gemini-2.5-Flash": 0.28, "ollama/x-mini": None, "inconnu": None}
    tiers = dicts(joins.recommend_sampling(spark.createDataFrame([(200,), (201,), (5001,)], "items long")), "items", "sample_n")
    assert tiers == {200: 0, 201: 5, 5001: 2}


def test_sets_and_batches(spark, inv):
    refs = windows.batch_slices(windows.assign_ref(inv), 4)
    assert dicts(refs.groupBy("batch").count(), "batch", "count") == {0: 4, 1: 2}
    stored = spark.createDataFrame([(0, 4, "x"), (1, 2, " ")], "batch long, n_rows long, raw_text string")
    assert [r.batch for r in classify.pending_batches(refs, stored).collect()] == [1]
    plans = spark.createDataFrame([("a", "1_X_y"), ("a", "2_Z"), ("b", "9_x_y")], "plan_id string, folder string")
    assert [r.label for r in sets.common_folders(plans).collect()] == ["x y"] and [(r.label, r.plan_id) for r in sets.unique_folders(plans).collect()] == [("z", "a")]
    assert joins.filters_equivalent(inv, {"extension": "pdf"}, {"keywords": ["facture"]}) and joins.filters_equivalent(inv, {"extension": "pdf"}, {"no": 1}) is None and not joins.filters_equivalent(inv, {}, {"extension": "pdf"})


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    spark.createDataFrame([("b1", "Path;TargetFolder;NewTitle"), ("b1", "a;b;c"), ("b2", "a;b;c"), ("b2", "prose"), ("b2", "d;e;f")], "batch_id string, value string").write.json(str(tmp_path / "lines"))
    source = spark.readStream.schema("batch_id string, value string").json(str(tmp_path / "lines"))
    _drain(streams.progress(source).writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert dicts(spark.table("progress"), "batch_id", "n") == {"b1": 1, "b2": 2}
    spark.sql("SELECT timestamp '2024-01-01 10:00' AS ts, 150000L AS tokens, 's' AS session_key UNION ALL SELECT timestamp '2024-01-01 10:29', 60000L, 's' UNION ALL SELECT timestamp '2024-01-01 10:59:01', 5L, 's' UNION ALL SELECT timestamp '2024-01-02 10:00', 5L, 's'").write.json(str(tmp_path / "usage"))
    usage = spark.readStream.schema("ts timestamp, tokens long, session_key string").json(str(tmp_path / "usage"))
    _drain(streams.usage_quota(usage).writeStream.outputMode("complete").format("memory").queryName("quota").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert {tuple(r) for r in spark.table("quota").collect()} == {("2024-01-01", 210005, True), ("2024-01-02", 5, False)}
    _drain(streams.sessions(usage).writeStream.outputMode("complete").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c3")).start())
    assert sorted(r.turns for r in spark.table("sessions").collect()) == [1, 1, 2]


def test_each_batch_is_ingested_once(spark, tmp_path):
    def put(batch, name):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text('{"batch_id": "%s", "ts": "2024-01-01T00:00:00Z", "raw_text": "a;1_A;t"}\n' % batch)

    def run():
        streams.ingest(spark, str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    put("1", "a.json")
    assert run() == 1
    put("1", "b.json")
    put("2", "c.json")
    assert run() == 2
    put("1", "d.json")  # a later day
    (tmp_path / "in" / "d.json").write_text('{"batch_id": "1", "ts": "2024-03-01T00:00:00Z", "raw_text": "a;1_A;t"}\n{"batch_id": "3", "ts": "2024-03-02T00:00:00Z", "raw_text": "a;1_A;t"}\n')
    assert run() == 3


def test_ledger(spark, tmp_path):
    kind = "run_id string, started_at timestamp, outcome string, error string, anomalies array<struct<category:string,item:string,detail:string>>"
    rows = spark.createDataFrame([("1", None, "failed", "panne", None), ("2", None, "ok", None, [])], kind)
    text_io.append_ledger(rows.withColumn("started_at", F.lit("2024-01-01").cast("timestamp")), str(tmp_path / "l"))
    assert {r.run_id: len(r.anomalies) for r in spark.read.parquet(str(tmp_path / "l")).collect()} == {"1": 1, "2": 0}


def test_a_file_is_read_in_many_tasks_and_keeps_its_order(spark, tmp_path):
    """Records with line breaks, separators and doubled quotes, longer than a byte range at times."""
    import csv

    rng = random.Random(4)
    fields = ["a", "", "é;ü", 'say "x"', "two\nlines", "\n\n", "x" * 700 + "\n" + "y" * 900, "tab\t", '"']
    rows = [[str(k), "1", f"p/{k}", "Item", *(rng.choice(fields) for _ in range(3))] for k in range(300)]
    folder = tmp_path / "in"
    folder.mkdir()
    names = ["ID", "ParentID", "File", "Content.DescriptionLevel", "Content.Title", "Content.StartDate", "Content.EndDate"]
    for name, part, end in (("b.csv", rows[200:], "\n"), ("a.csv", rows[:200], "\r\n")):
        with open(folder / name, "w", newline="", encoding="utf-8") as out:
            out.write("﻿")
            w = csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator=end)
            w.writerows([names, *part])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        got = inv_io.read_inventory(spark, str(folder)).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [[r.id, r.parent_id, r.path, r.level, r.title, r.start_date, r.end_date] for r in got] == rows
    assert len({r.pos for r in got}) == len(rows)


def test_many_filters_in_one_plan(spark, inv):
    import json

    from inventorium.operators import postings

    specs = [{}, {"extension": "pdf"}, {"extension": ".XLSX"}, {"folder": "divers"}, {"folder": "/cantine/"}, {"folder": "."}, {"folder": "div"}, {"year_min": 2022}, {"year_max": 2019}, {"year_min": 2021, "year_max": 2021},
             {"year_min": 2023, "year_max": 2020}, {"year_min": 12000, "year_max": 15000}, {"keywords": ["liste"]}, {"keywords": ["ÉLÈVES", "2"]}, {"keywords": ["e"]}, {"keywords": ["zz"]}, {"keywords": ["li", "s"], "extension": "xlsx", "folder": "inscriptions", "year_min": 2000}]
    filters = spark.createDataFrame([(json.dumps(s),) for s in specs], "filter string")
    bits = postings.bitmaps(inv, filters)
    found = dicts(postings.totals(bits, filters), "filter", "total")
    assert found == {json.dumps(s): explore.filter_items(inv, s).count() for s in specs}
    pairs = spark.createDataFrame([(json.dumps(a), json.dumps(b)) for a in specs for b in specs], "first string, second string")
    for r in postings.compared(bits, pairs).collect():
        a, b = ({x.path for x in explore.filter_items(inv, json.loads(f)).collect()} for f in (r.first, r.second)) if r.first in (json.dumps(specs[1]), json.dumps(specs[13])) else (None, None)
        if a is not None:
            assert (r.only_first, r.only_second, r.both, r.equal) == (len(a - b), len(b - a), len(a & b), a == b)


def plain_diff(old, new):
    """The same matching, one folder after another."""
    from difflib import SequenceMatcher

    gone, came, out = old - new, new - old, [(p, p, "unchanged") for p in old & new]

    def below(paths, top):
        return frozenset(p[len(top) :] for p in paths if p.startswith(top + "/"))

    def high(p):
        return p.count("/"), p.split("/")

    def cut(p):
        return p.rpartition("/")[::2]

    for kind, same, differ in (("renamed", 0, 1), ("moved", 1, 0)):
        for r in sorted(gone, key=high):
            if r in gone:
                fit = [a for a in sorted(came, key=high) if cut(a)[same] == cut(r)[same] and below(new, a) == below(old, r)]
                if fit:
                    best = max(fit, key=lambda a: SequenceMatcher(None, cut(r)[differ], cut(a)[differ]).ratio())
                    out.append((r, best, kind))
                    gone = {p for p in gone if p != r and not p.startswith(r + "/")}
                    came = {p for p in came if p != best and not p.startswith(best + "/")}
    return {*out, *((p, None, "removed") for p in gone), *((None, p, "added") for p in came)}


def test_plans_differ_as_if_matched_one_by_one(spark):
    rng = random.Random(8)

    def tree(n):
        out = {"a"}
        while len(out) < n:
            out.add(f"{rng.choice(sorted(out))}/{rng.choice('abc')}" if rng.random() < 0.8 else rng.choice("abcd"))
        return out

    def moved(paths):
        """Some subtrees under other names or places, one inside another at times."""
        for _ in range(rng.randint(1, 4)):
            top = rng.choice(sorted(paths))
            rest = sorted(p for p in paths if p != top and not p.startswith(top + "/"))
            if rest:
                to = f"{rng.choice(rest)}/{top.rpartition('/')[2]}" if rng.random() < 0.7 else f"{top}x"
                paths = {(to + p[len(top) :] if p == top or p.startswith(top + "/") else p) for p in paths}
        return paths

    states = {f"p{k}": (old := tree(rng.randint(3, 14)), moved(old)) for k in range(60)}
    states["empty"] = ({"a", "a/b"}, set())
    states["nested"] = ({"a", "a/x", "a/x/y", "b", "b/y", "c", "q"}, {"a", "b", "c", "c/x", "c/x/y", "q"})
    frames = [spark.createDataFrame([(k, p) for k, s in states.items() for p in s[side]], "plan_id string, path string") for side in (0, 1)]
    changes = differences.diff_plans(*frames).cache()
    got = {}
    for r in changes.collect():
        got.setdefault(r.plan_id, set()).add((r.old_path, r.new_path, r.change))
    assert got == {k: plain_diff(*s) for k, s in states.items()}
    for r in differences.summaries(changes).collect():
        assert r.identical == (states[r.plan_id][0] == states[r.plan_id][1]) and r.unchanged == len(states[r.plan_id][0] & states[r.plan_id][1])


def test_folders_without_a_choice_are_matched_by_a_join(spark, monkeypatch):
    """Groups of one folder on each side never reach the Python that chooses between likely ones."""

    def refuse(id_type: str, differ: str):
        def match(key, old, new):
            raise AssertionError(key)

        return match, f"plan_id {id_type}, old_path string, new_path string"

    monkeypatch.setattr(differences, "_matcher", refuse)
    old = spark.createDataFrame([(p, x) for p in (1, 2) for x in ("a", "a/x", "b", "b/q", "b/q/z")], "plan_id long, path string")
    new = spark.createDataFrame([(p, x) for p in (1, 2) for x in ("c", "c/x", "b", "q", "q/z")], "plan_id long, path string")
    got = {(r.plan_id, r.old_path, r.new_path, r.change) for r in differences.diff_plans(old, new).where("change <> 'unchanged'").collect()}
    assert got == {(p, *x) for p in (1, 2) for x in (("a", "c", "renamed"), ("b/q", "q", "moved"))}


def test_plan_texts_are_read_once(spark):
    """Parsed plans come from a table of short rows, and rendered ones from nodes that were ranked once."""
    texts = spark.createDataFrame([(1, "Un → 1_Un/\nDeux → 1-1_Deux/\nTrois → 2_Trois/")], "plan_id long, text string")
    parsed = P.parse_plans(texts)
    assert "Generate" not in parsed._jdf.queryExecution().optimizedPlan().toString()
    rendered = P.render_plans(P.plan_nodes(texts))
    assert "Window" not in rendered._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.folder, r.parent, r.title) for r in P.parse_plans(rendered).collect()} == {("1_Un", None, "Un"), ("1-1_Deux", "1_Un", "Deux"), ("2_Trois", None, "Trois")}


def test_pages_of_holdings_are_found_without_gathering_a_holding(spark, monkeypatch):
    """Front pages by a limit before the shuffle, later ones by a sort over all holdings; both are the same page."""
    rows = spark.range(90).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3).alias("fonds_id"), (100 - F.col("id")).alias("pos"), F.col("id").cast("string").alias("path"))
    front = explore.paginate(rows, 1, 10, ("fonds_id",))
    plan = front._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "count(1) windowspec" not in plan
    got = sorted((r.fonds_id or 0, r.pos, r.total, r.pages) for r in front.collect())
    monkeypatch.setattr(explore, "FRONT_ROWS", 0)
    assert got == sorted((r.fonds_id or 0, r.pos, r.total, r.pages) for r in explore.paginate(rows, 1, 10, ("fonds_id",)).collect())
    want = {k: sorted(100 - i for i in range(90) if i % 3 == k)[10:20] for k in range(3)}
    assert got == sorted((k, p, 30, 3) for k, v in want.items() for p in v)


def test_orphans_are_found_by_one_grouping(spark):
    """No anti-join that a union could repeat for each of its parts, and rows of one parent are summed before the shuffle."""
    parts = [spark.createDataFrame(r, "id string, parent_id string") for r in ([("1", ""), ("2", "1")], [("3", "1"), ("4", "9"), ("5", None)], [("6", "9"), ("7", "8"), (None, "2")])]
    inv = parts[0].unionByName(parts[1]).unionByName(parts[2])
    found = checks.orphans(inv).select("id")
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in found.collect()) == ["4", "6", "7"]
    assert [tuple(r) for r in checks.check_orphans(inv).collect()] == [("orphan", 3)]
    assert [tuple(r) for r in checks.check_orphans(inv.where("parent_id = '1'").unionByName(parts[0])).collect()] == [("orphan", 0)]


def test_few_words_are_looked_for_without_grams(spark, monkeypatch):
    numbered = spark.createDataFrame([(1, "rapport 1 voirie"), (2, "rapport 2"), (3, ".")], "n long, hay string")
    words = spark.createDataFrame([(7, "rapport 1"), (8, "ra"), (9, ".")], "c long, word string")
    few = postings._by_word(numbered, words)
    assert "Generate" not in few._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(tuple(r) for r in few.collect())
    assert got == [(7, 1), (8, 1), (8, 2), (9, 3)]
    monkeypatch.setattr(postings, "FEW_WORDS", 0)
    assert sorted(tuple(r) for r in postings._by_word(numbered, words).collect()) == got
