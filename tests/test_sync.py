from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from codelattice.operators import enrich, snapshots, sync
from codelattice.plans import dsl
from codelattice.schema import DomainError, TRANSITIONS, check_transition
from codelattice.sources import catalog as catalogs
from tests.fixtures import shop

FILES = "project_id string, path string, digest string"
STATE = "id string, project_id string, full_class_name string, description string, source_file string"


def test_transitions():
    for current, targets in TRANSITIONS.items():
        for target in TRANSITIONS:
            if target in targets:
                assert check_transition(current, target) == target
            else:
                with pytest.raises(DomainError):
                    check_transition(current, target)


def test_changes_and_actions(spark):
    old = spark.createDataFrame([("p", "a", "1"), ("p", "b", "1"), ("p", "c", "1"), ("q", "a", "1")], FILES)
    new = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "d", "1"), ("q", "a", "1")], FILES)
    changes = sync.file_changes(old, new)
    assert {(r.project_id, r.path): r.change for r in changes.collect()} == {("p", "a"): "same", ("p", "b"): "modified", ("p", "c"): "deleted", ("p", "d"): "added", ("q", "a"): "same"}
    state = lambda rows: spark.createDataFrame([(f"{tag}{name}", p, name, text, name) for tag, p, name, text in rows], STATE)
    before = state([("o", "p", "a", "A"), ("o", "p", "b", "B"), ("o", "p", "c", "C"), ("o", "q", "a", "Q")])
    after = state([("n", "p", "a", None), ("n", "p", "b", None), ("n", "p", "d", None), ("n", "q", "a", None)])
    touched = changes.filter("change != 'same'").selectExpr("project_id", "path as source_file")
    actions = sync.classify(before, after, touched, full=spark.createDataFrame([("q",)], "project_id string"))
    assert {(r.project_id, r.full_class_name): r.action for r in actions.collect()} == {("p", "a"): "keep", ("p", "b"): "update", ("p", "c"): "delete", ("p", "d"): "add", ("q", "a"): "update"}
    merged = {(r.project_id, r.full_class_name): (r.id, r.description) for r in sync.merged(before, after, actions).collect()}
    assert merged == {("p", "a"): ("oa", "A"), ("p", "b"): ("ob", "B"), ("p", "d"): ("nd", None), ("q", "a"): ("oa", "Q")}
    failed = spark.createDataFrame([("p", "b", False)], "project_id string, source_file string, ok boolean")
    assert sync.merged(before, after, actions, failed).count() == 4
    methods = lambda tag: spark.createDataFrame([(tag, "p", n, "text", "[]") for n in "abcd"], "id string, project_id string, full_class_name string, description string, business_logic string")
    left = {(r.id, r.full_class_name, r.description) for r in sync.merged_methods(methods("o"), methods("n"), actions).collect()}
    assert left == {("o", "a", "text"), ("n", "b", None), ("n", "d", None)}


def test_versions(spark, tmp_path):
    catalog = shop(spark)
    folder = str(tmp_path / "catalog")
    assert snapshots.publish(catalog, folder) == "v000000"
    loaded = catalogs.load(spark, folder)
    assert dsl.run(loaded, "shop:endpoints")[1].count() == 2
    without = snapshots.delete_classes(loaded, loaded.classes.filter("class_type = 'CONTROLLER'").select("id"))
    assert snapshots.publish(without, folder) == "v000001" and snapshots.current_version(spark, folder) == "v000001"
    again = catalogs.load(spark, folder)
    assert again.classes.count() == 4 and again.methods.count() == 3 and again.params.count() == 2 and again.edges.count() == 3
    assert snapshots.delete_projects(again, again.projects.filter("id = 'p1'")).methods.count() == 0
    (tmp_path / "catalog" / "v000009").mkdir()
    assert snapshots.current_version(spark, folder) == "v000001"  # not whole
    with pytest.raises(FileNotFoundError):
        snapshots.current_version(spark, str(tmp_path / "nothing"))
    (tmp_path / "catalog" / "v000009").rmdir()
    third = snapshots.publish(snapshots.set_status(again, "p1", "SYNCING"), folder, ("projects",))
    assert sorted(p.name for p in (tmp_path / "catalog" / third).iterdir() if p.is_dir()) == ["projects"]
    latest = catalogs.load(spark, folder)
    assert latest.classes.count() == 4 and latest.projects.filter("status = 'SYNCING'").count() == 1
    marked = snapshots.set_commit(latest, latest.classes.limit(1).select("id"), "abc")
    assert marked.classes.filter("commit_hash = 'abc'").count() == 1
    assert snapshots.delete_parameters_of_methods(latest, latest.params.select("method_id")).params.count() == 0


def test_row_changes(spark):
    catalog = shop(spark)
    more = snapshots.insert(catalog.projects, spark.createDataFrame([("p3", "new", 1)], "id string, name string, other int"))
    assert more.columns == catalog.projects.columns and more.count() == 3
    updates = spark.createDataFrame([("c3", "Stores", None)], "id string, description string, class_type string")
    row = snapshots.update(catalog.classes, updates).filter("id = 'c3'").first()
    assert (row.description, row.class_type) == ("Stores", "REPOSITORY")
    owners, targets = spark.createDataFrame([("c2",)], "class_id string"), spark.createDataFrame([("c4",)], "class_id string")
    assert snapshots.delete_parameters_of(catalog, owners).params.count() == 1
    assert snapshots.delete_parameters_to(catalog, targets).params.count() == 1
    assert snapshots.set_status(catalog, "p1", "SYNCING").projects.filter("status = 'SYNCING'").count() == 1
    for project, status, code in (("p1", "PENDING", "PROJECT_INVALID_TRANSITION"), ("px", "SYNCING", "PROJECT_NOT_FOUND")):
        with pytest.raises(DomainError) as error:
            snapshots.set_status(catalog, project, status)
        assert error.value.code == code


def _stub(prompts):
    if any("OrderDto" in p for p in prompts):
        raise RuntimeError("no answer")
    return ['```json\n{"description": "It is {fine}", "classType": "UTILITY", "methods": {"run": {"description": "Runs", "businessLogic": ["a", "b"]}, "cut' for _ in prompts]


def test_enrichment(spark):
    catalog = shop(spark)
    asked = enrich.prompts(catalog.classes, catalog.methods)
    assert {r.class_id for r in asked.collect()} == {"c3", "c4", "c5"}
    read = {r.class_id: r for r in enrich.read_replies(enrich.ask(asked, _stub, in_flight=3, batch=1)).collect()}
    assert not read["c4"].success and read["c4"].error == "no answer"
    assert read["c3"].success and read["c3"].description == "It is {fine}" and read["c3"].methods["run"].businessLogic == ["a", "b"]
    assert read["c5"].class_type == "UTILITY"


def test_listing_of_repositories(spark):
    from codelattice.sources import files

    lines = spark.createDataFrame([("https://a/b.git dev # note",), ("# only a note",), ("",), ("git@a:b.git",)], "value string")
    assert {(r.url, r.branch) for r in files.repository_list(lines).collect()} == {("https://a/b.git", "dev"), ("git@a:b.git", "main")}


def test_one_project_is_replaced_by_its_own_files(spark, tmp_path):
    catalog, folder = shop(spark), str(tmp_path / "catalog")
    more = catalog.classes.withColumns({"id": F.concat("id", F.lit("x")), "project_id": F.lit("p/2 ü")})
    both = replace(catalog, classes=catalog.classes.union(more))
    snapshots.publish(both, folder)
    only = catalogs.load(spark, folder, ["p1"])
    assert only.classes.count() == 5 and only.methods.count() == 5 and {r.project_id for r in only.classes.collect()} == {"p1"}
    assert all("project_id=p1" in f for table in (only.classes, only.methods, only.edges) for f in table.inputFiles())
    assert catalogs.load(spark, folder, ["p/2 ü"]).classes.count() == 5 and catalogs.load(spark, folder, ["none"]).methods.count() == 0
    changed = replace(catalog, classes=catalog.classes.filter("id <> 'c5'"), methods=catalog.methods.filter("id <> 'm5'"))
    ids = spark.createDataFrame([("p1",)], "project_id string")
    version = snapshots.publish(changed, folder, snapshots.OWNED, ids)
    written = {p.relative_to(tmp_path / "catalog" / version).parts[:2] for p in (tmp_path / "catalog" / version).rglob("*.parquet")}
    assert written == {(name, "project_id=p1") for name in snapshots.OWNED}
    latest = catalogs.load(spark, folder)
    assert {(r.project_id, r["count"]) for r in latest.classes.groupBy("project_id").count().collect()} == {("p1", 4), ("p/2 ü", 5)}
    assert latest.methods.count() == 4 and latest.methods.columns == catalog.methods.columns
    read = catalogs.load(spark, folder, ["p1"]).classes
    assert read.count() == 4 and all(f"/{version}/" in f for f in read.inputFiles())
    snapshots.publish(replace(catalog, **{t: getattr(catalog, t).limit(0) for t in snapshots.OWNED}), folder, snapshots.OWNED, ids)
    assert {r.project_id for r in catalogs.load(spark, folder).classes.collect()} == {"p/2 ü"}


def test_many_versions_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_PARTS", 2)
    catalog, folder = shop(spark), str(tmp_path / "catalog")
    snapshots.publish(catalog, folder)
    for n in range(3):
        ids = spark.createDataFrame([(f"new{n}",)], "project_id string")
        one = replace(catalog, classes=catalog.classes.filter("id = 'c1'").withColumns({"id": F.lit(f"n{n}"), "project_id": F.lit(f"new{n}")}), methods=catalog.methods.limit(0))
        snapshots.publish(one, folder, snapshots.OWNED, ids)
    assert len(snapshots.manifest(spark, folder)["classes"]["parts"]) == 2
    latest = catalogs.load(spark, folder)
    assert {(r.project_id, r["count"]) for r in latest.classes.groupBy("project_id").count().collect()} == {("p1", 5), ("new0", 1), ("new1", 1), ("new2", 1)}
    assert latest.methods.count() == 5 and latest.edges.count() == catalog.edges.count()


def test_project_errors_and_outcomes(spark):
    rows = [("lost", None, None, "no access"), ("lost", "A.java", "x", None), ("blank", "A.java", None, None), ("blank", "README", "x", None), ("fine", "A.java", None, None), ("fine", "B.java", "x", None), ("none", "README", "x", None)]
    errors = sync.project_errors(spark.createDataFrame(rows, "project_id string, path string, content string, error string"))
    assert {tuple(r) for r in errors.collect()} == {("lost", "no access"), ("blank", "no source file could be read")}
    assert sync.project_errors(spark.createDataFrame([("a", None, None)], "project_id string, path string, content string")).first().error == "the project could not be read"
