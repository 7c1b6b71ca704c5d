import json

import pytest
from pyspark.sql import functions as F

from codelattice import api
from codelattice.operators import analyze, snapshots
from codelattice.schema import DomainError
from tests import test_ingest

PROJECT = "id string, name string, repository_url string, default_branch string, description string, status string, created_at timestamp"


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(p, path, len(text), text) for p, tree in (("p1", test_ingest.JAVA), ("p2", {**test_ingest.SCRIPTS, "package.json": '{"dependencies":{"@nestjs/core":"1"}}'}), ("p3", test_ingest.GO)) for path, text in tree.items()]
    return spark.createDataFrame(rows, "project_id string, path string, length long, content string")


@pytest.fixture(scope="module")
def service(spark, sources, tmp_path_factory):
    projects = spark.createDataFrame([(f"p{i}", n, f"https://git.example.org/x/{n}.git", "main", None, "ANALYZED", None) for i, n in enumerate(("java", "script", "golang"), 1)], PROJECT)
    return api.create(spark, str(tmp_path_factory.mktemp("service") / "catalog"), projects, sources)


def answer(service, text):
    return json.loads(service.query_json(text))


def test_queries_over_three_languages(service):
    found = answer(service, "java:endpoints")
    assert found["count"] == 3 and {r["httpPath"] for r in found["results"]} == {"/orders/{id}", "/orders", "/plain"}
    assert [r["httpPath"] for r in answer(service, "script:endpoints")["results"]] == [":id"]
    assert answer(service, "golang:endpoints")["count"] == 0  # handlers have no path
    assert answer(service, "golang:entrypoints")["count"] == 2
    assert {r["className"] for r in answer(service, "java:OrderController:dependencies")["results"]} == {"org.shop.OrderService", "org.shop.util.Money", "org.shop.db.OrderDto"}
    assert answer(service, "none:endpoints")["error"] == "PROJECT_NOT_FOUND"
    method = service.method_context(("org.shop.web.OrderController", "save")).first()
    assert method.found and [p.typeName for p in method.parameterTypes] == ["org.shop.db.OrderDto", "org.shop.web.Neighbour"]
    assert service.class_context("org.shop.Plain").first().found


def test_changes_are_versions(spark, service, sources):
    changed = sources.filter("path not like '%Neighbour%'").withColumn("content", F.when(F.col("path").endswith("OrderService.java"), F.regexp_replace("content", "all", "every")).otherwise(F.col("content")))
    actions = {(r.project_id, r.full_class_name): r.action for r in service.synchronise(sources, changed).collect()}
    assert actions["p1", "org.shop.web.Neighbour"] == "delete" and actions["p1", "org.shop.OrderService"] == "update"
    assert sum(a == "keep" for a in actions.values()) == len(actions) - 2
    assert {r["methodName"] for r in answer(service, "java:OrderService:methods")["results"]} == {"every"}
    assert answer(service, "java:Neighbour")["error"] == "CLASS_NOT_FOUND"
    service.register("https://git.example.org/x/new.git", "dev")
    with pytest.raises(DomainError):
        service.register("https://git.example.org/x/new.git")
    with pytest.raises(ValueError):
        service.register("no url")
    assert {r.name for r in service.projects().collect()} == {"java", "script", "golang", "new"}
    assert service.project(name="new").first().status == "PENDING"
    service.set_status("p1", "SYNCING")
    service.delete("p2")
    assert {(r.name, r.status) for r in service.catalog.projects.collect()} == {("java", "SYNCING"), ("golang", "ANALYZED"), ("new", "PENDING")}
    assert service.catalog.classes.filter("project_id = 'p2'").isEmpty()


def test_one_row_a_class(spark):
    rows = [
        ("m", "m1/src/main/java/org/shop/A.java", "package org.shop;\n@Service class A { void one() {} void both() {} }\n"),
        ("m", "m2/src/main/java/org/shop/A.java", "package org.shop;\nclass A { void both() {} void both(int x) {} }\n"),
        ("m", "m2/src/main/java/org/shop/B.java", "package org.shop;\n@Controller class B { void take(A a) {} }\n"),
        ("n", "package.json", "{}"),
        ("n", "src/a.js", "export function old() { }\n"),
        ("n", "src/a.ts", "export function fresh() { }\n"),
    ]
    files = spark.createDataFrame([(p, path, len(text), text) for p, path, text in rows], "project_id string, path string, length long, content string")
    projects = spark.createDataFrame([("m", "m", None, "main", None, "ANALYZED", None), ("n", "n", None, "main", None, "ANALYZED", None)], PROJECT)
    catalog = analyze.analyze(projects, files)
    assert sorted((r.full_class_name, r.source_file, r.class_type, r.ordinal) for r in catalog.classes.collect()) == [
        ("a", "src/a.ts", "OTHER", 0),
        ("org.shop.A", "m2/src/main/java/org/shop/A.java", "OTHER", 0),
        ("org.shop.B", "m2/src/main/java/org/shop/B.java", "CONTROLLER", 1),
    ]
    owners = {r.id: r.full_class_name for r in catalog.classes.collect()}
    assert sorted((owners[r.class_id], r.method_name) for r in catalog.methods.collect()) == [("a", "fresh"), ("org.shop.A", "both"), ("org.shop.A", "both"), ("org.shop.B", "take")]
    assert [owners[r.class_id] for r in catalog.params.collect()] == ["org.shop.A"]


def test_sync_of_one_project_and_of_what_cannot_be_read(spark, sources, tmp_path):
    projects = spark.createDataFrame([(f"p{i}", n, f"https://git.example.org/x/{n}.git", "main", None, "ANALYZED", None) for i, n in enumerate(("java", "script", "golang"), 1)], PROJECT)
    service = api.create(spark, str(tmp_path / "catalog"), projects, sources)
    methods = lambda name: {r.method_name for r in service.catalog.methods.join(service.catalog.classes.filter(F.col("full_class_name") == name).select(F.col("id").alias("class_id")), "class_id").collect()}
    before = service.catalog.methods.count(), service.catalog.params.count(), service.catalog.edges.count()
    assert {r.action for r in service.synchronise(sources, sources).collect()} == {"keep"}
    assert snapshots.current_version(spark, service.folder) == "v000000"
    broken = sources.withColumn("content", F.when(F.col("path").endswith("OrderService.java"), "package org.shop;\nclass OrderService { void lost( {").otherwise(F.col("content")))
    actions = {(r.project_id, r.full_class_name): r.action for r in service.synchronise(sources, broken).collect()}
    assert set(actions.values()) == {"keep"} and methods("org.shop.OrderService") == {"all"}
    full = spark.createDataFrame([("p1",)], "project_id string")
    catalog, actions = analyze.synchronise(service.catalog, sources, sources, full)
    assert {(r.project_id, r.action) for r in actions.collect()} == {("p1", "update"), ("p2", "keep"), ("p3", "keep")}
    assert (catalog.methods.count(), catalog.params.count(), catalog.edges.count()) == before


def test_answers_of_the_service(service, sources, spark, tmp_path):
    projects = spark.createDataFrame([("p1", "java", "https://git.example.org/x/java.git", "main", None, "PENDING", None)], PROJECT)
    own = api.create(spark, str(tmp_path / "own"), projects)
    client = lambda asked: ['{"description": "Says", "classType": "utility", "methods": {"all": {"description": "Lists", "businessLogic": ["a"]}}}' for _ in asked]
    mine = sources.filter("project_id = 'p1'")
    own.analyze(mine, client)
    assert own.project(id="p1").first().status == "ANALYZED"
    assert {r.class_type for r in own.catalog.classes.collect()} == {"UTILITY"} and own.catalog.methods.filter("description = 'Lists'").count() == 3
    own.rebuild(mine)
    assert {r.description for r in own.catalog.classes.collect()} == {"Says"} and own.catalog.methods.filter("description = 'Lists'").count() == 3
    found = {r.query: r for r in own.search(("java", "ORDERSERVICE"), ("java", "zzz"), ("none", "x")).collect()}
    assert [m.className for m in found["ORDERSERVICE"].matches] == ["org.shop.OrderService"] and found["zzz"].matches == [] and found["zzz"].found
    assert not found["x"].found and found["x"].message and found["ORDERSERVICE"].totalClassesInProject == 8
    row = own.class_dependencies("org.shop.web.OrderController").first()
    assert {d.className for d in row.dependencies} == {"org.shop.OrderService", "org.shop.util.Money", "org.shop.db.OrderDto"}
    assert own.overview("java").first().totalClasses == 8
    assert [c.className for c in own.service_api("java").first().controllers] == ["org.shop.web.OrderController"]
    missing = own.class_context("org.none.X").first()
    assert not missing.found and [p.name for p in missing.knownProjects] == ["java"]
    assert own.class_context("org.shop.Plain").first().knownProjects is None
    assert [p.name for p in own.method_context(("org.none.X", "y")).first().knownProjects] == ["java"]
    with pytest.raises(DomainError) as error:
        own.analyze(sources.filter("project_id = 'p2'"))
    assert error.value.code == "PROJECT_NOT_FOUND"


def states(service):
    return {r.name: r.status for r in service.catalog.projects.collect()}


@pytest.fixture()
def four(spark, sources, tmp_path):
    projects = spark.createDataFrame([(f"p{i}", n, f"https://git.example.org/x/{n}.git", "main", None, "ANALYZED", None) for i, n in enumerate(("java", "script", "golang", "waiting"), 1)], PROJECT)
    return api.create(spark, str(tmp_path / "catalog"), projects.withColumn("status", F.when(F.col("id") == "p4", "PENDING").when(F.col("id") == "p3", "ERROR").otherwise(F.col("status"))), sources)


def test_a_broken_project_keeps_none_back(spark, sources, four, monkeypatch):
    """One project can't be listed, the plan of another fails, the third is synchronised."""
    edited = F.when(F.col("path").endswith("OrderService.java"), F.regexp_replace("content", "all", "every")).when(F.col("path") == "internal/store/store.go", F.lit("package store\n\nfunc Fresh() {\n}\n")).otherwise(F.col("content"))
    new = sources.filter("project_id <> 'p2'").withColumn("content", edited).withColumn("error", F.lit(None).cast("string"))
    new = new.unionByName(spark.createDataFrame([("p2", None, None, None, "no access")], "project_id string, path string, length long, content string, error string"))

    whole = api.Service._synchronised

    def failing(self, catalog, *rest):
        if not catalog.projects.filter("id = 'p3'").isEmpty():
            raise RuntimeError("no answer")
        return whole(self, catalog, *rest)

    monkeypatch.setattr(api.Service, "_synchronised", failing)
    out = {r.projectName: r for r in four.synchronise_all(sources, new).collect()}
    monkeypatch.undo()
    assert out.keys() == {"java", "script", "golang"}
    assert (out["java"].success, out["java"].updatedClasses) == (True, 1)
    assert (out["script"].success, out["script"].error) == (False, "no access")
    assert not out["golang"].success and "no answer" in out["golang"].error
    assert states(four) == {"java": "ANALYZED", "script": "ERROR", "golang": "ERROR", "waiting": "PENDING"}
    assert {r["methodName"] for r in answer(four, "java:OrderService:methods")["results"]} == {"every"}
    assert {r["methodName"] for r in answer(four, "golang:example.org/shop/internal/store:methods")["results"]} == {"Store.Get"}
    assert answer(four, "script:endpoints")["count"] == 1
    again = {r.projectName: (r.success, r.addedClasses, r.updatedClasses) for r in four.synchronise_all(sources, sources.withColumn("content", edited)).collect()}
    assert again["golang"] == (True, 0, 1) and again["script"] == (True, 0, 0)
    assert states(four) == {"java": "ANALYZED", "script": "ANALYZED", "golang": "ANALYZED", "waiting": "PENDING"}


def test_full_resync_and_pages(spark, sources, four):
    full = spark.createDataFrame([("p1",)], "project_id string")
    actions = four.synchronise(sources, sources, full=full)
    assert {r.action for r in actions.filter("project_id = 'p1'").collect()} == {"update"} and {r.action for r in actions.filter("project_id <> 'p1'").collect()} == {"keep"}
    parts = snapshots.manifest(spark, four.folder)["classes"]["parts"]
    assert parts[-1][1] == ["p1"]
    pages = four.query_pages("java:classes", 3).orderBy("page").collect()
    assert [len(p.results) for p in pages] == [3, 3, 2] and {p["count"] for p in pages} == {8}
    assert [r.className for p in pages for r in p.results] == sorted(r.className for p in pages for r in p.results)
