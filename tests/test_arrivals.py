from pyspark.sql import functions as F

from codelattice import api
from codelattice.streaming import arrivals
from tests import test_ingest

FILES = "project_id string, path string, content string"


def changes(found):
    return {(r.project_id, r.path, r.arrival): r.change for r in found.collect()}


def test_each_run_reads_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "inbox")
    make = lambda *rows: spark.createDataFrame(rows, FILES)
    arrivals.arrive(make(("p", "a", "1"), ("p", "b", "1"), ("q", "a", "1"), ("p", None, "x"), (None, "a", "x")), folder, 1)
    found, read = arrivals.read_arrivals(spark, folder)
    assert changes(found) == {("p", "a", 1): "added", ("p", "b", 1): "added", ("q", "a", 1): "added"} and read == 5
    arrivals.arrive(make(("p", "a", "2")), folder, 2)
    found, read = arrivals.read_arrivals(spark, folder)
    assert changes(found) == {("p", "a", 2): "modified"} and read == 1
    arrivals.arrive(make(("p", "b", None), ("q", "a", "1")), folder, 3)
    arrivals.arrive(make(("p", "b", ""), ("p", "b", "")), folder, 4)
    found, read = arrivals.read_arrivals(spark, folder)
    assert sorted((r.path, r.arrival, r.change) for r in found.collect()) == [("a", 3, "same"), ("b", 3, "deleted"), ("b", 4, "added"), ("b", 4, "same")] and read == 4
    found, read = arrivals.read_arrivals(spark, folder)
    assert found.isEmpty() and read == 0
    assert {(r.project_id, r.path, r.content) for r in arrivals.files_after(arrivals.all_changes(spark, folder)).collect()} == {("p", "a", "2"), ("p", "b", ""), ("q", "a", "1")}


def test_a_service_follows_a_folder(spark, tmp_path):
    rows = [("p1", path, text) for path, text in test_ingest.JAVA.items()]
    projects = spark.createDataFrame([("p1", "java", "u", "main", "ANALYZED"), ("p2", "other", "v", "main", "ANALYZED")], "id string, name string, repository_url string, default_branch string, status string").withColumns({"description": F.lit(None).cast("string"), "created_at": F.current_timestamp()})
    service, folder = api.create(spark, str(tmp_path / "catalog"), projects), str(tmp_path / "inbox")
    arrivals.arrive(spark.createDataFrame(rows, FILES), folder, 1)
    assert {r.action for r in service.follow(folder).collect()} == {"add"}
    before = {r.full_class_name for r in service.catalog.classes.collect()}
    arrivals.arrive(spark.createDataFrame([("p1", "src/main/java/org/shop/Jobs.java", None), ("p1", "src/main/java/org/shop/Plain.java", "package org.shop;\nclass Plain { void fresh() {} }\n")], FILES), folder, 2)
    actions = {r.full_class_name: r.action for r in service.follow(folder).collect()}
    assert {k: v for k, v in actions.items() if v != "keep"} == {"org.shop.Jobs": "delete", "org.shop.Plain": "update"}
    assert {r.full_class_name for r in service.catalog.classes.collect()} == before - {"org.shop.Jobs"}
    assert service.follow(folder).isEmpty()
