"""Versions of a catalog on disk, and changes of its tables as new versions.

Tables that belong to projects are folders by project. A version holds those
projects that were written with it, and its mark names for each table the
versions that hold the others, so a project is replaced by writing its rows only.
"""

from __future__ import annotations

import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from codelattice.schema import Catalog, DomainError, check_transition

TABLES = ("projects", "classes", "methods", "params", "edges")
OWNED = TABLES[1:]
#: A table that so many versions hold is written anew, whole, by the next that changes some projects.
MOST_PARTS = 16


def _root(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, folder: str) -> str:
    """Name of the newest whole version: the last that has its mark."""
    path, system = _root(spark, folder)
    if not system.exists(path):
        raise FileNotFoundError(folder)
    names = sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory())
    marked = [n for n in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(path, f"{n}/whole.txt"))]
    if not marked:
        raise FileNotFoundError(f"{folder}: no version")
    return marked[-1]


def manifest(spark: SparkSession, folder: str, version: str | None = None) -> dict[str, dict]:
    """Of each table its ``schema`` and its ``parts``, [version, project ids] from the first; the first holds all other projects."""
    version = version or current_version(spark, folder)
    (row,) = spark.read.text(f"{folder}/{version}/whole.txt", wholetext=True).collect()
    return json.loads(row.value)


def _named(spark: SparkSession, project_id: str) -> str:
    return f"project_id={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project_id)}"


def read_table(spark: SparkSession, folder: str, name: str, of: dict, projects: list[str] | None = None) -> DataFrame:
    """A table as its part of a manifest says; of ``projects`` only their files are listed and read."""
    schema = StructType.fromJson(of["schema"])
    if name not in OWNED:
        return spark.read.schema(schema).parquet(f"{folder}/{of['parts'][0][0]}/{name}")
    stored = schema if "project_id" in schema.names else StructType([*schema.fields, StructField("project_id", StringType())])
    _, system = _root(spark, folder)
    frames, later = [], set()
    for version, ids in reversed(of["parts"]):
        at = f"{folder}/{version}/{name}"
        mine = None if ids is None else [i for i in ids if i not in later]
        held = F.lit(True) if mine is None and not later else ~F.coalesce(F.col("project_id").isin(*later), F.lit(False)) if mine is None else F.col("project_id").isin(*mine)
        if projects is None:
            frames.append(spark.read.schema(stored).parquet(at).filter(held))
        else:
            wanted = [i for i in projects if i not in later and (mine is None or i in mine)]
            found = [path for path in (f"{at}/{_named(spark, i)}" for i in wanted) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(path))]
            if found:
                frames.append(spark.read.schema(stored).option("basePath", at).parquet(*found))
        later |= set(ids or ())
    whole = reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], stored)
    return whole.select(schema.names)


def _with_owners(catalog: Catalog) -> dict[str, DataFrame]:
    """The owned tables with the project of each row; null where a method's class, or a parameter's method, is not there."""
    of_class = catalog.classes.select(F.col("id").alias("class_id"), "project_id").dropDuplicates(["class_id"])
    methods = catalog.methods.join(of_class, "class_id", "left").select(*catalog.methods.columns, "project_id")
    of_method = methods.select(F.col("id").alias("method_id"), "project_id").dropDuplicates(["method_id"])
    params = catalog.params.join(of_method, "method_id", "left").select(*catalog.params.columns, "project_id")
    return {"classes": catalog.classes, "methods": methods, "params": params, "edges": catalog.edges}


def publish(catalog: Catalog, folder: str, changed: tuple[str, ...] = TABLES, projects: DataFrame | None = None) -> str:
    """Writes the ``changed`` tables of a version beside those before it and marks it whole at the end.

    With ``projects`` (project_id) the version holds the rows of these only, and
    a project without rows is one that went; ``catalog`` need not have the rows
    of others. What did not change is not written again. Readers see the new
    version once it has its mark; what a plan is reading is never overwritten.
    A project's rows are split over as many files as their size asks for, and
    classes are sorted by name within files, so their row groups can be skipped.
    """
    spark = catalog.projects.sparkSession
    path, system = _root(spark, folder)
    number = len(system.listStatus(path)) if system.exists(path) else 0
    version = f"v{number:06d}"
    of = {} if set(changed) == set(TABLES) and projects is None else manifest(spark, folder)
    ids = None if projects is None else sorted(r.project_id for r in projects.select("project_id").distinct().collect())
    owned = _with_owners(catalog) if set(changed) & set(OWNED) else {}
    for name in changed:
        table = getattr(catalog, name)
        schema = json.loads(table.schema.json())
        if name not in OWNED:
            table.write.mode("errorifexists").parquet(f"{folder}/{version}/{name}")
            of[name] = {"schema": schema, "parts": [[version, None]]}
            continue
        table, parts = owned[name], [[version, None]]
        if ids is not None:
            table = table.join(projects.select("project_id").distinct(), "project_id", "left_semi").select(table.columns)
            before = of[name]
            if len(before["parts"]) < MOST_PARTS:
                # What a part held of these projects isn't named any more.
                kept = [[v, held if held is None else [i for i in held if i not in set(ids)]] for v, held in before["parts"]]
                parts = [[v, held] for v, held in kept if held is None or held] + [[version, ids]]
            else:
                rest = read_table(spark, folder, name, before | {"schema": json.loads(table.schema.json())})
                rest = rest.join(projects.select("project_id").distinct(), "project_id", "left_anti")
                table = table.unionByName(rest.select(table.columns))
        dealt = table.hint("rebalance", "project_id")
        ordered = dealt.sortWithinPartitions("project_id", *(["full_class_name"] if name == "classes" else []))
        ordered.write.mode("errorifexists").partitionBy("project_id").parquet(f"{folder}/{version}/{name}")
        of[name] = {"schema": schema, "parts": parts}
    mark = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{version}", "whole.txt"))
    mark.write(json.dumps({name: of[name] for name in TABLES}).encode())
    mark.close()
    return version


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` and ``rows``; missing columns are null, none is added."""
    return table.unionByName(rows.select([c for c in rows.columns if c in table.columns]), allowMissingColumns=True)


def update(table: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the columns of ``updates`` where the key matches; its nulls leave values as they are."""
    columns = [c for c in updates.columns if c != key and c in table.columns]
    new = updates.select(key, F.struct(*columns).alias("_new"))
    joined = table.join(new, key, "left")
    return joined.select([F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti").select(table.columns)


def cascade(catalog: Catalog) -> Catalog:
    """Only rows whose owners are left: classes of projects, methods of classes, parameters of both, edges between classes."""
    key = lambda frame, column, name: frame.select(F.col(column).alias(name))
    classes = catalog.classes.join(key(catalog.projects, "id", "project_id"), "project_id", "left_semi").select(catalog.classes.columns)
    methods = catalog.methods.join(key(classes, "id", "class_id"), "class_id", "left_semi").select(catalog.methods.columns)
    params = catalog.params.join(key(methods, "id", "method_id"), "method_id", "left_semi").join(key(classes, "id", "class_id"), "class_id", "left_semi").select(catalog.params.columns)
    at = lambda end: classes.select("project_id", F.col("full_class_name").alias(end))
    edges = catalog.edges.join(at("src"), ["project_id", "src"], "left_semi").join(at("dst"), ["project_id", "dst"], "left_semi").select(catalog.edges.columns)
    return replace(catalog, classes=classes, methods=methods, params=params, edges=edges, bundles=None)


def delete_classes(catalog: Catalog, ids: DataFrame) -> Catalog:
    return cascade(replace(catalog, classes=delete(catalog.classes, ids, "id")))


def delete_projects(catalog: Catalog, ids: DataFrame) -> Catalog:
    return cascade(replace(catalog, projects=delete(catalog.projects, ids, "id")))


def delete_parameters_of(catalog: Catalog, owners: DataFrame) -> Catalog:
    """Without the parameters of all methods of the classes ``owners`` (class_id)."""
    methods = catalog.methods.join(owners.select("class_id").distinct(), "class_id", "left_semi").select(F.col("id").alias("method_id"))
    return replace(catalog, params=delete(catalog.params, methods, "method_id"))


def delete_parameters_of_methods(catalog: Catalog, methods: DataFrame) -> Catalog:
    """Without the parameters of ``methods`` (method_id)."""
    return replace(catalog, params=delete(catalog.params, methods, "method_id"))


def set_commit(catalog: Catalog, ids: DataFrame, commit: str) -> Catalog:
    """The classes ``ids`` (id) marked with the commit that they were read from."""
    marked = ids.select("id").distinct().withColumn("commit_hash", F.lit(commit))
    has = "commit_hash" in catalog.classes.columns
    classes = catalog.classes if has else catalog.classes.withColumn("commit_hash", F.lit(None).cast("string"))
    return replace(catalog, classes=update(classes, marked))


def delete_parameters_to(catalog: Catalog, targets: DataFrame) -> Catalog:
    return replace(catalog, params=delete(catalog.params, targets, "class_id"))


def set_status(catalog: Catalog, project_id: str, status: str) -> Catalog:
    """The catalog with a project in another state, if it may go there."""
    return set_statuses(catalog, catalog.projects.filter(F.col("id") == project_id).select(F.col("id").alias("project_id")), status, project_id)


def set_statuses(catalog: Catalog, ids: DataFrame, status: str, about: str = "of these") -> Catalog:
    """The same for the projects ``ids`` (project_id), of which each may go there or none does."""
    found = catalog.projects.join(ids.select(F.col("project_id").alias("id")).distinct(), "id", "left_semi").groupBy("status").count().collect()
    if not found:
        raise DomainError(f"no project {about}", "PROJECT_NOT_FOUND")
    for row in found:
        check_transition(row.status, status)
    marked = ids.select(F.col("project_id").alias("id")).distinct().withColumn("status", F.lit(status))
    return replace(catalog, projects=update(catalog.projects, marked))
