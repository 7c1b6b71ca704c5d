"""Incremental synchronisation: what changed between two states of the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths of source files.
SOURCES = r"[.](java|ts|tsx|js|jsx|go)$"


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, path, change) of two listings (project_id, path, digest): added, modified, deleted or same.

    A renamed file is one deleted and one added.
    """
    a = old.select("project_id", "path", F.col("digest").alias("old_digest"))
    b = new.select("project_id", "path", F.col("digest").alias("new_digest"))
    kind = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "deleted").when(F.col("old_digest") != F.col("new_digest"), "modified").otherwise("same")
    return a.join(b, ["project_id", "path"], "full_outer").select("project_id", "path", kind.alias("change"))


def listing(files: DataFrame) -> DataFrame:
    """(project_id, path, digest) of files with content."""
    return files.select("project_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


def classify(old: DataFrame, new: DataFrame, changed: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """(project_id, full_class_name, action): delete, add, update or keep.

    ``old`` and ``new`` have (project_id, full_class_name, source_file),
    ``changed`` the changed (project_id, source_file). A class in both is
    updated if its file changed or its project is in ``full`` (project_id).
    """
    a = old.select("project_id", "full_class_name", F.lit(True).alias("was"))
    b = new.select("project_id", "full_class_name", "source_file", F.lit(True).alias("now"))
    hit = changed.select("project_id", "source_file").distinct().withColumn("touched", F.lit(True))
    both = a.join(b, ["project_id", "full_class_name"], "full_outer").join(hit, ["project_id", "source_file"], "left")
    whole = F.lit(False)
    if full is not None:
        both = both.join(full.select("project_id").distinct().withColumn("whole", F.lit(True)), "project_id", "left")
        whole = F.coalesce("whole", F.lit(False))
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull(), "add").when(whole | F.coalesce("touched", F.lit(False)), "update").otherwise("keep")
    return both.select("project_id", "full_class_name", action.alias("action"))


def counters(projects: DataFrame, actions: DataFrame) -> DataFrame:
    """Of each project: added, updated, deleted and unchanged classes."""
    of = lambda action, name: F.count_if(F.col("action") == action).alias(name)
    sums = actions.groupBy("project_id").agg(of("add", "addedClasses"), of("update", "updatedClasses"), of("delete", "deletedClasses"), of("keep", "unchangedClasses"))
    joined = projects.select(F.col("id").alias("project_id"), F.col("name").alias("projectName")).join(sums, "project_id", "left")
    return joined.na.fill(0, ["addedClasses", "updatedClasses", "deletedClasses", "unchangedClasses"])


def merged(old: DataFrame, new: DataFrame, actions: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """The classes after synchronisation.

    Added classes come from ``new``, deleted ones go, kept ones stay. Updated
    ones take the new row but keep their old id and description. Where
    ``parsed`` (project_id, source_file, ok) says that a file could not be
    read, its classes keep their old rows.
    """
    columns = new.columns
    before = old.select("project_id", "full_class_name", F.struct(*[c for c in columns if c in old.columns]).alias("o"))
    after = new.select("project_id", "full_class_name", F.struct(*columns).alias("n"))
    rows = actions.filter("action != 'delete'").join(before, ["project_id", "full_class_name"], "left").join(after, ["project_id", "full_class_name"], "left")
    fine = F.lit(True)
    if parsed is not None:
        state = parsed.select("project_id", F.col("source_file").alias("_file"), "ok")
        rows = rows.withColumn("_file", F.col("n.source_file")).join(state, ["project_id", "_file"], "left")
        fine = F.coalesce("ok", F.lit(True))
    take_new = (F.col("action") == "add") | ((F.col("action") == "update") & fine)

    def value(column: str):
        if column not in old.columns:
            return F.col(f"n.{column}")
        if column in ("id", "description"):
            return F.coalesce(F.col(f"o.{column}"), F.col(f"n.{column}"))
        return F.when(take_new, F.col(f"n.{column}")).otherwise(F.col(f"o.{column}"))

    return rows.select([value(c).alias(c) for c in columns])


def merged_methods(old: DataFrame, new: DataFrame, actions: DataFrame) -> DataFrame:
    """Methods after synchronisation: new ones of added and updated classes, old ones of kept ones.

    Both have (project_id, full_class_name). Updated methods have no
    description or logic until they are enriched again.
    """
    keep = actions.filter("action = 'keep'").select("project_id", "full_class_name")
    take = actions.filter("action in ('add', 'update')").select("project_id", "full_class_name")
    blank = new.withColumns({c: F.lit(None).cast(new.schema[c].dataType) for c in ("description", "business_logic") if c in new.columns})
    return old.join(keep, ["project_id", "full_class_name"], "left_semi").unionByName(blank.join(take, ["project_id", "full_class_name"], "left_semi"), allowMissingColumns=True)


def project_errors(files: DataFrame) -> DataFrame:
    """(project_id, error) of the projects that can't be synchronised from ``files`` (project_id, path, content, maybe error).

    A row without a path says that its project could not be listed, and why. A
    project whose source files all hold no text is not read either.
    """
    why = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    listed = files.groupBy("project_id").agg(
        F.max(F.col("path").isNull()).alias("lost"),
        F.min(F.when(F.col("path").isNull(), why)).alias("why"),
        F.count_if(F.regexp_like("path", F.lit(SOURCES))).alias("sources"),
        F.count_if(F.regexp_like("path", F.lit(SOURCES)) & F.col("content").isNotNull()).alias("texts"),
    )
    error = F.when(F.col("lost"), F.coalesce("why", F.lit("the project could not be read"))).when((F.col("sources") > 0) & (F.col("texts") == 0), "no source file could be read")
    return listed.select("project_id", error.alias("error")).filter("error is not null")


def outcomes(projects: DataFrame, actions: DataFrame, errors: DataFrame) -> DataFrame:
    """Of each project of ``projects``: projectName, success, error, the status that it comes to, and its counters.

    What fails in one project says nothing of the others.
    """
    first = errors.groupBy("project_id").agg(F.min("error").alias("error"))
    counted = counters(projects, actions.join(first, "project_id", "left_anti")).join(first, "project_id", "left")
    failed = F.col("error").isNotNull()
    return counted.select("project_id", "projectName", (~failed).alias("success"), "error", F.when(failed, "ERROR").otherwise("ANALYZED").alias("status"), "addedClasses", "updatedClasses", "deletedClasses", "unchangedClasses")
