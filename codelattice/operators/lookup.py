"""Lookups of projects, classes, methods and parameters, for one key or a table of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.columns import is_endpoint
from codelattice.schema import Catalog
from codelattice.storage import stored


def has_endpoint() -> Column:
    return is_endpoint(F.col("http_method"), F.col("http_path"))


def method_order() -> list[Column]:
    """By line, methods without one last, then by name; ids make it a total order."""
    return [F.asc_nulls_last("line_number"), F.asc("method_name"), F.asc("id")]


def project(catalog: Catalog, **key: str) -> DataFrame:
    """The project with this id, name or repository_url."""
    ((column, value),) = key.items()
    return catalog.projects.filter(F.col(column) == value)


def project_exists(catalog: Catalog, repository_url: str) -> bool:
    return not project(catalog, repository_url=repository_url).limit(1).isEmpty()


def all_projects(catalog: Catalog) -> DataFrame:
    """Latest first."""
    return catalog.projects.orderBy(F.desc("created_at"), "id")


def projects_in(catalog: Catalog, *statuses: str) -> DataFrame:
    return catalog.projects.filter(F.col("status").isin(*statuses))


def projects_with_graph(catalog: Catalog) -> DataFrame:
    """Projects that have a node."""
    owners = catalog.classes.select(F.col("project_id").alias("_owner"))
    return catalog.projects.join(owners, F.col("id") == F.col("_owner"), "left_semi")


def classes_of(catalog: Catalog, project_id: str) -> DataFrame:
    return catalog.classes.filter(F.col("project_id") == project_id).orderBy("full_class_name")


def classes_by_id(catalog: Catalog, ids: DataFrame) -> DataFrame:
    """The classes ``ids`` (class_id)."""
    return catalog.classes.join(ids.select(F.col("class_id").alias("id")).distinct(), "id", "left_semi").select(catalog.classes.columns)


def classes_in_projects(catalog: Catalog, keys: DataFrame) -> DataFrame:
    """The classes of ``keys`` (project_id, full_class_name), of which a project has one each."""
    return catalog.classes.join(keys.select("project_id", "full_class_name").distinct(), ["project_id", "full_class_name"], "left_semi").select(catalog.classes.columns)


def has_metadata(catalog: Catalog) -> DataFrame:
    """(project_id, full_class_name, has_metadata): whether a type, a description or a method is known of each node."""
    owners = catalog.methods.select(F.col("class_id").alias("id")).distinct().withColumn("_methods", F.lit(True))
    known = F.col("class_type").isNotNull() | F.col("description").isNotNull() | F.coalesce("_methods", F.lit(False))
    return catalog.classes.join(owners, "id", "left").select("project_id", "full_class_name", known.alias("has_metadata"))


def classes_by_name(catalog: Catalog, names: DataFrame) -> DataFrame:
    """One row for each distinct ``class_name`` that is known: that of the first project by name.

    Names are unique within a project only; ``ambiguous`` says that others have it too.
    """
    wanted = names.select(F.col("class_name").alias("full_class_name")).distinct()
    found = catalog.classes.join(wanted, "full_class_name").join(catalog.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id", "left")
    by_name = Window.partitionBy("full_class_name")
    ranked = found.withColumn("rank", F.row_number().over(by_name.orderBy(F.asc_nulls_last("project"), "id"))).withColumn("ambiguous", F.count("*").over(by_name) > 1)
    return ranked.filter("rank = 1").drop("rank")


def classes_in_packages(catalog: Catalog, prefixes: DataFrame) -> DataFrame:
    """(prefix, class columns) for each ``prefix`` that is a class's package or one above it.

    A package begins with a prefix of so many segments if its first segments
    are equal to it, so the test is a join by equality. Of a class only the
    lengths that prefixes have are tried, mostly one; they are as few as the
    segments of the longest. Files whose packages are all before the first
    prefix or behind the last are not read.
    """
    segments = lambda c: F.size(F.split(c, "[.]"))
    asked = prefixes.select("prefix").distinct().filter(F.col("prefix").isNotNull())
    lengths, first, last = prefixes.agg(F.sort_array(F.collect_set(segments(F.col("prefix")))), F.min("prefix"), F.max("prefix")).first()
    if not lengths:
        return catalog.classes.limit(0).join(asked, F.lit(False)).select(*catalog.classes.columns, "prefix")
    package = F.col("package_name")
    begins = F.array(*(F.when(segments(package) >= n, F.substring_index(package, ".", n)) for n in lengths))
    near = catalog.classes.filter((package >= first) & (package <= last + "\U0010ffff"))
    each = near.withColumn("prefix", begins[0] if len(lengths) == 1 else F.explode(begins))
    return each.join(asked, "prefix")


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text of three or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda at: F.substr(text, at, F.lit(3))))


def names_that_hold(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project, wanted, id) of the ``nodes`` (project, id, full_class_name) whose name holds ``wanted`` in any case.

    A wanted text meets the names by the rarest in its project of its runs of
    three characters, a join by equality. Only texts of less than three
    characters are compared with every name of their project.
    """
    low, asked = F.lower("full_class_name"), wanted.select("project", "wanted").distinct()
    each = nodes.filter(F.char_length("full_class_name") >= 3).select("project", "id", low.alias("_name"), F.explode(_grams(low)).alias("_gram"))
    counts = each.groupBy("project", "_gram").agg(F.count("*").alias("_n"))
    parts = asked.filter(F.char_length("wanted") >= 3).select("project", "wanted", F.explode(_grams(F.lower("wanted"))).alias("_gram"))
    rarest = parts.join(counts, ["project", "_gram"], "left").groupBy("project", "wanted").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    # A row for each text asked for: its size known, few of them meet the names where these are, without a shuffle of all runs.
    found = stored(rarest).join(each, ["project", "_gram"]).filter(F.contains("_name", F.lower("wanted"))).select("project", "wanted", "id")
    short = nodes.join(asked.filter(F.char_length("wanted") < 3), "project").filter(F.contains(low, F.lower("wanted"))).select("project", "wanted", "id")
    return found.union(short)


def class_counts(catalog: Catalog) -> DataFrame:
    return catalog.classes.groupBy("project_id").agg(F.count("*").alias("class_count"))


def unenriched(catalog: Catalog) -> DataFrame:
    return catalog.classes.filter(F.col("description").isNull())


def methods_with_class(catalog: Catalog) -> DataFrame:
    """Methods with the project and name of their class."""
    owner = catalog.classes.select(F.col("id").alias("class_id"), "project_id", "full_class_name", "class_type")
    return catalog.methods.join(owner, "class_id")


def endpoints(catalog: Catalog) -> DataFrame:
    """Methods with an HTTP method and path, of all projects; filter by project_id for one."""
    return methods_with_class(Catalog(catalog.projects, catalog.classes, catalog.methods.filter(has_endpoint()), catalog.params, catalog.edges))


def ordered_endpoints(catalog: Catalog, project_id: str) -> DataFrame:
    return endpoints(catalog).filter(F.col("project_id") == project_id).orderBy("http_path", "http_method")


def endpoint_counts(catalog: Catalog) -> DataFrame:
    return endpoints(catalog).groupBy("project_id").agg(F.count("*").alias("endpoint_count"))


def ranked_methods(catalog: Catalog) -> DataFrame:
    """Methods with ``rank``, their place in their class."""
    return catalog.methods.withColumn("rank", F.row_number().over(Window.partitionBy("class_id").orderBy(*method_order())))


def methods_named(catalog: Catalog) -> DataFrame:
    """The first method of each class and name, with the number of overloads."""
    of = Window.partitionBy("class_id", "method_name")
    ranked = catalog.methods.withColumn("rank", F.row_number().over(of.orderBy(F.asc_nulls_last("line_number"), "id"))).withColumn("overloads", F.count("*").over(of))
    return ranked.filter("rank = 1").drop("rank")


def parameters(catalog: Catalog) -> DataFrame:
    """Parameters with the name and type of their class."""
    target = catalog.classes.select(F.col("id").alias("class_id"), F.col("full_class_name").alias("type_name"), "class_type", F.col("description").alias("type_description"))
    return catalog.params.join(target, "class_id", "left")
