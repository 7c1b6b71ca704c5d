"""Context of projects, classes, methods and stack traces, each for many keys in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.columns import bare_method_name, http_endpoint, json_list
from codelattice.operators import bundles
from codelattice.operators.graph import base_packages, parameter_links, type_histogram
from codelattice.operators.lookup import has_endpoint, class_counts, classes_by_name, endpoint_counts, names_that_hold
from codelattice.schema import Catalog
from codelattice.storage import stored


def _line() -> Column:
    """Lines, with those of methods without one last."""
    return F.coalesce(F.col("line_number"), F.lit(2**31 - 1))


def list_projects(catalog: Catalog) -> DataFrame:
    """Projects, latest first, with their base package and counts, 0 where there is nothing to count."""
    projects = catalog.projects.withColumnRenamed("id", "project_id")
    joined = projects.join(class_counts(catalog), "project_id", "left").join(endpoint_counts(catalog), "project_id", "left").join(base_packages(catalog), "project_id", "left")
    return joined.na.fill(0, ["class_count", "endpoint_count"]).orderBy(F.desc("created_at"), "project_id")


def known_projects(catalog: Catalog) -> DataFrame:
    return list_projects(catalog).select("name", F.col("repository_url").alias("repositoryUrl"), F.col("base_package").alias("basePackage"))


def _with_known_projects(catalog: Catalog, rows: DataFrame, missing: Column) -> DataFrame:
    """``rows`` with ``knownProjects``, all projects in order, where ``missing`` holds; projects are few beside classes."""
    row = F.struct("name", "repositoryUrl", "basePackage")
    known = known_projects(catalog).agg(F.array_sort(F.collect_list(row)).alias("_known"))
    return rows.crossJoin(F.broadcast(known)).withColumn("knownProjects", F.when(missing, F.col("_known"))).drop("_known")


def search(catalog: Catalog, queries: DataFrame) -> DataFrame:
    """(project, query, class columns, total): nodes whose name holds the query in any case.

    ``queries`` has (project, query).
    """
    nodes = catalog.classes.join(catalog.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    totals = nodes.groupBy("project").agg(F.count("*").alias("total"))
    held = names_that_hold(nodes, queries.withColumnRenamed("query", "wanted")).withColumnRenamed("wanted", "query")
    found = nodes.join(held, ["project", "id"])
    return found.join(totals, "project").select("project", "query", F.col("full_class_name").alias("className"), F.col("class_type").alias("classType"), "description", F.col("entry_point").alias("entryPoint"), F.col("source_file").alias("sourceFile"), "ordinal", "total")


def search_results(catalog: Catalog, queries: DataFrame) -> DataFrame:
    """One row for each (project, query): found, projectName, query, matches in node order, totalClassesInProject and, if the project is unknown, a message."""
    match = F.struct("className", "classType", "description", "entryPoint", "sourceFile")
    rows = search(catalog, queries).groupBy("project", "query").agg(F.array_sort(F.collect_list(F.struct("ordinal", match.alias("m")))).alias("_m"))
    counts = catalog.classes.groupBy("project_id").agg(F.count("*").cast("int").alias("n"))
    projects = catalog.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"), F.lit(True).alias("known")).join(counts, "project_id", "left").drop("project_id")
    joined = queries.select("project", "query").distinct().join(projects, "project", "left").join(rows, ["project", "query"], "left")
    matches = F.transform("_m", lambda x: x["m"])
    none = F.from_json(F.lit("[]"), joined.select(matches.alias("m")).schema["m"].dataType)
    return joined.select(F.coalesce("known", F.lit(False)).alias("found"), F.col("project").alias("projectName"), "query", F.coalesce(matches, none).alias("matches"), F.coalesce("n", F.lit(0)).alias("totalClassesInProject"), F.when(F.col("known").isNull(), "Project not found").alias("message"))


def class_context(catalog: Catalog, names: DataFrame) -> DataFrame:
    """One row for each distinct ``class_name``: found, its methods in order, and its neighbours in the graph.

    graphInfo is null for classes that no edge table's project has as a node;
    unknown classes have found = false, a message and the known projects.
    """
    found = classes_by_name(catalog, names)
    method = F.struct(F.col("method_name").alias("name"), "description", json_list(F.col("business_logic")).alias("businessLogic"))
    listed = catalog.methods.groupBy(F.col("class_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(_line().alias("l"), F.col("method_name").alias("n"), F.col("id").alias("i"), method.alias("m")))).alias("_m"))
    urls = catalog.projects.select(F.col("id").alias("project_id"), F.col("repository_url").alias("projectUrl"), F.col("description").alias("projectDescription"))
    joined = found.join(listed, "id", "left").join(urls, "project_id", "left").withColumn("found", F.lit(True))
    asked = names.select(F.col("class_name").alias("full_class_name")).distinct()
    whole = asked.join(joined, "full_class_name", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    rows = bundles.listed(whole, bundles.of(catalog), src="dependencies", dst="dependents").select(
        F.col("full_class_name").alias("className"),
        F.col("class_type").alias("classType"),
        "description",
        "projectDescription",
        F.transform("_m", lambda x: x["m"]).alias("methods"),
        "projectUrl",
        F.when(F.col("found"), F.struct("dependencies", "dependents", F.col("entry_point").alias("entryPoint"))).alias("graphInfo"),
        "ambiguous",
        "found",
    )
    rows = rows.withColumn("message", F.when(~F.col("found"), F.lit("No context available for this class")))
    return _with_known_projects(catalog, rows, ~F.col("found"))


def _first_methods(catalog: Catalog) -> DataFrame:
    """The first method of each class and name, as a struct."""
    columns = ("id", "description", "business_logic", "exceptions", "http_method", "http_path", "line_number")
    row = F.struct(*columns)
    return catalog.methods.groupBy("class_id", "method_name").agg(F.min_by(row, F.struct(_line(), "id")).alias("m"))


def method_context(catalog: Catalog, pairs: DataFrame) -> DataFrame:
    """One row for each distinct (class_name, method_name), with one of three outcomes.

    ``found``; the class alone (message ``Class found but method not indexed``);
    or neither (``No context available for this method``). A method name may
    come with its parameters, which are cut off. The method is that of the
    class found, never of a namesake elsewhere.
    """
    asked = pairs.select("class_name", F.col("method_name").alias("asked")).distinct().withColumn("method_name", bare_method_name(F.col("asked")))
    known = classes_by_name(catalog, asked).select(F.col("full_class_name").alias("class_name"), F.col("id").alias("class_id"), "project_id", "source_file")
    methods = _first_methods(catalog)
    types = parameter_links(catalog).select(F.col("owner").alias("class_name"), "project_id", "method_name", F.struct("position", F.col("target").alias("typeName")).alias("p"))
    types = types.distinct().groupBy("project_id", "class_name", "method_name").agg(F.array_sort(F.collect_list("p")).alias("parameterTypes"))
    joined = asked.join(known, "class_name", "left").join(methods, ["class_id", "method_name"], "left").join(types, ["project_id", "class_name", "method_name"], "left")
    urls = catalog.projects.select(F.col("id").alias("project_id"), F.col("repository_url").alias("projectUrl"), F.col("description").alias("projectDescription"))
    message = F.when(F.col("class_id").isNull(), "No context available for this method").when(F.col("m").isNull(), "Class found but method not indexed")
    rows = joined.join(urls, "project_id", "left").select(
        F.col("class_name").alias("className"),
        F.col("asked").alias("methodName"),
        F.col("m").isNotNull().alias("found"),
        http_endpoint(F.col("m.http_method"), F.col("m.http_path")).alias("httpEndpoint"),
        F.col("m.description").alias("description"),
        "projectDescription",
        json_list(F.col("m.business_logic")).alias("businessLogic"),
        json_list(F.col("m.exceptions")).alias("exceptions"),
        F.col("source_file").alias("sourceFile"),
        F.col("m.line_number").alias("lineNumber"),
        "projectUrl",
        message.alias("message"),
        F.coalesce("parameterTypes", F.array().cast("array<struct<position:int,typeName:string>>")).alias("parameterTypes"),
    )
    return _with_known_projects(catalog, rows, F.col("message").startswith("No context"))


def trace_context(catalog: Catalog, frames: DataFrame) -> DataFrame:
    """Each frame with what is known of it: trace_id, ord, className, methodName, classType, description, httpEndpoint, found, missing.

    ``missing`` holds for frames whose method, or class too, is unknown; such
    a class alone keeps its type. The line number is echoed, never matched.
    All traces go through one plan. Class names and method names are hot keys
    (a few classes are in most traces), so both joins look up one row a key
    and leave large partitions for adaptive execution to split.
    """
    known = classes_by_name(catalog, frames).select(F.col("full_class_name").alias("class_name"), F.col("id").alias("class_id"), "project_id", "class_type")
    method = F.col("m")
    bare = frames.withColumn("_name", bare_method_name(F.col("method_name")))
    joined = bare.join(known, "class_name", "left").join(_first_methods(catalog).withColumnRenamed("method_name", "_name"), ["class_id", "_name"], "left")
    return joined.select(
        "trace_id",
        "ord",
        F.col("class_name").alias("className"),
        F.col("method_name").alias("methodName"),
        F.col("line_number").alias("lineNumber"),
        F.col("class_type").alias("classType"),
        method["description"].alias("description"),
        json_list(method["business_logic"]).alias("businessLogic"),
        http_endpoint(method["http_method"], method["http_path"]).alias("httpEndpoint"),
        method.isNotNull().alias("found"),
        method.isNull().alias("missing"),
        "project_id",
    )


def trace_projects(catalog: Catalog, traced: DataFrame) -> DataFrame:
    """(trace_id, projectUrl, projectDescription): of the first frame of each trace that was found."""
    first = traced.filter("found").groupBy("trace_id").agg(F.min_by("project_id", "ord").alias("project_id"))
    urls = catalog.projects.select(F.col("id").alias("project_id"), F.col("repository_url").alias("projectUrl"), F.col("description").alias("projectDescription"))
    return traced.select("trace_id").distinct().join(first, "trace_id", "left").join(urls, "project_id", "left").select("trace_id", "projectUrl", "projectDescription")


def related_dependencies(catalog: Catalog, traced: DataFrame, one_project: bool = False) -> DataFrame:
    """Methods of the classes next to those found in a trace, numbered within the trace.

    A neighbour that is in the trace itself is left out; one without methods
    gives one row with a null method. Each frame is looked up in its own
    project's graph; with ``one_project`` only the graph of the first frame
    found counts.
    """
    matched = traced.filter("project_id is not null").select("trace_id", "project_id", "className", "ord")
    if one_project:
        first = matched.groupBy("trace_id").agg(F.min_by("project_id", "ord").alias("_project"))
        matched = matched.join(first, "trace_id").withColumn("project_id", F.col("_project")).drop("_project")
    own = stored(matched.select("trace_id", "project_id", "className").distinct())
    held = bundles.of(catalog)
    methods = catalog.methods.select("class_id", F.col("id").alias("method_id"), F.col("method_name").alias("methodName"), "description", "line_number", http_endpoint(F.col("http_method"), F.col("http_path")).alias("httpEndpoint"))
    known = catalog.classes.select("project_id", F.col("full_class_name").alias("className"), F.col("class_type").alias("classType"), F.col("id").alias("class_id"))
    # A neighbour's methods in the order in which they are numbered.
    method = F.struct("className", F.col("line_number").isNull().alias("l"), "line_number", F.col("methodName").isNull().alias("n"), "methodName", "method_id", "project_id", "classType", "description", "httpEndpoint")
    said = known.join(methods, "class_id", "left").groupBy("project_id", F.col("className").alias("name")).agg(F.collect_list(method).alias("m"))
    # Of bundles a trace has the keys; the list of all bundles of a trace is made once for the traces that have just these.
    ends = [(held.sources, "src", "dst"), (held.targets, "dst", "src")]
    keys = [own.join(rows.withColumnRenamed(mine, "className"), ["project_id", "className"]).select("trace_id", F.struct("project_id", F.lit(other).alias("end"), "bundle").alias("key")) for rows, mine, other in ends]
    members = [rows.select(F.struct("project_id", F.lit(mine).alias("end"), "bundle").alias("key"), "project_id", F.col(mine).alias("name")) for rows, mine, _ in ends]
    single = [own.join(held.single.withColumnRenamed(mine, "className"), ["project_id", "className"]).select("trace_id", "project_id", F.col(other).alias("name")) for _, mine, other in ends]
    of_trace, of_bundle = stored(keys[0].union(keys[1]).distinct()), members[0].union(members[1])
    names = own.select("trace_id", F.col("className").alias("name")).distinct()
    # Single neighbours that no bundle of the trace has and that are not in the trace, and traces whose lists have classes of their own.
    single = single[0].union(single[1]).distinct()
    held_too = single.join(of_trace, "trace_id").join(of_bundle, ["key", "project_id", "name"], "left_semi").select("trace_id", "project_id", "name")
    single = single.join(held_too, ["trace_id", "project_id", "name"], "left_anti").join(names, ["trace_id", "name"], "left_anti")
    meets = of_trace.join(names, "trace_id").join(of_bundle.select("key", "name"), ["key", "name"], "left_semi").select("trace_id").distinct().withColumn("meets", F.lit(True))
    alone = single.join(said, ["project_id", "name"]).groupBy("trace_id").agg(F.flatten(F.collect_list("m")).alias("alone"))
    facts = own.groupBy("trace_id").agg(F.collect_set("className").alias("own")).join(of_trace.groupBy("trace_id").agg(F.array_sort(F.collect_set("key")).alias("keys")), "trace_id", "left")
    facts = stored(facts.join(alone, "trace_id", "left").join(meets, "trace_id", "left"))
    asked = facts.select("keys").distinct().select("keys", F.explode("keys").alias("key"))
    near = asked.join(of_bundle, "key").select("keys", "project_id", "name").distinct()
    lists = near.join(said, ["project_id", "name"]).groupBy("keys").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("inside"))
    spark = own.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    whole = facts.repartition(parts, "trace_id").join(lists, "keys", "left")
    inside = F.when(F.col("meets"), F.filter("inside", lambda m: ~F.array_contains("own", m["className"]))).otherwise(F.col("inside"))
    rest = F.when(F.col("alone").isNull(), inside).when(F.col("inside").isNull(), F.array_sort("alone")).otherwise(F.array_sort(F.concat(inside, "alone")))
    return whole.select("trace_id", F.posexplode(rest).alias("order", "m")).select("trace_id", (F.col("order") + 1).alias("order"), *(F.col(f"m.{c}").alias(c) for c in ("className", "methodName", "classType", "description", "httpEndpoint")))


def class_dependencies(catalog: Catalog) -> DataFrame:
    """Every node with its dependencies, dependents and the types of its methods' parameters, each with type and description."""
    summary = F.struct(F.col("full_class_name").alias("className"), F.col("class_type").alias("classType"), "description")
    info = catalog.classes.select("project_id", F.col("full_class_name").alias("other"), summary.alias("s"))

    links = parameter_links(catalog).select("project_id", F.col("owner").alias("full_class_name"), "method_name", "position", F.col("target").alias("other")).distinct()
    typed = links.join(info, ["project_id", "other"], "left").groupBy("project_id", "full_class_name", "method_name").agg(F.array_sort(F.collect_list(F.struct("position", "s"))).alias("_p"))
    params = typed.groupBy("project_id", "full_class_name").agg(F.array_sort(F.collect_list(F.struct(F.col("method_name").alias("methodName"), F.transform("_p", lambda x: x["s"]).alias("parameterTypes")))).alias("methodParameterTypes"))
    out = catalog.classes.select("project_id", "full_class_name", F.col("entry_point").alias("entryPoint"))
    out = out.join(params, ["project_id", "full_class_name"], "left")
    out = out.withColumn("methodParameterTypes", F.coalesce("methodParameterTypes", F.from_json(F.lit("[]"), out.schema["methodParameterTypes"].dataType)))
    out = bundles.listed(out, bundles.of(catalog), F.col("s"), info.withColumnRenamed("other", "name"), src="dependencies", dst="dependents")
    return out.select("project_id", F.col("full_class_name").alias("className"), "entryPoint", "dependencies", "dependents", "methodParameterTypes")


def project_overview(catalog: Catalog) -> DataFrame:
    """Every project: classes, entry points, classes by type (a map), and entry points with their endpoints."""
    breakdown = type_histogram(catalog).groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_type", F.col("classes").cast("int"))))).alias("classTypeBreakdown"))
    totals = catalog.classes.groupBy("project_id").agg(F.count("*").cast("int").alias("totalClasses"), F.count_if("entry_point").cast("int").alias("totalEntryPoints"))
    ends = catalog.methods.filter(has_endpoint()).groupBy(F.col("class_id").alias("id")).agg(F.array_sort(F.collect_list(http_endpoint(F.col("http_method"), F.col("http_path")))).alias("httpEndpoints"))
    none = F.array().cast("array<string>")
    entries = catalog.classes.filter("entry_point").join(ends, "id", "left").select("project_id", F.struct(F.col("full_class_name").alias("className"), F.col("class_type").alias("classType"), "description", F.coalesce("httpEndpoints", none).alias("httpEndpoints")).alias("e"))
    entries = entries.groupBy("project_id").agg(F.array_sort(F.collect_list("e")).alias("entryPoints"))
    out = catalog.projects.select(F.col("id").alias("project_id"), F.col("name").alias("projectName"), F.col("repository_url").alias("repositoryUrl"), "description")
    for part in (totals, breakdown, entries):
        out = out.join(part, "project_id", "left")
    return out.na.fill(0, ["totalClasses", "totalEntryPoints"]).withColumn("entryPoints", F.coalesce("entryPoints", F.from_json(F.lit("[]"), out.schema["entryPoints"].dataType)))


def service_api(catalog: Catalog) -> DataFrame:
    """Every project's controllers (entry points with an endpoint) with endpoints and their parameters."""
    param = parameter_links(catalog).select("project_id", F.col("owner").alias("full_class_name"), "method_name", "position", "target").distinct()
    info = catalog.classes.select("project_id", F.col("full_class_name").alias("target"), "class_type", "description")
    typed = param.join(info, ["project_id", "target"], "left").groupBy("project_id", "full_class_name", "method_name").agg(
        F.array_sort(F.collect_list(F.struct("position", F.col("target").alias("className"), F.col("class_type").alias("classType"), "description"))).alias("parameters")
    )
    owner = catalog.classes.filter("entry_point").select(F.col("id").alias("class_id"), "project_id", "full_class_name", F.col("description").alias("class_description"))
    rows = catalog.methods.filter(has_endpoint()).join(owner, "class_id").join(typed, ["project_id", "full_class_name", "method_name"], "left")
    rows = rows.withColumn("parameters", F.coalesce("parameters", F.from_json(F.lit("[]"), rows.schema["parameters"].dataType)))
    endpoint = F.struct(F.col("http_path").alias("httpPath"), F.col("http_method").alias("httpMethod"), F.col("method_name").alias("methodName"), "description", json_list(F.col("business_logic")).alias("businessLogic"), json_list(F.col("exceptions")).alias("exceptions"), "parameters")
    controllers = rows.groupBy("project_id", F.col("full_class_name").alias("className"), F.col("class_description").alias("description")).agg(F.array_sort(F.collect_list(endpoint)).alias("endpoints"))
    packed = controllers.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("className", "description", "endpoints"))).alias("controllers"))
    out = catalog.projects.select(F.col("id").alias("project_id"), F.col("name").alias("projectName"), F.col("repository_url").alias("repositoryUrl"), "description").join(packed, "project_id", "left")
    return out.withColumn("controllers", F.coalesce("controllers", F.from_json(F.lit("[]"), out.schema["controllers"].dataType)))
