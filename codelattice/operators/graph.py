"""The dependency graph of each project as joins over its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.columns import common_prefix
from codelattice.operators import bundles
from codelattice.operators.ranks import ranked
from codelattice.schema import Bundles, Catalog
from codelattice.storage import finished, stored


def build_nodes(files: DataFrame) -> DataFrame:
    """One row for each identifier of (project_id, seq, identifier, source_file, ...): its first place as ``ordinal``, and what its last file says.

    An identifier is an entry point if any of its files is one.
    """
    last = [F.max_by(c, "seq").alias(c) for c in files.columns if c not in ("project_id", "identifier", "seq", "entry_point")]
    entry = [F.bool_or("entry_point").alias("entry_point")] if "entry_point" in files.columns else []
    return files.groupBy("project_id", "identifier").agg(F.min("seq").alias("ordinal"), *last, *entry)


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges (project_id, src, dst) of which both ends are nodes."""
    at = lambda end: nodes.select("project_id", F.col("identifier").alias(end))
    return edges.select("project_id", "src", "dst").join(at("src"), ["project_id", "src"], "left_semi").join(at("dst"), ["project_id", "dst"], "left_semi").distinct()


def known_bundles(nodes: DataFrame, held: Bundles) -> Bundles:
    """The same of edges in bundles: a bundle keeps the sources and the targets that are nodes."""
    at = lambda end: nodes.select("project_id", F.col("identifier").alias(end))
    sources, targets = (rows.join(at(end), ["project_id", end], "left_semi").select(rows.columns) for rows, end in ((held.sources, "src"), (held.targets, "dst")))
    return Bundles(known_edges(nodes, held.single), sources, targets)


def known_entry_points(nodes: DataFrame, entry_points: DataFrame) -> DataFrame:
    return entry_points.join(nodes, ["project_id", "identifier"], "left_semi").select("project_id", "identifier").distinct()


def known_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Parameter links (project_id, owner, method_name, position, target) between nodes; repeats stay."""
    at = lambda end: nodes.select("project_id", F.col("identifier").alias(end))
    return links.join(at("owner"), ["project_id", "owner"], "left_semi").join(at("target"), ["project_id", "target"], "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """(project_id, node, neighbour) in both directions, once each."""
    out = edges.select("project_id", F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    return out.union(edges.select("project_id", F.col("dst").alias("node"), F.col("src").alias("neighbour"))).distinct()


def adjacency(catalog: Catalog) -> DataFrame:
    """(project_id, full_class_name, dependencies, dependents) of every node, as sorted arrays."""
    return bundles.listed(catalog.classes.select("project_id", "full_class_name"), bundles.of(catalog), src="dependencies", dst="dependents")


def degrees(catalog: Catalog) -> DataFrame:
    """Sizes of the sets of ``adjacency`` and of the neighbourhood, without collecting them."""
    held = bundles.of(catalog)
    parts = {"dependencies": bundles.degree(held, "src"), "dependents": bundles.degree(held, "dst"), "_both": bundles.mutual(held)}
    joined = catalog.classes.select("project_id", "full_class_name")
    for name, part in parts.items():
        joined = joined.join(part.withColumnRenamed("n", name), ["project_id", "full_class_name"], "left")
    joined = joined.na.fill(0, list(parts))
    return joined.withColumn("neighbours", F.col("dependencies") + F.col("dependents") - F.col("_both")).drop("_both")


def parameter_links(catalog: Catalog) -> DataFrame:
    """(project_id, owner, method_name, position, target): classes as parameters of methods of their own project."""
    owner = catalog.classes.select(F.col("id").alias("class_id"), "project_id", F.col("full_class_name").alias("owner"))
    target = catalog.classes.select(F.col("id").alias("target_id"), F.col("project_id").alias("target_project"), F.col("full_class_name").alias("target"))
    methods = catalog.methods.select(F.col("id").alias("method_id"), "class_id", "method_name").join(owner, "class_id").drop("class_id")
    params = catalog.params.select("method_id", "position", F.col("class_id").alias("target_id"))
    linked = params.join(methods, "method_id").join(target, "target_id").filter(F.col("project_id") == F.col("target_project"))
    return linked.select("project_id", "owner", "method_name", "position", "target")


def parameter_targets(catalog: Catalog) -> DataFrame:
    """Distinct (project_id, owner, target)."""
    return parameter_links(catalog).select("project_id", "owner", "target").distinct()


def analysis_order(catalog: Catalog) -> DataFrame:
    """(project_id, full_class_name, depth, orphan, place): breadth first from the entry points.

    All entry points have depth 0; depth grows along outgoing edges; nodes that
    none reaches are orphans without depth and come last, in node order. Ties
    within a depth go by name. All projects advance together: a round joins
    the frontier with the edges and drops what has been seen, so there are as
    many rounds as the deepest project has levels, cycles or not. Each round is
    stored, which cuts the lineage.
    """
    nodes = catalog.classes.select("project_id", "full_class_name", "entry_point", "ordinal")
    seen = finished(catalog.classes.sparkSession, lambda: _depths(nodes, bundles.of(catalog)))
    ordered = nodes.join(seen, ["project_id", "full_class_name"], "left")
    order = [F.asc_nulls_last("depth"), F.when(F.col("depth").isNull(), F.col("ordinal")), F.col("full_class_name")]
    return ranked(ordered.select("project_id", "full_class_name", "depth", F.col("depth").isNull().alias("orphan"), "ordinal"), ["project_id"], order).drop("ordinal")


def _depths(nodes: DataFrame, held: Bundles) -> DataFrame:
    """(project_id, full_class_name, depth) of what the entry points reach; a bundle is entered once, by its first source."""
    name = lambda end: F.col(end).alias("full_class_name")
    single, sources = held.single.select("project_id", name("src"), "dst"), held.sources.select("project_id", "bundle", name("src"))
    frontier = stored(nodes.filter("entry_point").select("project_id", "full_class_name", F.lit(0).alias("depth")).distinct())
    seen, entered = frontier, held.sources.select("project_id", "bundle").limit(0)
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        fresh = sources.join(frontier, ["project_id", "full_class_name"]).select("project_id", "bundle").distinct().join(entered, ["project_id", "bundle"], "left_anti")
        fresh = stored(fresh)
        step = frontier.join(single, ["project_id", "full_class_name"]).select("project_id", name("dst"))
        step = step.union(held.targets.join(fresh, ["project_id", "bundle"]).select("project_id", name("dst"))).distinct()
        frontier = stored(step.join(seen, ["project_id", "full_class_name"], "left_anti").withColumn("depth", F.lit(depth)))
        again = depth % 8 == 0
        seen, entered = (stored(x) if again else x for x in (seen.union(frontier), entered.union(fresh)))
    return seen


def counts(catalog: Catalog) -> DataFrame:
    """Nodes, entry points and edges of each project, 0 where there are none."""
    nodes = catalog.classes.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("nodes"), F.count_if("entry_point").alias("entry_points"))
    edges = bundles.totals(bundles.of(catalog)).withColumnRenamed("project_id", "id")
    return catalog.projects.select("id", "name").join(nodes, "id", "left").join(edges, "id", "left").na.fill(0, ["nodes", "entry_points", "edges"])


def base_packages(catalog: Catalog) -> DataFrame:
    """(project_id, base_package): the dotted prefix that all packages of a project share.

    The smallest and the largest package, compared segment by segment, share
    just what all do, so two combinable aggregates suffice. Null packages are
    passed over; no package gives null, nothing shared an empty string.
    """
    parts = catalog.classes.filter(F.col("package_name").isNotNull()).select("project_id", F.split("package_name", "[.]").alias("parts"))
    ends = parts.groupBy("project_id").agg(F.min("parts").alias("first"), F.max("parts").alias("last"))
    return ends.select("project_id", common_prefix(F.col("first"), F.col("last")).alias("base_package"))


def type_histogram(catalog: Catalog) -> DataFrame:
    return catalog.classes.groupBy("project_id", "class_type").agg(F.count("*").alias("classes"))


def apply_enrichment(methods: DataFrame, updates: DataFrame) -> DataFrame:
    """``methods`` with descriptions and logic from ``updates`` (class_id, method_name, description, business_logic).

    All overloads of a name change; exceptions, endpoint and line stay. Where
    an update matches, its nulls count.
    """
    new = updates.select("class_id", "method_name", F.struct("description", "business_logic").alias("_new"), F.lit(True).alias("_hit"))
    joined = methods.join(new, ["class_id", "method_name"], "left")
    changed = {c: F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("description", "business_logic")}
    return joined.withColumns(changed).select(methods.columns)
