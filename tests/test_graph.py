from dataclasses import replace

from pyspark.sql import functions as F

from codelattice.operators import context, graph
from codelattice.plans import graph_json
from codelattice.schema import EDGES
from tests.fixtures import shop


def order(catalog):
    rows = sorted(graph.analysis_order(catalog).collect(), key=lambda r: r.place)
    return [(r.full_class_name.rsplit(".", 1)[-1], r.depth, r.orphan) for r in rows]


def test_order_of_cycles_and_orphans(spark):
    catalog = shop(spark)
    assert order(catalog) == [("OrderController", 0, False), ("OrderService", 1, False), ("OrderDto", 1, False), ("OrderRepository", 2, False), ("Orphan", None, True)]
    nothing = replace(catalog, classes=catalog.classes.withColumn("entry_point", F.lit(False)))
    assert [x[1] for x in order(nothing)] == [None] * 5


def test_neighbours_are_both_directions(spark):
    catalog = shop(spark)
    pairs = {(r.node, r.neighbour) for r in graph.neighbours(catalog.edges).collect()}
    edges = {(r.src, r.dst) for r in catalog.edges.collect()}
    assert pairs == edges | {(b, a) for a, b in edges}


def test_only_known_ends_count(spark):
    nodes = graph.build_nodes(spark.createDataFrame([("p", 0, "a", "old"), ("p", 1, "b", "b"), ("p", 2, "a", "new")], "project_id string, seq int, identifier string, source_file string"))
    assert {(r.identifier, r.ordinal, r.source_file) for r in nodes.collect()} == {("a", 0, "new"), ("b", 1, "b")}
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "a", "b"), ("p", "a", "a"), ("p", "a", "x"), ("q", "a", "b")], EDGES)
    assert {(r.src, r.dst) for r in graph.known_edges(nodes, edges).collect()} == {("a", "b"), ("a", "a")}
    points = spark.createDataFrame([("p", "a"), ("p", "z")], "project_id string, identifier string")
    assert [r.identifier for r in graph.known_entry_points(nodes, points).collect()] == ["a"]
    links = spark.createDataFrame([("p", "a", "m", 0, "b"), ("p", "a", "m", 0, "b"), ("p", "a", "m", 0, "z")], "project_id string, owner string, method_name string, position int, target string")
    assert graph.known_links(nodes, links).count() == 2


def test_base_packages(spark):
    catalog = shop(spark)
    named = lambda *packages: replace(catalog, classes=spark.createDataFrame([("p1", p) for p in packages], "project_id string, package_name string"))
    base = lambda c: [r.base_package for r in graph.base_packages(c).collect()]
    assert base(catalog) == ["org.shop"]
    assert base(named("a.b", "a.bc")) == ["a"] and base(named("a", "b")) == [""] and base(named("a.b", None, "a.b.c")) == ["a.b"] and base(named(None)) == []


def test_json_there_and_back(spark):
    catalog = shop(spark)
    documents = graph_json.to_json(catalog)
    parsed = graph_json.from_json(documents.union(spark.createDataFrame([("p8", None), ("p9", "{broken")], "project_id string, graph_data string")))
    assert {(r.src, r.dst) for r in graph_json.edges(parsed).collect()} == {(r.src, r.dst) for r in catalog.edges.collect()}
    assert {(r.full_class_name, r.class_type, r.entry_point, r.id) for r in graph_json.nodes(parsed).collect()} == {(r.full_class_name, r.class_type, r.entry_point, r.id) for r in catalog.classes.collect()}
    methods = graph_json.methods(parsed).collect()
    assert len(methods) == 5 and {tuple(r.businessLogic or ()) for r in methods} == {(), ("query", "map"), ("check",)}
    links = {(r.owner, r.method_name, r.position, r.target) for r in graph_json.method_links(parsed).collect()}
    assert ("org.shop.web.OrderController", "createOrder", 0, "org.shop.db.OrderDto") in links
    old = spark.createDataFrame([("p", '{"nodes":{"a":{"sourceFile":"x"}}}')], "project_id string, graph_data string")
    row = graph_json.nodes(graph_json.from_json(old)).first()
    assert (row.full_class_name, row.entry_point, row.class_type) == ("a", False, None)


def test_enrichment_of_all_overloads(spark):
    catalog = shop(spark)
    updates = spark.createDataFrame([("c2", "create", "new", None)], "class_id string, method_name string, description string, business_logic string")
    found = {r.id: (r.description, r.business_logic, r.line_number) for r in graph.apply_enrichment(catalog.methods, updates).collect()}
    assert found["m4"] == ("new", None, None) and found["m5"] == ("new", None, 9) and found["m1"][0] == "Lists"


def test_contexts(spark):
    catalog = shop(spark)
    classes = {r.className: r for r in context.class_context(catalog, catalog.frames).collect()}
    assert classes["org.shop.OrderService"].found and classes["org.shop.OrderService"].graphInfo.dependents[0] == "org.shop.OrderService"
    assert not classes["org.other.Servlet"].found and classes["org.other.Servlet"].message
    methods = {(r.className, r.methodName): r for r in context.method_context(catalog, catalog.frames).collect()}
    found = methods["org.shop.web.OrderController", "createOrder(Order)"]
    assert found.found and found.httpEndpoint == "POST /orders" and found.exceptions == ["BadOrder"] and [p.typeName for p in found.parameterTypes] == ["org.shop.db.OrderDto"]
    assert methods["org.shop.OrderService", "missing"].message == "Class found but method not indexed"
    assert methods["org.other.Servlet", "doIt"].message == "No context available for this method"
    traced = context.trace_context(catalog, catalog.frames)
    state = {(r.trace_id, r.ord): (r.found, r.classType) for r in traced.collect()}
    assert state == {(1, 1): (True, "CONTROLLER"), (1, 2): (False, "SERVICE"), (1, 3): (False, None), (2, 1): (False, None), (2, 2): (False, None)}
    urls = {r.trace_id: r.projectUrl for r in context.trace_projects(catalog, traced).collect()}
    assert urls == {1: "https://git.example.org/x/shop.git", 2: None}
    near = sorted((r.order, r.className, r.methodName) for r in context.related_dependencies(catalog, traced).collect())
    assert near == [(1, "org.shop.db.OrderDto", None), (2, "org.shop.db.OrderRepository", None)]
    overview = {r.projectName: r for r in context.project_overview(catalog).collect()}
    assert overview["shop"].totalClasses == 5 and overview["shop"].classTypeBreakdown["DTO"] == 1 and overview["bare"].entryPoints == []
    api = {r.projectName: r for r in context.service_api(catalog).collect()}
    assert [e.methodName for e in api["shop"].controllers[0].endpoints] == ["listOrders", "createOrder"] and api["bare"].controllers == []
    listed = [(r.name, r.class_count, r.endpoint_count, r.base_package) for r in context.list_projects(catalog).collect()]
    assert listed == [("bare", 0, 0, None), ("shop", 5, 2, "org.shop")]
    queries = spark.createDataFrame([("shop", "ORDERS"), ("shop", "zzz")], "project string, query string")
    assert [(r.className, r.total) for r in context.search(catalog, queries).collect()] == [("org.shop.OrderService", 5)]


def test_related_methods_of_bundles_are_as_of_single_edges(spark):
    """Traces of several classes and projects; neighbours in bundles, alone, in both, and in the trace; edges one by one are not read."""
    from dataclasses import replace

    from codelattice.operators import bundles
    from codelattice.schema import EDGES, METHODS

    names = [f"n{i}" for i in range(9)]
    sources = [(p, m, n) for p in "pq" for i, n in enumerate(names[:5]) for m in range(3) if (i + m) % 3]
    targets = [(p, m, n) for p in "pq" for i, n in enumerate(names[3:]) for m in range(3) if (i * m) % 2 == 0]
    single = [("p", "n8", "n0"), ("p", "n0", "n3"), ("p", "n7", "n7"), ("q", "n6", "n8"), ("p", "n0", "gone"), ("q", "n1", "n2")]
    make = spark.createDataFrame
    held = bundles.bundled(make(single, EDGES), make(sources, "project_id string, mark int, src string"), make(targets, "project_id string, mark int, dst string"))
    classes = make([(f"{p}{n}", p, n, f"kind of {n}") for p in "pq" for n in names], "id string, project_id string, full_class_name string, class_type string")
    methods = make([(f"m{i}", f"{p}{names[i % 7]}", f"do{i % 3}", f"text {i}", None, None, "GET" if i % 2 else None, "/x", i % 4 or None) for i in range(30) for p in "pq"], METHODS).withColumn("id", F.concat("id", F.substring("class_id", 1, 1)))
    traced = make([(1, "p", "n0", 1), (1, "p", "n4", 2), (2, "q", "n6", 1), (3, "p", "n8", 1), (3, "q", "n2", 2), (4, None, "x", 1), (5, "p", "n7", 1), (6, "p", "n1", 1)], "trace_id int, project_id string, className string, ord int")
    catalog = replace(shop(spark), classes=classes, methods=methods, edges=bundles.flat(held), bundles=held)
    edges = {tuple(r) for r in catalog.edges.select("project_id", "src", "dst").collect()}
    near = edges | {(p, b, a) for p, a, b in edges}
    said = {}
    for m in methods.collect():
        said.setdefault(m.class_id, []).append(m)
    wanted = []
    for trace in (1, 2, 3, 5, 6):
        own = {(r.project_id, r.className) for r in traced.collect() if r.trace_id == trace}
        other = {(p, b) for p, a, b in near if (p, a) in own and b != "gone" and b not in {n for _, n in own}}
        rows = [(n, p, m) for p, n in other for m in said.get(p + n, [None])]
        rows.sort(key=lambda x: (x[0], *((x[2].line_number is None, x[2].line_number or 0, x[2].method_name, x[2].id) if x[2] else (True, 0, "~", "")), x[1]))
        wanted += [(trace, i, n, m and m.method_name, f"kind of {n}", m and m.description) for i, (n, _, m) in enumerate(rows, 1)]
    for c in (replace(catalog, edges=None), replace(catalog, bundles=None)):
        found = context.related_dependencies(c, traced).select("trace_id", "order", "className", "methodName", "classType", "description").collect()
        assert sorted(map(tuple, found), key=lambda r: r[:2]) == wanted
