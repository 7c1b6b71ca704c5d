"""A small catalog: two projects, four classes in the first."""

from codelattice import schema
from codelattice.schema import Catalog

PROJECTS = "id string, name string, repository_url string, default_branch string, description string, status string, created_at timestamp"
CLASSES = "id string, project_id string, full_class_name string, simple_name string, package_name string, class_type string, description string, source_file string, entry_point boolean, ordinal int"


def shop(spark) -> Catalog:
    from datetime import datetime

    projects = [("p1", "shop", "https://git.example.org/x/shop.git", "main", "A shop", "ANALYZED", datetime(2024, 1, 1)), ("p2", "bare", "git@git.example.org:x/bare.git", "main", None, "PENDING", datetime(2024, 1, 2))]
    row = lambda i, name, kind, entry, order, text=None: (i, "p1", f"org.shop.{name}", name.rsplit(".", 1)[-1], "org.shop" if "." not in name else "org.shop." + name.rsplit(".", 1)[0], kind, text, f"src/{name}.java", entry, order)
    classes = [
        row("c1", "web.OrderController", "CONTROLLER", True, 0, "Takes orders"),
        row("c2", "OrderService", "SERVICE", False, 1, "Keeps orders"),
        row("c3", "db.OrderRepository", "REPOSITORY", False, 2),
        row("c4", "db.OrderDto", "DTO", False, 3),
        row("c5", "Orphan", "OTHER", False, 4),
    ]
    methods = [
        ("m1", "c1", "listOrders", "Lists", '["query","map"]', None, "GET", "/orders", 25),
        ("m2", "c1", "createOrder", "Creates", '["check"]', '["BadOrder"]', "POST", "/orders", 40),
        ("m3", "c2", "findAll", "Finds", None, None, None, None, 15),
        ("m4", "c2", "create", None, "not json", None, None, None, None),
        ("m5", "c2", "create", "again", None, None, None, None, 9),
    ]
    params = [("m2", 0, "c4"), ("m4", 0, "c4"), ("m4", 1, "c3")]
    edges = [("p1", "org.shop.web.OrderController", "org.shop.OrderService"), ("p1", "org.shop.OrderService", "org.shop.db.OrderRepository"), ("p1", "org.shop.db.OrderRepository", "org.shop.OrderService"), ("p1", "org.shop.OrderService", "org.shop.OrderService"), ("p1", "org.shop.web.OrderController", "org.shop.db.OrderDto")]
    frames = [(1, 1, "org.shop.web.OrderController", "createOrder(Order)", 41), (1, 2, "org.shop.OrderService", "missing", 3), (1, 3, "org.other.Servlet", "doIt", 9), (2, 1, "org.other.Servlet", "doIt", 9), (2, 2, None, None, None)]
    make = spark.createDataFrame
    return Catalog(make(projects, PROJECTS), make(classes, CLASSES), make(methods, schema.METHODS), make(params, schema.PARAMS), make(edges, schema.EDGES), make(frames, schema.FRAMES))
