import pytest
from pyspark.sql import functions as F

from codelattice.operators import ingest
from codelattice.sources import files

JAVA = {
    "src/main/java/org/shop/web/OrderController.java": '''/*
 * package org.wrong; class Wrong { void wrong() {} }
 */
package org.shop.web;

import org.shop.OrderService;
import static org.shop.util.Money.round;
import java.util.*;
import org.shop.db.OrderDto;

@RestController
@RequestMapping("/base{x}")
public class OrderController {
  private final OrderService service; // } { ;
  private String text = "class Fake { void fake() {} }";

  public OrderController(final OrderService service) throws IllegalStateException {
    this.service = service;
  }

  @GetMapping
  public List<OrderDto> all() { return service.all(); }

  @Deprecated
  @PostMapping(value = "/orders/{id}", consumes = "x")
  @ResponseBody
  public OrderDto save(@PathVariable("id") long id, final OrderDto dto, List<OrderDto> more, Neighbour... rest)
      throws IOException, org.shop.BadOrder {
    if (id > 0) { throw new IllegalArgumentException(";"); }
    Runnable r = () -> { run(); };
    return null;
  }

  @RequestMapping(method = RequestMethod.DELETE, path = "/orders")
  void drop(Map<String, OrderDto> all) {}

  @RequestMapping("/plain")
  int plain() { return 1; }

  static class Inner { void inner() {} }
}
''',
    "src/main/java/org/shop/web/Neighbour.java": "package org.shop.web;\n\nclass Neighbour { }\n",
    "src/main/java/org/shop/OrderService.java": "package org.shop;\n@Service class OrderService {\n  int a = 1;\n  String all() { return \"\"; }\n  void all(org.shop.db.OrderDto d) { }\n}\n",
    "src/main/java/org/shop/db/OrderDto.java": "package org.shop.db;\npublic record OrderDto(long id, String name) {\n  public OrderDto { check(id); }\n  OrderDto(String name) { this(1, name); }\n}\n",
    "src/main/java/org/shop/util/Money.java": "package org.shop.util;\npublic interface Money {\n  double round(double x);\n}\n",
    "src/main/java/org/shop/Jobs.java": "package org.shop;\nclass Jobs {\n  @KafkaListener(topics = {\"a\", \"b\"})\n  void take(String m) {}\n}\n",
    "src/main/java/org/shop/Plain.java": "package org.shop;\n\nclass Plain {\n\n  @Scheduled(cron = \"0 0 * * *\")\n  void tick() {}\n}\n",
    "src/test/java/org/shop/PlainTest.java": "class PlainTest {}",
    "src/main/java/org/shop/Empty.java": "",
}
SCRIPTS = {
    "src/main.ts": "import { AppModule } from './app.module';\nasync function bootstrap() {\n  run();\n}\nbootstrap();\n",
    "src/app.module.ts": "import { UserController } from './users/user.controller';\n@Module({ controllers: [UserController] })\nexport class AppModule {}\n",
    "src/users/user.controller.ts": "import { UserService } from './user.service';\nimport express from 'express';\nimport shared from '../shared';\n\n@Controller('users')\nexport class UserController {\n  constructor(private readonly users: UserService) {}\n\n  @Get(':id')\n  find(@Param('id') id: string): User { if (id) { return this.users.find(id); } }\n\n  @Post()\n  async create(@Body() dto: CreateUser, again: CreateUser): Promise<void> {\n    const s = '}';\n  }\n\n  private helper = (u: User) => { return u; };\n}\n",
    "src/users/user.service.ts": "@Injectable()\nexport class UserService {\n  find(id: string) { return null; }\n}\n",
    "src/shared/index.ts": "export const twice = (n: number) => n * 2;\nexport const memo = useCallback((n) => { return n; }, []);\nexport function plain(a: Thing) { return a; }\n",
    "src/users/user.dto.ts": "export interface UserDto { id: string }\n",
    "src/routes.js": "const router = require('express').Router();\nrouter.get('/x', handler);\n",
    "src/users/user.spec.ts": "class Spec {}",
    "node_modules/x/src/a.ts": "class A {}",
    "src/types.d.ts": "class B {}",
}
GO = {
    "main.go": 'package main\n\nimport (\n\t"fmt"\n\n\t"example.org/shop/internal/handler"\n)\n\nfunc main() {\n\thandler.Run()\n}\n',
    "internal/handler/order.go": 'package handler\n\nimport (\n\t"net/http"\n\tst "example.org/shop/internal/store"\n)\n\n// Handler has { braces }\ntype Handler struct {\n\tstore *st.Store\n}\n\nfunc Run() {\n\trouter.GET("/x", serve)\n}\n\nfunc (h *Handler) Serve(w http.ResponseWriter, r *http.Request) {\n\tif r == nil {\n\t\tpanic("no }")\n\t}\n}\n',
    "internal/handler/more.go": "package handler\n\nfunc Keep(s *st.Store, n int) error {\n\treturn nil\n}\n",
    "internal/store/store.go": "package store\n\ntype Store struct{}\n\nfunc (s Store) Get(id string) string { return `}` }\n",
    "internal/store/store_test.go": "package store\nfunc TestX() {}",
    "vendor/x/x.go": "package x",
    "api/order.pb.go": "package api",
    "go.mod": "module example.org/shop\n\ngo 1.22\n",
}


def tree(spark, sources):
    return spark.createDataFrame([("p", path, len(text), text) for path, text in sources.items()], "project_id string, path string, length long, content string")


def test_java(spark):
    found = tree(spark, JAVA).filter(files.is_java(F.col("path"))).withColumn("identifier", files.java_identifier(F.col("path")))
    parsed = ingest.java(found)
    nodes = {r.identifier: (r.class_type, r.entry_point) for r in parsed["nodes"].collect()}
    assert nodes == {
        "org.shop.web.OrderController": ("CONTROLLER", True),
        "org.shop.web.Neighbour": ("OTHER", False),
        "org.shop.OrderService": ("SERVICE", False),
        "org.shop.db.OrderDto": ("OTHER", False),
        "org.shop.util.Money": ("OTHER", False),
        "org.shop.Jobs": ("LISTENER", True),
        "org.shop.Plain": ("OTHER", True),
        "org.shop.Empty": ("OTHER", False),
    }
    edges = {(r.src, r.dst) for r in ingest.java_edges(parsed).collect()}
    assert edges == {("org.shop.web.OrderController", d) for d in ("org.shop.OrderService", "org.shop.util.Money", "org.shop.db.OrderDto")}
    methods = sorted((r.seq, r.method_name, r.line_number, r.http_method, r.http_path, tuple(r.exceptions)) for r in parsed["methods"].filter("identifier = 'org.shop.web.OrderController'").collect())
    assert methods == [
        (1, "OrderController", 17, None, None, ("IllegalStateException",)),
        (2, "all", 21, "GET", None, ()),
        (3, "save", 24, "POST", "/orders/{id}", ("IOException", "org.shop.BadOrder")),
        (4, "drop", 34, "DELETE", "/orders", ()),
        (5, "plain", 37, "GET", "/plain", ()),
    ]
    others = {(r.identifier, r.method_name) for r in parsed["methods"].collect() if "Controller" not in r.identifier}
    assert others == {("org.shop.OrderService", "all"), ("org.shop.db.OrderDto", "OrderDto"), ("org.shop.util.Money", "round"), ("org.shop.Jobs", "take"), ("org.shop.Plain", "tick")}
    params = {(r.identifier.rsplit(".", 1)[-1], r.method_name, r.position, r.target) for r in ingest.resolve_java_params(parsed).collect()}
    assert params == {("OrderController", "OrderController", 0, "org.shop.OrderService"), ("OrderController", "save", 0, "org.shop.db.OrderDto"), ("OrderController", "save", 1, "org.shop.web.Neighbour"), ("OrderService", "all", 0, "org.shop.db.OrderDto")}


def test_scripts(spark):
    found = tree(spark, SCRIPTS).filter(files.is_script(F.col("path"), F.col("length"))).withColumn("identifier", files.script_identifier(F.col("path"))).withColumn("framework", F.lit("nestjs"))
    parsed = ingest.script(found)
    nodes = {r.identifier: (r.class_type, r.entry_point) for r in parsed["nodes"].collect()}
    assert nodes == {
        "main": ("OTHER", True),
        "app.module": ("CONFIGURATION", False),
        "users.user.controller": ("CONTROLLER", True),
        "users.user.service": ("SERVICE", False),
        "shared.index": ("OTHER", True),
        "users.user.dto": ("DTO", False),
        "routes": ("CONTROLLER", True),
    }
    assert {(r.src, r.dst) for r in ingest.script_edges(parsed).collect()} == {("main", "app.module"), ("app.module", "users.user.controller"), ("users.user.controller", "users.user.service"), ("users.user.controller", "shared.index")}
    methods = {(r.identifier, r.method_name): (r.line_number, r.http_method, r.http_path, tuple(r.types)) for r in parsed["methods"].collect()}
    assert methods == {
        ("main", "bootstrap"): (2, None, None, ()),
        ("users.user.controller", "find"): (9, "GET", ":id", ()),
        ("users.user.controller", "create"): (12, "POST", None, ("CreateUser", "CreateUser")),
        ("users.user.controller", "helper"): (17, None, None, ("User",)),
        ("users.user.service", "find"): (3, None, None, ()),
        ("shared.index", "twice"): (1, None, None, ()),
        ("shared.index", "memo"): (2, None, None, ()),
        ("shared.index", "plain"): (3, None, None, ("Thing",)),
    }


def test_next_routes(spark):
    source = {"src/app/api/users/[id]/route.ts": "export async function GET(request: Request) { return 1; }\nexport const POST = async (r) => { };\nfunction other() {}\n"}
    found = tree(spark, source).withColumn("identifier", files.script_identifier(F.col("path"))).withColumn("framework", F.lit("nextjs"))
    methods = {r.method_name: (r.http_method, r.http_path) for r in ingest.script(found)["methods"].collect()}
    assert methods == {"GET": ("GET", "/api/users/:id"), "POST": ("POST", "/api/users/:id"), "other": (None, None)}


def test_go(spark):
    every = tree(spark, GO)
    found = every.filter(files.is_go(F.col("path"))).join(files.go_modules(every), "project_id").withColumn("identifier", files.go_identifier(F.col("module"), F.col("path")))
    parsed = ingest.go(found)
    nodes = {r.identifier: (r.class_type, r.entry_point) for r in parsed["nodes"].collect()}
    assert nodes == {"example.org/shop": ("OTHER", True), "example.org/shop/internal/handler": ("CONTROLLER", True), "example.org/shop/internal/store": ("REPOSITORY", False)}
    assert {(r.src.rsplit("/", 1)[-1], r.dst.rsplit("/", 1)[-1]) for r in ingest.go_edges(parsed).collect()} == {("shop", "handler"), ("handler", "store")}
    methods = {r.method_name: (r.line_number, r.http_method, tuple(r.exceptions)) for r in parsed["methods"].collect()}
    assert methods == {"main": (9, None, ()), "Run": (13, None, ()), "Handler.Serve": (17, "GET", ("panic",)), "Keep": (3, None, ()), "Store.Get": (5, None, ())}
    assert {(r.method_name, r.target) for r in ingest.go_params(parsed).collect()} == {("Keep", "example.org/shop/internal/store")}


def test_project_files(spark):
    make = lambda project, path, text="": (project, path, len(text), text)
    rows = [make("g", "go.mod"), make("g", "package.json"), make("n", "package.json", '{"dependencies": {"express": "1", "next": "2"}}'), make("j", "package.json", "broken"), make("j", "pom.xml"), make("e", "README.md"), make("r", "package.json", '{"devDependencies": {"@remix-run/react": "2"}}')]
    every = spark.createDataFrame(rows, "project_id string, path string, length long, content string")
    assert {r.project_id: r.language for r in files.languages(every).collect()} == {"g": "go", "n": "node", "j": "java", "e": "java", "r": "node"}
    assert {r.project_id: (r.framework, r.source_root) for r in files.frameworks(every).collect()} == {"g": ("unknown", "src"), "n": ("nextjs", "src"), "j": ("unknown", "src"), "r": ("remix", "app")}


def test_reading_a_folder(spark, tmp_path):
    for path, text in JAVA.items():
        (tmp_path / "repo" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / path).write_text(text)
    found = files.read_tree(spark, str(tmp_path / "repo"), "p", "*.java")
    assert {r.path: r.content for r in found.collect()} == {path: text for path, text in JAVA.items() if text}  # Spark's readers pass empty files over


def parsed_java(spark, source):
    found = tree(spark, source).withColumn("identifier", files.java_identifier(F.col("path")))
    return ingest.java(found)


def test_literals_of_a_megabyte_and_files_of_five(spark):
    long = 'x\\" {;} \\\\' * 120_000
    java = f'package a;\n@Service("{long}")\nclass A {{\n  String s = "{long}";\n  void after() {{ String t = "open; }}\n  }}\n  @GetMapping("/x") int last() {{ return 1; }}\n}}\n'
    many = "package a;\nclass B {\n" + "".join(f'  int m{i}(String a) {{ String s = "}}" + {i}; return {i}; }} // "\n' for i in range(70_000)) + "}\n"
    parsed = parsed_java(spark, {"src/main/java/a/A.java": java, "src/main/java/a/B.java": many})
    assert {(r.identifier, r.class_type) for r in parsed["nodes"].collect()} == {("a.A", "SERVICE"), ("a.B", "OTHER")}
    names = [r.method_name for r in parsed["methods"].filter("identifier = 'a.B'").collect()]
    assert len(names) == 70_000
    script = f"const text = `{long} ${{a}}`;\nconst other = '{long}';\nexport class A {{\n  @Get('{long}')\n  go(a: B) {{ return `{long}`; }}\n}}\nconst open = 'abc;\nfunction last() {{ }}\n"
    found = tree(spark, {"src/a.ts": script}).withColumn("identifier", files.script_identifier(F.col("path"))).withColumn("framework", F.lit("nestjs"))
    assert {(r.method_name, r.http_method) for r in ingest.script(found)["methods"].collect()} == {("go", "GET"), ("last", None)}
    go = f'package a\n\nvar s = `{long}`\n\nvar t = "{long}"\n\nfunc Last(a string) {{\n}}\n'
    found = tree(spark, {"a/a.go": go}).withColumn("module", F.lit("m")).withColumn("identifier", F.lit("m/a"))
    assert {r.method_name for r in ingest.go(found)["methods"].collect()} == {"Last"}


def test_generics_and_imports_of_any_depth(spark):
    java = {
        "src/main/java/a/A.java": "package a;\nclass A {\n  void go(Map<A<B<C<D<E<F>>>>>> m, Money x, List<List<List<List<List<List<Money>>>>>> y) {}\n}\n",
        "src/main/java/a/Money.java": "package a;\nclass Money {}\n",
        "src/main/java/a/Map.java": "package a;\nclass Map {}\n",
    }
    assert {(r.position, r.target) for r in ingest.resolve_java_params(parsed_java(spark, java)).collect()} == {(0, "a.Map"), (1, "a.Money")}
    deep = "src/" + "/".join(f"d{i}" for i in range(12)) + "/a.ts"
    found = tree(spark, {deep: f"import {{ B }} from '{'../' * 12}b';\nimport C from './x/../y/./.././../d11/c';\n", "src/b.ts": "", deep.replace("a.ts", "c.ts"): ""})
    found = found.withColumn("identifier", files.script_identifier(F.col("path"))).withColumn("framework", F.lit("unknown"))
    assert {r.dst for r in ingest.script_edges(ingest.script(found)).collect()} == {"b", ".".join(f"d{i}" for i in range(12)) + ".c"}


def test_script_parameters(spark):
    found = tree(spark, SCRIPTS | {"src/users/order.ts": "import Shop, { UserService as Users, UserDto } from './user.service';\nimport * as all from '../shared';\nimport { UserDto as Dto } from './user.dto';\n\nexport class Order {\n  first(a: number, b: Users, c: Other, d: Dto) { return 1; }\n  second(a: Dto) { }\n  second(a: number) { }\n}\n"})
    found = found.filter(files.is_script(F.col("path"), F.col("length"))).withColumn("identifier", files.script_identifier(F.col("path"))).withColumn("framework", F.lit("nestjs"))
    params = {(r.identifier, r.method_name, r.position, r.target) for r in ingest.resolve_script_params(ingest.script(found)).collect()}
    assert params == {("users.order", "first", 0, "users.user.service"), ("users.order", "first", 1, "users.user.dto"), ("users.order", "second", 0, "users.user.dto")}


def test_generated_files_are_dealt_to_as_many_tasks_as_asked_for(spark):
    from codelattice.sources import generated
    from codelattice.sources.catalog import from_orders

    for made in (generated.java_files, generated.script_modules):
        of_task = made(from_orders(spark, "/root/testdata/sf0.001")).groupBy(F.spark_partition_id()).count().collect()
        assert len(of_task) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_imports_that_nobody_asks_for_are_not_stored(spark):
    source = "package a;\n\nimport b.B;\nimport b.C;\n\n@Service\nclass A {\n  B b(C c) { return null; }\n}\n"
    found = tree(spark, {"src/main/java/a/A.java": source}).withColumn("identifier", files.java_identifier(F.col("path")))
    asked, bare = ingest.java(found), ingest.java(found, imports=False)
    assert "imports" not in bare and {r.imported for r in asked["imports"].collect()} == {"b.B", "b.C"}
    assert all(asked[part].collect() == bare[part].collect() for part in ("nodes", "methods", "params"))
    held = ingest.cut(found.select("project_id", "path", "identifier", "content"), "java", deepest=1, heads=False)
    assert [r.head for r in held.collect()] == [None]


@pytest.mark.parametrize("language", ["java", "script", "go"])
def test_files_that_share_a_head(spark, language):
    """Heads are stored once, and edges are as of each file by itself; a comment, a second head and an import further down count as before."""
    n = 60
    if language == "java":
        head = "".join(f"import o.T{i};\n" for i in range(n))
        tree_of = {f"src/main/java/o/T{i}.java": f"package o;\nclass T{i} {{ }}\n" for i in range(n)} | {f"src/main/java/o/S{i}.java": f"package o;\n{head}class S{i} {{ }}\n" for i in range(5)}
        tree_of |= {"src/main/java/o/Late.java": f"package o;\n{head}class Late {{ }}\nimport o.S1; /* import o.S2; */ // x\nimport o.T1;\n", "m/src/main/java/o/S1.java": "import o.Late;\nclass S1 { }\n", "src/main/java/o/None.java": "class None { String s = \"import o.T1;\"; }"}
        more = {("o.Late", "o.S1"), ("o.S1", "o.Late")}
        named, wide = (lambda rows: rows.withColumn("identifier", files.java_identifier(F.col("path")))), ["o.S0", "o.S1", "o.S2", "o.S3", "o.S4", "o.Late"]
        wanted = {(s, f"o.T{i}") for s in wide for i in range(n)} | more
    elif language == "script":
        head = "".join(f"import {{ X }} from './t{i}';\n" for i in range(n))
        tree_of = {f"src/a/t{i}.ts": f"export const x{i} = 1;\n" for i in range(n)} | {f"src/b/t{i}.ts": f"export const x{i} = 1;\n" for i in range(0, n, 2)} | {f"src/{d}/s{i}.ts": f"{head}class S{i} {{ }}\n" for d in "ab" for i in range(3)}
        tree_of |= {"src/a/late.ts": f"{head}class Late {{ }}\nimport {{ S }} from './s1'; // import z from './s2'\n", "src/b/none.ts": "const s = 1; // from\n"}
        named = lambda rows: rows.withColumn("identifier", files.script_identifier(F.col("path"))).withColumn("framework", F.lit("nestjs"))
        wanted = {(f"a.{s}", f"a.t{i}") for s in ("s0", "s1", "s2", "late") for i in range(n)} | {(f"b.s{k}", f"b.t{i}") for k in range(3) for i in range(0, n, 2)} | {("a.late", "a.s1")}
    else:
        head = "import (\n" + "".join(f'\t"m/t{i}"\n' for i in range(n)) + ")\n"
        tree_of = {f"t{i}/x.go": "package t\n" for i in range(n)} | {f"s{i}/x.go": f"package s\n\n{head}func run() {{\n}}\n" for i in range(4)}
        tree_of |= {"s1/y.go": 'package s\n\nimport "m/s0" // import "m/s3"\n', "s2/z.go": f'package s\n\n{head}import "m/t1"\n'}
        named = lambda rows: rows.withColumn("module", F.lit("m")).withColumn("identifier", files.go_identifier(F.col("module"), F.col("path")))
        wanted = {(f"m/s{k}", f"m/t{i}") for k in range(4) for i in range(n)} | {("m/s1", "m/s0")}
    found = named(tree(spark, tree_of)).coalesce(1)
    edges_of = {"java": ingest.java_edges, "script": ingest.script_edges, "go": ingest.go_edges}[language]
    whole = {"java": ingest.java, "script": ingest.script, "go": ingest.go}[language](found)
    fewer = ingest.imports_of(found, language)
    for parsed in (whole, fewer):
        rows = [(r.src, r.dst) for r in edges_of(parsed).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == wanted
    # A head's imports are kept once for all files that have it.
    assert fewer["shared"].count() <= 2 * n + 1


def test_scripts_without_imports_store_none_and_classes_alone_make_no_edges(spark, monkeypatch):
    from codelattice.operators import analyze

    found = tree(spark, SCRIPTS).filter(files.is_script(F.col("path"), F.col("length"))).withColumn("identifier", files.script_identifier(F.col("path"))).withColumn("framework", F.lit("nestjs"))
    asked, bare = ingest.script(found), ingest.script(found, imports=False)
    assert set(asked) - set(bare) == {"imports", "locals", "shared", "headed", "own"}
    assert all(sorted(map(str, asked[part].collect())) == sorted(map(str, bare[part].collect())) for part in ("nodes", "methods"))
    whole = tree(spark, {**JAVA, "pom.xml": "<project/>"})
    with monkeypatch.context() as m:
        for name in ("java_edges", "script_edges", "go_edges"):
            m.setattr(ingest, name, None)
        alone = analyze.parse(whole, related=False)
    assert set(alone) == {"nodes", "methods"} and sorted(map(str, alone["nodes"].collect())) == sorted(map(str, analyze.parse(whole)["nodes"].collect()))


def test_a_row_holds_few_pieces(spark):
    """Files of more pieces have several rows, and what is read off them is as before."""
    n = 3 * ingest.ROW_PIECES
    source = "package s\n\ntype A struct {\n" + "".join(f"\tF{i} int\n" for i in range(n)) + "}\n\nfunc (a A) Do() {\n}\n"
    found = tree(spark, {"s/a.go": source, "s/b.go": "package s\n"}).withColumn("module", F.lit("m")).withColumn("identifier", files.go_identifier(F.col("module"), F.col("path")))
    held = ingest.cut(found.drop("length"), "go", code=True)
    assert max(r.n for r in held.select(F.size("pieces").alias("n")).collect()) == ingest.ROW_PIECES and held.filter("code is not null").count() == 2
    parsed = ingest.go(found)
    of = ingest.go_types(parsed)
    assert [r.field for r in of["fields"].orderBy("place").collect()] == [f"F{i}" for i in range(n)]
    assert [(r.type, r.method, r.line_number) for r in of["bound"].collect()] == [("A", "Do", n + 6)] and parsed["nodes"].count() == 1
