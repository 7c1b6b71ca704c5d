from pyspark.sql import functions as F

from codelattice.functions import columns as fn
from codelattice.operators.enrich import close_json


def values(spark, build, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_names(spark):
    assert values(spark, fn.simple_name, "a.b.C", "C", "", None) == ["C", "C", "", None]
    assert values(spark, fn.package_name, "a.b.C", "C", None) == ["a.b", None, None]
    assert values(spark, lambda t: fn.in_package(t, "a.b"), "a.b", "a.b.c", "a.bc", None) == [True, True, False, None]
    assert values(spark, fn.dotted_prefixes, "a.b.c", "a") == [["a", "a.b", "a.b.c"], ["a"]]
    assert values(spark, fn.bare_method_name, "save(A, B)", "save", " run (x)", "(x)") == ["save", "save", "run", "(x)"]
    assert values(spark, fn.bare_type, "List<Foo>", "Foo...", "Foo[]", "Foo[][]", "<T>", " ") == ["List", "Foo", "Foo", "Foo[]", "<T>", None]
    assert values(spark, fn.class_type, " service ", "Controller", "nonsense", "", None) == ["SERVICE", "CONTROLLER", "OTHER", "OTHER", "OTHER"]


def test_urls(spark):
    urls = ("https://git.example.org/a/b.git", "git@git.example.org:a/b.git", "http://x/y.git", "https://git.example.org/a/b", "text")
    assert values(spark, fn.is_repository_url, *urls) == [True, True, False, False, False]
    assert values(spark, fn.repository_name, *urls[:2]) == ["b", "b"]
    assert values(spark, fn.is_ssh, *urls[:2]) == [False, True]


def test_lists_and_replies(spark):
    assert values(spark, fn.json_list, '["a","b"]', "[]", "bad", None) == [["a", "b"], [], [], []]
    assert values(spark, fn.lenient_list, '["a"]', "plain", " ", None, '{"a":1}') == [["a"], ["plain"], [], [], []]
    assert values(spark, fn.json_in_reply, '```json\n{"a": 1}\n```', 'Sure: {"a": {"b": 1}} done', "", None) == ['{"a": 1}', '{"a": {"b": 1}}', "{}", "{}"]
    assert values(spark, close_json, '{"a": [1, 2], "b": {"c": 3}, "d": [', '{"a": "}"}', '{"a": ["x"], "b', "none") == ['{"a": [1, 2], "b": {"c": 3}}', '{"a": "}"}', '{"a": ["x"]}', "none"]


def test_texts_and_paths(spark):
    long_text = "x" * 10_001
    assert values(spark, fn.readme, "  ", "text", long_text, None) == [None, "text", "x" * 10_000 + "\n...(truncated)", None]
    assert values(spark, fn.readme_description, long_text) == ["x" * 500]
    assert values(spark, fn.route_path, "src/app/api/users/[id]/route.ts", "app/route.ts", "src/users/route.ts", "src/app/page.tsx") == ["/api/users/:id", None, None, None]
    assert values(spark, lambda t: fn.identifier_of_path(t, "java"), "a/b/C.java") == ["a.b.C"]
