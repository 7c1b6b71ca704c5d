import pytest
from pyspark.sql import functions as F

from codelattice.llm import line_dedup
from tests.llm.helpers import SF, clashing, docs, edge_docs


def brute(rows, least=2):
    seen = {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10 and doc_id is not None:
                seen.setdefault(key(line), set()).add(doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or key(x) not in seen or len(seen[key(x)]) < least or doc_id == min(seen[key(x)])]
        out[doc_id] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_against_brute_force(spark, least):
    texts = ["Shared LINE of text\nown first line here", "shared line of text  \nshort\n\tshared line of text", "ÉCOLE shared ligne\nown third line!!", "École shared ligne\nSHARED line of TEXT", "short\nshort", "", None]
    frame = docs(spark, texts)
    found = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(frame, min_documents=least).collect()}
    assert found == brute(list(enumerate(texts, 1)), least)


def test_edge_rows_and_clashing_names(spark):
    frame = edge_docs(spark)
    rows = line_dedup.dedup_lines(clashing(frame, "kept_text", "key", "h1", "_id", "row_hash")).collect()
    assert len(rows) == frame.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].kept_text == "" and by_id[2].n_lines == 1 and by_id[2].n_dropped == 0
    assert by_id[1].n_dropped == 0 and by_id[None].n_dropped == 0
    assert by_id[1].key == "was here"


def test_empty_table(spark):
    assert line_dedup.dedup_lines(docs(spark, ["a"]).limit(0)).count() == 0


def test_plan_has_no_python_and_shuffles_no_exploded_text(spark):
    plan = line_dedup.op1_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_shape(spark):
    assert line_dedup.op1_line_dedup(spark, SF).dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]
