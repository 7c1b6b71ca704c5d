import random
import re

import pytest
from pyspark.sql import functions as F

from codelattice.llm import divergence
from tests.llm.helpers import clashing, docs, edge_docs

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=10, top=10):
    """Dense, with Python's integers."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)), lang or "", source or "") for _, t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        in_docs = {}
        for terms, _, _ in own:
            for t in set(terms):
                in_docs[t] = in_docs.get(t, 0) + 1
        kept = sorted(t for t, n in in_docs.items() if n >= least)
        count = lambda terms_of: [sum(x == t for terms in terms_of for x in terms) for t in kept]
        share = lambda c: [1 + 1_000_000_000 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]
        sources = sorted({r[2] for r in own})
        counts = {s: count([r[0] for r in own if r[2] == s]) for s in sources}
        p, q = {s: share(c) for s, c in counts.items()}, share(count([r[0] for r in own]))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(map(gap, p[s], p[o]))) for o in sources if o != s]
            term = [(t, gap(a, b)) for t, c, a, b in zip(kept, counts[s], p[s], q, strict=True) if c and a > b]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked[:most], 1)}
    return out


def drawn(n=240, sources=9, seed=5):
    draw = random.Random(seed)
    words = ["one", "Two", "drei", "été", "日本", "ZÄH", "seven", "eight", "ninth", "tenth", "x2y", "rare"]
    rows = []
    for i in range(n):
        s = draw.randrange(sources)
        picked = draw.choices(words[: 5 + s % 7], k=draw.randrange(12)) if s != 4 else []
        rows.append((i, draw.choice([" ", "-", "3"]).join(picked), draw.choice(["a", "a", "b", None]), f"s{s}" if s else None))
    return rows


@pytest.mark.parametrize("block", [512, 2])
def test_against_the_definition(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", block)
    monkeypatch.setattr(divergence, "HELD_TILES", 2)
    rows = drawn()
    found = divergence.audit_sources(spark.createDataFrame(rows, SCHEMA), 4, 3)
    assert {tuple(r) for r in found.collect()} == brute(rows, 4, 3) and found.count() == len(brute(rows, 4, 3))


def test_shares_are_exact_beyond_longs(spark):
    row = spark.sql("select 9000000000000000000L as c, cast(9000000000000000001 as decimal(20,0)) as n, 3L as v").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()
    assert row[0] == 1 + 1_000_000_000 * 9000000000000000002 // (9000000000000000001 + 6)


def test_edge_tables(spark):
    assert divergence.audit_sources(docs(spark, []).limit(0)).count() == 0
    assert divergence.audit_sources(docs(spark, ["one source alone"] * 3)).count() == 0
    two = spark.createDataFrame([(1, None, None, "x"), (2, "", None, None), (2, "", None, None)], SCHEMA)
    assert sorted(map(tuple, divergence.audit_sources(two).collect())) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]
    frame = clashing(edge_docs(spark), "term", "terms", "counts", "place", "p")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in frame.collect()]
    assert {tuple(r) for r in divergence.audit_sources(frame, 1).collect()} == brute(rows, 1)
