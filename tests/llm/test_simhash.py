import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from codelattice.llm import simhash
from codelattice.llm.components import connected_components
from tests.llm.helpers import SF, clashing, docs, edge_docs


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_fingerprint(text, size=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, radius=3):
    return roots(range(len(codes)), [(i, j) for i in range(len(codes)) for j in range(i) if bin(codes[i] ^ codes[j]).count("1") <= radius])


def near_codes(seed, groups, size):
    random.seed(seed)
    codes = set()
    for _ in range(groups):
        code = random.getrandbits(64)
        for _ in range(random.randint(1, size)):
            codes.add(code)
            for _ in range(random.randint(1, 3)):
                code ^= 1 << random.randrange(64)
    return sorted(codes)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all(seed):
    codes = np.array(near_codes(seed, 6, 120), np.uint64)
    index = simhash.GrayIndex(codes)
    query, leaf = index.search(codes, 3)
    found = {(int(codes[q]), int(index.codes[n])) for q, n in zip(query, leaf)}
    assert found == {(int(a), int(b)) for a in codes for b in codes if bin(int(a) ^ int(b)).count("1") <= 3}


def test_index_with_shared_bits():
    codes = np.array(near_codes(3, 6, 120), np.uint64)
    shared = simhash.agreeing_masks(list(range(64)), 3, 2)[4]
    index = simhash.GrayIndex(codes, shared=shared)
    query, leaf = index.search(codes, 3)
    near = lambda a, b: bin(a ^ b).count("1") <= 3 and not (a ^ b) & shared
    assert {(int(codes[q]), int(index.codes[n])) for q, n in zip(query, leaf)} == {(a, b) for a in map(int, codes) for b in map(int, codes) if near(a, b)}


def test_masks_leave_no_pair_out():
    random.seed(5)
    for bits, agreeing in ((list(range(64)), 2), (list(range(11, 49)), 3)):
        masks = simhash.agreeing_masks(bits, 3, agreeing)
        for _ in range(500):
            apart = sum(1 << b for b in random.sample(bits, 3))
            assert any(not apart & m for m in masks)


def test_every_link_comes_from_the_index(monkeypatch):
    codes = np.array(near_codes(2, 9, 30), np.uint64).view(np.int64)
    mask = simhash.agreeing_masks(list(range(64)), 3, 2)[0]
    frame = pd.DataFrame({"fp": codes, "mask": mask, "pattern": codes & mask, "p": 0, "q": 0, "side": 0}).sort_values("pattern")
    assert sum(len(f) for f in simhash._cells(frame, 3)) > 0
    monkeypatch.setattr(simhash.GrayIndex, "search", lambda self, queries, radius, skip=None: (np.zeros(0, np.int64),) * 2)
    assert sum(len(f) for f in simhash._cells(frame, 3)) == 0


@pytest.mark.parametrize("cell_rows", [20_000, 60, 7])
def test_links_connect_the_same_components(spark, cell_rows):
    codes = near_codes(11, 8, 60)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.hamming_links(frame, cell_rows=cell_rows).collect()]
    place = {c: i for i, c in enumerate(signed)}
    assert roots(range(len(codes)), [(place[a], place[b]) for a, b in links]) == brute_components(codes)


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 501), (502, 501), (7, 7), (900, 900), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 502: 500, 900: 900}


def test_documents_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    codes = [brute_fingerprint(text) for _, text in rows]
    root = brute_components(codes)
    found = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op3_simhash_components(spark, SF).collect()}
    assert found == {rows[i][0]: (codes[i], rows[root[i]][0]) for i in range(len(rows))}


def test_edges(spark):
    frame = clashing(edge_docs(spark), "fp", "component_id", "root")
    rows = simhash.near_duplicates(frame).collect()
    assert len(rows) == 9
    zero = {r.doc_id: r for r in rows if r.fp == 0}
    assert set(zero) >= {2, 3, 4} and all(zero[i].component_id == 2 for i in (2, 3, 4))
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert simhash.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def test_many_near_copies_stay_one_group(spark):
    base = [f"word{i}" for i in range(300)]
    texts = [" ".join(base[:150] + [f"mark{i % 40}"] + base[150:]) for i in range(120)] + ["something else entirely with other words " * 5]
    found = simhash.near_duplicates(docs(spark, texts)).collect()
    codes = [brute_fingerprint(t) for t in texts]
    root = brute_components(codes)
    assert {r.doc_id: r.component_id for r in found} == {i + 1: root[i] + 1 for i in range(len(texts))}
