import random
from fractions import Fraction

import numpy as np
import pandas as pd

import corpus_pipeline
from codelattice.llm import similar, simhash
from tests.llm.helpers import clashing, docs, edge_docs
from tests.llm.test_simhash import brute_fingerprint, roots


def corpus():
    """Originals with copies from 0.7 to 1 alike, among them texts of frequent passages, and short ones."""
    random.seed(11)
    word = lambda: f"w{random.randrange(4000)}"
    passages = [[word() for _ in range(30)] for _ in range(4)]
    texts = []
    for i in range(25):
        own = [word() for _ in range(random.randrange(40, 200))] + (passages[i % 4] if i % 3 else passages[0] + passages[1] + passages[2])
        texts.append(own)
        for _ in range(3):
            copy = list(own)
            for _ in range(random.randrange(0, 1 + len(own) // 35)):
                copy[random.randrange(len(copy))] = word()
            texts.append(copy + [word() for _ in range(random.randrange(0, len(own) // 8))])
    texts += [["a", "b"], ["a", "b"], ["a", "b", "c"], ["x"] * 9, ["x"] * 90]
    return [" ".join(t) for t in texts]


def jaccard(one, other):
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    a, b = runs(one.split()), runs(other.split())
    return Fraction(len(a & b), len(a | b))


def brute(texts):
    codes = [brute_fingerprint(t) for t in texts]
    every = [(i, j) for i in range(len(texts)) for j in range(i)]
    alike = {p for p in every if jaccard(texts[p[0]], texts[p[1]]) >= Fraction(4, 5)}
    close = {p for p in every if bin(codes[p[0]] ^ codes[p[1]]).count("1") <= 3}
    return roots(range(len(texts)), alike | close), roots(range(len(texts)), close)


def test_against_brute_force(spark):
    texts = corpus()
    want, by_radius = brute(texts)
    assert want != by_radius  # pairs that the radius alone does not link
    found = {r.doc_id - 1: r.component_id - 1 for r in similar.near_duplicates(docs(spark, texts)).collect()}
    assert found == want
    left = {r.doc_id - 1 for r in corpus_pipeline.dedup_documents(spark, docs(spark, texts), "").collect()}
    assert left == {i for i in want if want[i] == i}
    assert left < {r.doc_id - 1 for r in simhash.drop_near_duplicates(docs(spark, texts)).collect()}


def test_pairs_of_a_key_are_bounded_by_size():
    exact = Fraction(4, 5)
    rows = pd.DataFrame({"key": [1, 1, 1, 2, 2], "node": [1, 2, 3, 2, 1], "root": [1, 2, 3, 2, 1], "size": [10, 10, 13, 10, 10], "at": [0, 0, 0, 1, 1], "odd0": 0, "odd1": [0, 1, 0, 1, 0]})
    assert {(a, b) for f in similar._pairs(rows, exact) for a, b in f.itertuples(index=False)} == {(1, 2)}
    assert similar.least_common(np.array([9]), np.array([9]), exact)[0] == 8


def test_parities_bound_the_difference():
    random.seed(4)
    for _ in range(200):
        one = {random.getrandbits(64) for _ in range(random.randrange(1, 300))}
        other = {x for x in one if random.random() < 0.8} | {random.getrandbits(64) for _ in range(random.randrange(40))}
        a, b = (similar.parities(np.array(sorted(x), np.uint64)) for x in (one, other))
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(one ^ other)
        c, d = (np.frombuffer(similar.bucket_counts(np.array(sorted(x), np.uint64)), np.uint8).astype(int) for x in (one, other))
        assert np.abs(c - d).sum() <= len(one ^ other)
    rows = pd.DataFrame({"key": 1, "node": [1, 2], "root": [1, 2], "size": [10, 10], "at": 0, "odd0": [0, 7], "odd1": 0})
    assert not list(similar._pairs(rows, Fraction(4, 5)))


def test_edges(spark):
    frame = clashing(edge_docs(spark), "node", "root", "key")
    rows = similar.near_duplicates(frame).collect()
    assert len(rows) == 9
    assert similar.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def test_texts_that_share_a_passage_are_no_candidates(spark, monkeypatch):
    """Long texts, half alike, of which one has a copy that is nine tenths alike: too long for parities, and too rare for the sample."""
    monkeypatch.setattr(similar, "COMMON_MOST", 0)
    random.seed(8)
    word = lambda: f"w{random.randrange(10**6)}"
    passage = [word() for _ in range(400)]
    texts = [passage + [word() for _ in range(400)] for _ in range(24)]
    texts.append(texts[5][:770] + [word() for _ in range(30)])
    exact, of = Fraction(4, 5), {similar.text_node(" ".join(t)): i for i, t in enumerate(texts)}
    signed = similar.signatures(docs(spark, [" ".join(t) for t in texts]), 5, exact)
    found = similar.candidates(signed.withColumn("root", signed.node), exact).collect()
    assert {frozenset((of[r.a], of[r.b])) for r in found} == {frozenset((5, 24))}


def test_rows_of_a_key_are_left_once():
    rows = pd.DataFrame({"key": [1] * 6 + [2], "node": range(7), "root": range(7), "size": [10] * 5 + [90, 10], "at": 0, "odd0": 0, "odd1": 0})
    (left,) = similar._open(rows, Fraction(4, 5))
    assert left.node.tolist() == [0, 1, 2, 3, 4]
    assert sum(map(len, similar._pairs(rows, Fraction(4, 5)))) == 10
    same = rows.assign(counts=[bytes(similar.BUCKETS)] * 4 + [bytes([9]) * similar.BUCKETS] * 3)
    assert sum(map(len, similar._pairs(same, Fraction(4, 5)))) == 6
