import math

import numpy as np
import pytest

from codelattice.llm import whitening
from tests.llm.helpers import SF, clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, components=16, by_copies=False):
    """By the definition, with Python's integers for the exact part."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for i, v in kept}
    fit = list(x.values()) if by_copies else sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    centred = np.array([[(n * v[k] - sums[k]) / n for k in range(d)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > 1e-9][:components]
    out = {}
    for i, v in x.items():
        off = [n * v[k] - sums[k] for k in range(d)]
        z = np.array([o / n for o in off]) @ vectors[:, order] / np.sqrt(values[order])
        out[i] = (n, sum(o * o for o in off), z, values[order] / values.sum())
    return out


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)


def made(n=60, d=5, seed=3):
    draw = np.random.default_rng(seed)
    vectors = (draw.normal(size=(n, d)) * np.arange(1, d + 1)).astype(np.float32).tolist()
    return [*vectors, *(vectors[0] for _ in range(40)), vectors[1]]


def same(found, expected):
    assert found.keys() == expected.keys()
    if not found:
        return
    signs = None
    for i, (n, deviation, z, explained) in expected.items():
        row = found[i]
        assert (row.n, row.deviation) == (n, deviation)
        got = np.array(row.whitened)
        if signs is None and np.abs(z).min(initial=1) > 1e-3:
            signs = np.sign(got * z)
    for i, (_, _, z, explained) in expected.items():
        assert np.allclose(np.array(found[i].whitened) * signs, z, atol=1e-8)
        assert np.allclose(found[i].explained, explained, rtol=1e-8)
        assert found[i].identity_error < 1e-9


@pytest.mark.parametrize("by_copies", [False, True])
def test_against_the_definition(spark, by_copies):
    vectors = [*made(), None, [1.0, None, 2.0, 3.0, 4.0], [1.0, float("nan"), 2.0, 3.0, 4.0], [float("inf"), 0.0, 0.0, 0.0, 0.0]]
    found = {r.vec_id: r for r in whitening.whiten(table(spark, vectors), weigh_copies=by_copies).collect()}
    same(found, brute(list(enumerate(vectors)), by_copies=by_copies))
    assert found[0].copies == 41 and found[1].copies == 2


def test_query_against_the_definition(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    expected = brute([(r.vec_id, r.embedding) for r in rows])
    frame = whitening.op11_embedding_whitening(spark, SF)
    assert frame.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    by_row = {}
    for r in frame.orderBy("component").collect():
        by_row.setdefault(r.vec_id, []).append(r)
    assert by_row.keys() == expected.keys() and all([r.component for r in of] == list(range(1, 17)) for of in by_row.values())
    signs = np.sign([r.whitened * z for r, z in zip(by_row[rows[0].vec_id], expected[rows[0].vec_id][2], strict=True)])
    for i, (n, deviation, z, explained) in expected.items():
        assert all((r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-4 for r in by_row[i])
        assert np.allclose([r.whitened for r in by_row[i]] * signs, z, atol=1e-7) and np.allclose([r.explained for r in by_row[i]], explained, rtol=1e-8)


def test_wide_values_and_fewer_components(spark):
    vectors = [[0.0, 1e6, -3.0], [1e9, 2.0, 5.0], [-7.0, 1e-3, 2e10], [4.0, 4.0, 4.0], [1e3, -1e3, 0.5], [2.0**50, 0.0, 0.0]]
    usable = vectors[:-1]
    found = {r.vec_id: r for r in whitening.whiten(table(spark, vectors), components=2).collect()}
    expected = brute(list(enumerate([[float(np.float32(c)) for c in v] for v in usable])), 2)
    assert found.keys() == expected.keys()
    assert all(len(r.whitened) == 2 for r in found.values())
    assert all(found[i].deviation == (v[1] if v[1] < 2**63 else None) for i, v in expected.items())


def test_packing():
    x = np.array([[1, -1], [127, -128], [128, 0], [-40000, 3], [1 << 40, 0]], np.int64)
    keys = whitening.pack(x)
    assert [len(k) for k in keys] == [2, 2, 4, 8, 16]
    assert (whitening.unpack(keys, 2) == x).all()


def test_edge_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [None, [], [float("nan")]])).count() == 0
    alike = whitening.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert [(r.n, r.copies, r.deviation, r.whitened) for r in alike] == [(1, 3, 0, [])] * 3
    ragged = whitening.whiten(table(spark, [[1.0, 2.0], [2.0, 1.0], [5.0], [1.0, 2.0, 3.0]])).collect()
    assert sorted(r.vec_id for r in ragged) == [0, 1]
    rows = spark.createDataFrame([(None, [1.0, 2.0], 1), (7, [3.0, 1.0], 1), (7, [3.0, 1.0], 1)], SCHEMA)
    found = whitening.whiten(clashing(rows, "key", "weight", "copies", "n", "whitened")).collect()
    assert sorted(str(r.vec_id) for r in found) == ["7", "7", "None"]
    in_doubles = spark.createDataFrame([(1, [0.1, 0.25]), (2, [0.5, -0.1])], "vec_id string, embedding array<double>")
    assert sorted(r.vec_id for r in whitening.whiten(in_doubles).collect()) == ["1", "2"]
