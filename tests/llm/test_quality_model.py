import numpy as np
import pytest
from pyspark.sql import functions as F

from codelattice.llm import quality_model as model
from tests.llm.helpers import clashing, docs, edge_docs, remainder


def loss(network, chunks, owner, labels):
    out, _ = network.responses(chunks)
    counts = np.bincount(owner)
    pooled = np.zeros((len(labels), 2 * model.FILTERS), np.float64)
    np.maximum.at(pooled[:, : model.FILTERS], owner, out.max(1))
    np.add.at(pooled[:, model.FILTERS :], owner, out.mean(1) / counts[owner][:, None])
    p = network.probability(pooled)
    return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    network = model.ByteNetwork()
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    chunks = rng.integers(0, 257, (3, model.CHUNK)).astype(np.int16)
    owner, labels = np.array([0, 0, 1]), np.array([1.0, 0.0])
    grads = network.gradients(chunks, owner, labels)
    for name in network.weights:
        flat = network.weights[name].reshape(-1)
        for at in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old, step = flat[at], 1e-5
            flat[at] = old + step
            up = loss(network, chunks, owner, labels)
            flat[at] = old - step
            down = loss(network, chunks, owner, labels)
            flat[at] = old
            assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * step), abs=2e-4, rel=2e-2)


def test_slices_of_chunks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    network = model.ByteNetwork()
    chunks, owner, labels = rng.integers(0, 257, (9, model.CHUNK)).astype(np.int16), np.array([0, 0, 0, 0, 0, 1, 2, 2, 2]), np.array([1, 0, 1], np.float32)
    whole = network.gradients(chunks, owner, labels)
    monkeypatch.setattr(model, "SLICE_CHUNKS", 2)
    for name, part in network.gradients(chunks, owner, labels).items():
        assert np.allclose(part, whole[name], atol=1e-5), name


def test_scores_by_plain_loops():
    network = model.ByteNetwork(seed=7)
    w = {k: v.astype(float) for k, v in network.weights.items()}
    for text in ("", "short", "Longer text, é ü. " * 90):
        data = text.encode()
        step, top, means = model.CHUNK - model.OVERLAP, np.zeros(model.FILTERS), []
        starts = [0] + [i for i in range(step, len(data), step) if i + model.OVERLAP < len(data)]
        for start in starts:
            chunk = [b + 1 for b in data[start : start + model.CHUNK]]
            chunk += [0] * (model.CHUNK - len(chunk))
            found = [np.maximum(np.concatenate([w["table"][b] for b in chunk[i : i + model.WIDTH]]) @ w["filters"] + w["bias"], 0) for i in range(0, model.CHUNK - model.WIDTH + 1, model.STRIDE)]
            top, means = np.maximum(top, np.max(found, 0)), [*means, np.mean(found, 0)]
        z = np.concatenate([top, np.mean(means, 0)]) @ w["top"] + w["offset"][0]
        assert network.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_training_reads_whole_texts_within_its_bounds(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(model.ByteNetwork, "fit", lambda self, texts, labels: taken.append(sorted(zip(labels.tolist(), map(len, texts)))))
    frame = docs(spark, ["a" * 5000, "b" * 70, "c" * 9000, "d" * 40, None, "f" * 60])
    labels = spark.createDataFrame([(i, int(i > 3), 0) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    model.learn(frame, labels)
    model.learn(frame, labels, bytes_a_label=6000)
    model.learn(frame, labels, rows_a_label=1)
    assert taken[0] == [(0.0, 70), (0.0, 5000), (0.0, 9000), (1.0, 0), (1.0, 40), (1.0, 60)]
    assert set(taken[1]) == {(0.0, 70), (0.0, 5000), (1.0, 0), (1.0, 40), (1.0, 60)}
    assert len(taken[2]) == 2


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 1023, 1024, 1025, 5000, 9920):
        data = bytes(i % 251 + 1 for i in range(n))
        chunks = model.chunks_of(data)
        step = model.CHUNK - model.OVERLAP
        back = np.zeros(len(chunks) * step + model.OVERLAP, np.int64)
        for i, chunk in enumerate(chunks):
            back[i * step : i * step + model.CHUNK] = chunk
        assert (back[:n] == np.frombuffer(data, np.uint8).astype(int) + 1).all() and (back[n:] == 0).all()


def test_the_end_of_a_long_text_counts():
    network = model.ByteNetwork()
    base = "plain words " * 30_000
    one, other = network.scores([base + "end", base + "###&&&***"])
    assert one != other


def test_batches_do_not_matter():
    network = model.ByteNetwork()
    texts = ["", "a", "short text", "long " * 3000, "x" * 5000]
    together = network.scores(texts)
    assert np.allclose(together, [network.scores([t])[0] for t in texts], atol=1e-6)


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = model.op8_quality_model(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in found)
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.98


def test_edges(spark):
    frame = clashing(edge_docs(spark), "score", "row", "quality")
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, None, 0), (None, 0, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    rows = model.score_quality(frame, labels, F.lit(True)).collect()
    assert len(rows) == 9 and len({round(r.score, 9) for r in rows}) == 1 and rows[0].score > 0.9
    none = model.score_quality(frame, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    assert model.score_quality(docs(spark, ["a"]).limit(0), labels, F.lit(True)).count() == 0
