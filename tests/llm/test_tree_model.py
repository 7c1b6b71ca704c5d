import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelattice.llm import tree_model as model
from tests.llm.helpers import SF, clashing, docs, edge_docs, remainder

DEPTH = 2


def log_estimate(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


def brute_scores(training, texts, depth=DEPTH):
    """Context-tree weighting written out for small texts."""
    counts = {}
    stream = lambda t: bytes([model.START]) * depth + t.encode() + bytes([model.END])
    for text in training:
        s = stream(text)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for k in range(8):
                    counts.setdefault((s[i - d : i], 1 << k | s[i] >> 8 - k), [0, 0])[s[i] >> 7 - k & 1] += 1

    def weighted(context, node):
        if (context, node) not in counts:
            return 0.0
        own = log_estimate(*counts[context, node])
        if len(context) == depth:
            return own
        longer = sum(weighted(bytes([b]) + context, node) for b in range(256))
        return math.log(0.5) + max(own, longer) + math.log1p(math.exp(-abs(own - longer)))

    def ones(context, node, d=0):
        part = context[len(context) - d :]
        if (part, node) not in counts:
            return 0.5
        zeros, n = counts[part, node]
        estimate = (n + 0.5) / (zeros + n + 1)
        if d == depth:
            return estimate
        own = math.exp(math.log(0.5) + log_estimate(zeros, n) - weighted(part, node))
        return own * estimate + (1 - own) * ones(context, node, d + 1)

    out = []
    for text in texts:
        s = stream(text)
        total = 0.0
        for i in range(depth, len(s)):
            for k in range(8):
                p = ones(s[i - depth : i], 1 << k | s[i] >> 8 - k)
                total += math.log10(p if s[i] >> 7 - k & 1 else 1 - p)
        out.append(total)
    return out


def brute_base(training, text):
    tokens = lambda t: [*t.encode().lower().split(), b""]
    counts = Counter(w for t in training for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    return sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(text)), sum(counts[w] > 0 for w in tokens(text)), total


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_against_the_definition(spark, depth):
    training = ["abab", "abba c", "The end", ""]
    fresh = ["zab", "The ab éà", "ab" * 20, ""]
    frame = docs(spark, training + fresh)
    rows = {r.doc_id: r for r in model.score_texts(frame, F.col("doc_id") <= 4, depth=depth, block_bytes=30).collect()}
    for i, (text, score) in enumerate(zip(training + fresh, brute_scores(training, training + fresh, depth)), 1):
        base, known, total = brute_base(training, text)
        assert rows[i].score == pytest.approx(score, abs=1e-5)
        assert rows[i].base_score == pytest.approx(base, abs=1e-9)
        assert (rows[i].n_known, rows[i].train_tokens, rows[i].n_bytes) == (known, total, len(text.encode()))


def test_parts_and_joined_words_change_nothing(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    training = model.in_training(F.col("doc_id"), 5, 1)
    whole = {r.doc_id: r for r in model.score_texts(frame, training, depth=3).collect()}
    parts = {r.doc_id: r for r in model.score_texts(frame, training, depth=3, block_bytes=3000, frequent_words=100).collect()}
    assert whole.keys() == parts.keys()
    for i, row in whole.items():
        assert parts[i].score == pytest.approx(row.score, abs=1e-6) and parts[i].base_score == pytest.approx(row.base_score, abs=1e-7)
        assert (parts[i].n_known, parts[i].n_tokens) == (row.n_known, row.n_tokens)


def test_shuffled_rows_and_slices_change_nothing(spark, monkeypatch):
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 40")
    training = model.in_training(F.col("doc_id"), 5, 1)
    whole = {r.doc_id: r.score for r in model.score_texts(frame, training, depth=4).collect()}
    dealt = {r.doc_id: r.score for r in model.score_texts(frame.repartition(7, F.rand(3)), training, depth=4, block_bytes=5000).collect()}
    assert whole.keys() == dealt.keys() and all(dealt[i] == pytest.approx(whole[i], abs=1e-3, rel=1e-6) for i in whole)
    texts = ["", "abc", "é" * 40, "", "xyz " * 20]
    column = lambda *t: pa.chunked_array([pa.array(t, pa.string())])
    grams = np.unique(np.concatenate(list(model.byte_grams(column(*texts), 3)[1])))
    lengths = model.Lengths(grams, np.arange(len(grams), dtype=np.float32))
    want = [sum(float(lengths.of(g).sum()) for g in model.byte_grams(column(t), 3)[1]) for t in texts]
    monkeypatch.setattr(model, "AT_ONCE", 7)
    bits, sizes = model.text_bits(column(*texts), lengths, 3)
    assert bits.tolist() == want and sizes.tolist() == [len(t.encode()) + 1 for t in texts]


def test_query_learns_from_its_training_rows_only(spark):
    rows = model.op9_context_tree_score(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    training = [t for i, t in texts.items() if remainder(i, 5) != 1]
    for row in rows[:20]:
        base, known, total = brute_base(training, texts[row.doc_id])
        assert row.base_score == pytest.approx(base, rel=1e-9) and (row.n_known, row.train_tokens) == (known, total)
    assert np.mean([r.bits_a_byte for r in rows]) < 3.5 and all(r.score < 0 for r in rows)


def test_edges(spark):
    frame = clashing(edge_docs(spark), "score", "row", "n_tokens")
    rows = model.score_texts(frame, F.lit(True), depth=2).collect()
    assert len(rows) == 9
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].n_tokens == 1 and by_id[2].n_bytes == 0 and by_id[2].score == by_id[3].score
    nothing = model.score_texts(frame, F.lit(False), depth=2).collect()
    assert all(r.score == pytest.approx(-8 * (r.n_bytes + 1) * math.log10(2)) and r.n_known == 0 for r in nothing)
    assert model.score_texts(docs(spark, ["a"]).limit(0), F.lit(True), depth=2).count() == 0
