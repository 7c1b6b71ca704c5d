import random

import pytest
import sentencepiece

from codelattice.llm import bpe
from tests.llm.helpers import SF, clashing, docs, edge_docs


@pytest.fixture(scope="module")
def both():
    return bpe.PrefixTable(*bpe.vocabulary(bpe.model_path())), sentencepiece.SentencePieceProcessor(model_file=bpe.model_path())


def same(both, text):
    ids = both[1].encode(text)
    n, joined, decoded = both[0].encode(text)
    assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), both[1].decode(ids))
    assert both[0].decode(ids) == decoded


def test_random_texts(both):
    random.seed(5)
    letters = "ab eét\n\t  ▁▁1,日本語中文😀x—“  ΩжЖ\x00\x01"
    for _ in range(1500):
        same(both, "".join(random.choice(letters) for _ in range(random.randint(0, 60))))


def test_blank_runs_and_long_words(both):
    for n in range(40):
        same(both, " " * n)
        same(both, " " * n + "word" + " " * (n // 2))
    same(both, "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)))


def test_pair_test_agrees_with_plain_merging(both):
    table = both[0]
    assert table.ordered
    random.seed(6)
    pieces = [p for p in table.score if p.strip("▁")]
    for _ in range(4000):
        left, right = random.choice(pieces), random.choice(pieces)
        if right.startswith("▁"):
            continue
        assert table.compatible(left, right) == (table.merged(left + right) == [left, right])


def test_documents(spark, both):
    import hashlib

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in bpe.op10_subword_codec(spark, SF).collect()}
    assert len(found) == len(rows)
    for row in rows:
        ids = both[1].encode(row.text)
        assert found[row.doc_id].n_tokens == len(ids)
        assert found[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[row.doc_id].decoded_sha256 == hashlib.sha256(both[1].decode(ids).encode()).hexdigest()


def test_edges(spark):
    frame = clashing(edge_docs(spark), "n_tokens", "row", "ids")
    rows = {r.doc_id: r for r in bpe.encode_texts(frame, bpe.model_path(), keep_text=True).collect()}
    assert rows[2].n_tokens == 0 and rows[2].ids == "" and rows[2].decoded == ""
    assert rows[3].n_tokens == 0 and rows[7].decoded.startswith("日本語") and rows[7].row == "was here"
    assert bpe.encode_texts(docs(spark, ["a"]).limit(0), bpe.model_path()).count() == 0
