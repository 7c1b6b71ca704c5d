import random
from collections import Counter

import numpy as np
import pytest

from codelattice.llm import decontaminate
from tests.llm.helpers import SF, clashing, docs, edge_docs

ITEM = "item_id long, text string"


def words(seed, n, pool=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def similarity(window, item):
    runs = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    return decontaminate.weighted_similarity(runs(window), runs(item))


def brute(texts, items, least=0.8):
    import re

    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    out = set()
    for d, text in enumerate(texts, 1):
        have = split(text)
        for i, item in enumerate(items, 1):
            want = split(item)
            if want and any(similarity(have[s : s + len(want)], want) >= least for s in range(len(have) - len(want) + 1)):
                out.add((d, i))
    return out


def test_exact_near_and_clean(spark):
    items = [" ".join(words(i, n)) for i, n in enumerate((15, 30, 50, 50, 4, 1, 80))] + ["", None]
    texts = []
    for i, item in enumerate(items[:7]):
        before, after = " ".join(words(100 + i, 40)), " ".join(words(200 + i, 60))
        texts.append(f"{before}. {item.upper()}!\n{after}")
        changed = item.split()
        if len(changed) > 20:
            changed[len(changed) // 2] = "changed"
            texts.append(f"{before} {' '.join(changed)} {after}")
            changed[3] = changed[10] = changed[-4] = "different"
            texts.append(f"{before} {' '.join(changed)} {after}")
    texts += [" ".join(words(900 + i, 300)) for i in range(10)] + ["", None, "w1"]
    benchmark = spark.createDataFrame(list(enumerate(items, 1)), ITEM)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, texts), benchmark).collect()}
    assert found == brute(texts, items)
    in_blocks = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, texts), benchmark, item_bytes=300).collect()}
    assert in_blocks == found


def test_documents_hold_what_a_search_for_text_finds(spark):
    split = lambda t: f" {' '.join(''.join(c if c.isalnum() else ' ' for c in t.lower()).split())} "
    rows = [(r.doc_id, split(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, split(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.op2_benchmark_leaks(spark, SF).collect()}
    assert {k for k, v in found.items() if v == 1} >= {(d, i) for d, text in rows for i, item in items if item in text}


@pytest.mark.parametrize("blocks", [2, 3, 4, 21])
def test_block_index_is_complete(blocks):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 300, dtype=np.uint64)
    queries = codes[:100].copy()
    for i in range(100):
        for bit in rng.choice(64, i % 24, replace=False):
            queries[i] ^= np.uint64(1 << int(bit))
    index = decontaminate.BlockIndex(codes, blocks, 20)
    found = set(zip(*map(list, index.near(queries))))
    assert found == {(q, i) for q in range(100) for i in range(300) if bin(int(queries[q] ^ codes[i])).count("1") <= 20}


def test_block_index_leaves_out_most():
    rng = np.random.default_rng(5)
    codes, queries = rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(0, 2**64, 500, dtype=np.uint64)
    query, _ = decontaminate.BlockIndex(codes, decontaminate.BLOCKS, decontaminate.RADIUS).candidates(queries)
    assert len(query) < 0.15 * 500 * 500


def test_block_index_looks_flips_up():
    """Small blocks full of values are probed by flips; what is found is what comparing finds."""
    rng = np.random.default_rng(7)
    codes, queries = rng.integers(0, 2**64, 8000, dtype=np.uint64), rng.integers(0, 2**64, 60, dtype=np.uint64)
    queries[:20] = codes[:20] ^ rng.choice(np.array([1, 5, 1 << 40, (1 << 18) - 1], np.uint64), 20)
    index = decontaminate.BlockIndex(codes, 4, 20)
    assert sum(t.flips is not None for t in index.tables) >= 3
    want = np.bitwise_count(queries[:, None] ^ codes) <= 20
    got = np.zeros_like(want)
    got[index.near(queries)] = True
    assert (got == want).all() and want.sum() > 60 and len(index.near(queries)[0]) == want.sum()


def test_openings_are_the_windows_with_enough_hits():
    rng = random.Random(2)
    for _ in range(200):
        hits = np.array(sorted(rng.sample(range(60), rng.randrange(25))), np.int64)
        per, least = rng.randrange(1, 12), rng.randrange(1, 6)
        want = [s for s in range(-per, 61) if ((hits >= s) & (hits < s + per)).sum() >= least]
        assert decontaminate.openings(hits, per, least).tolist() == want


def test_sieve_keeps_what_holds_items_and_little_else():
    items = [" ".join(words(i, n)) for i, n in enumerate((15, 30, 50, 4, 1))]
    sieve = decontaminate.Sieve(5, 0.8, 1 << 22)
    for item in items:
        sieve.add([item])
    near = items[2].split()
    near[20] = "changed"
    texts = [" ".join(words(50 + i, 90)) for i in range(20)] + [f"some before {' '.join(near)} after", items[1].rsplit(" ", 1)[0], items[3], "", items[4]]
    kept = sieve.may_hold(*decontaminate.hashed_words(texts))
    assert kept.tolist()[20:] == [True, True, True, False, True]
    assert kept[:20].sum() < 3


def test_radius_loses_nothing_here(spark):
    """With a radius of all 64 bits every window that holds a shingle is verified."""
    sf = "/root/testdata/sf0.01"
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    found = {(r.doc_id, r.item_id, r.first_word) for r in decontaminate.find_leaks(read("documents"), read("benchmark")).collect()}
    exact = {(r.doc_id, r.item_id, r.first_word) for r in decontaminate.find_leaks(read("documents"), read("benchmark"), radius=64, blocks=1).collect()}
    assert len(exact) > 20 and len(found & exact) >= 0.99 * len(exact)


def test_edges(spark):
    frame = clashing(edge_docs(spark), "item_id", "similarity")
    benchmark = clashing(spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "alpha beta gamma delta epsilon zeta eta theta"), (None, "some words in it"), (3, None)], ITEM), "size", "doc_id")
    found = sorted(((r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, benchmark).collect()), key=str)
    assert found == [(5, 1), (5, 1), (None, None)]
    kept = decontaminate.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns and 5 not in {r.doc_id for r in kept.collect()}
    assert decontaminate.find_leaks(docs(spark, ["a"]).limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(frame, benchmark.limit(0)).count() == 0


def test_texts_shorter_than_an_item(spark):
    items = [" ".join(words(i, n)) for i, n in enumerate((16, 30, 59, 59, 12, 5, 4))]
    texts = []
    for item in items:
        have = item.split()
        texts += [" ".join(have[:-1]), " ".join(have[1:]), " ".join(have[1:-1]), " ".join(have[: len(have) * 5 // 6]), " ".join(have[: len(have) // 2])]
    texts += [" ".join(words(700, 40)), "", None, " ".join(items[2].split()[:-1]) + " " + " ".join(words(701, 30))]
    benchmark = spark.createDataFrame(list(enumerate(items, 1)), ITEM)
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs(spark, texts), benchmark).collect()}
    want = brute(texts, items)
    for d, text in enumerate(texts, 1):
        have = (text or "").split()
        for i, item in enumerate(items, 1):
            if 0 < len(have) < len(item.split()) and similarity(have, item.split()) >= 0.8:
                want.add((d, i))
                assert (found[d, i].first_word, found[d, i].n_words) == (0, len(have))
                assert found[d, i].similarity == similarity(have, item.split())
    assert found.keys() == want and {(1, 1), (2, 1), (11, 3), (16, 4)} <= want
