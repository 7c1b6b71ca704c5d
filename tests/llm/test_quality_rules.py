import random

import numpy as np

from codelattice.llm import quality_rules as rules
from tests.llm.helpers import clashing, docs, edge_docs


def brute(text):
    words = text.encode().split()
    n = len(words)
    runs = lambda k: [tuple(words[i : i + k]) for i in range(n - k + 1)]

    def covered(k):
        all_runs = runs(k)
        many = {r for r in all_runs if all_runs.count(r) > 1}
        return len({i + j for i, r in enumerate(all_runs) if r in many for j in range(k)})

    longest = max((k for k in range(1, n) if len(set(runs(k))) < len(runs(k))), default=0)
    return n, covered(rules.WINDOW), covered(rules.PASSAGE), longest


def test_suffix_array_is_sorted():
    random.seed(1)
    words = np.array([random.randrange(3) for _ in range(200)])
    owner = np.repeat([0, 1, 2, 3], [50, 1, 99, 50])
    order, common = rules.suffix_order(words, owner)
    ends = [50, 51, 150, 200]
    suffixes = [(owner[i], tuple(words[i : ends[owner[i]]])) for i in order]
    assert suffixes == sorted(suffixes)
    for (a, x), (b, y), c in zip(suffixes, suffixes[1:], common[1:]):
        shared = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert c == (shared if a == b else 0)


def test_common_prefixes_of_structured_repeats():
    """Sequences that sums modulo powers of two can't tell apart."""
    words = np.array([bin(i).count("1") & 1 for i in range(4096)] + [1 - (bin(i).count("1") & 1) for i in range(4096)])
    owner = np.zeros(len(words), np.int64)
    order, common = rules.suffix_order(words, owner)
    text = bytes(words.astype(np.uint8))
    for a, b, c in zip(order, order[1:], common[1:]):
        assert text[a : a + c] == text[b : b + c] and text[a : a + c + 1] < text[b : b + c + 1]


def test_counts_against_brute_force():
    random.seed(2)
    texts = ["", " ", "a", "a " * 14, "a b " * 30, "x y z " * 15 + "end"]
    texts += [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(100)]
    found = rules._counts(texts)
    for i, text in enumerate(texts):
        assert tuple(found[c][i] for c in ("n_words", "n_repeat_words", "n_passage_words", "longest_repeat")) == brute(text)


def test_edges_and_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(100))
    passage = " ".join(f"say{i}" for i in range(45))
    frame = docs(spark, [clean, passage + " " + " ".join(f"w{i}" for i in range(400)) + " " + passage, "dup\nline\ndup\n\n\n \n#$ line\nline"])
    rows = {r.doc_id: r for r in rules.count_rules(frame).collect()}
    assert rows[1].kept and not rows[1].base_failed
    assert not rows[2].kept and not rows[2].base_failed and rows[2].longest_repeat == 45
    assert (rows[3].n_dup_lines, rows[3].n_symbols, rows[3].word_chars, rows[3].base_failed) == (2, 2, 20, True)
    edge = {r.doc_id: r for r in rules.count_rules(clashing(edge_docs(spark), "kept", "n_words", "row")).collect()}
    assert edge[2].n_words == 0 and not edge[2].kept and edge[5].base_failed and edge[6].n_words == 1
    assert rules.count_rules(docs(spark, ["a"]).limit(0)).count() == 0
