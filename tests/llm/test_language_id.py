import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from codelattice.llm import language_id
from tests.llm.helpers import SF, clashing, docs, edge_docs, remainder

ENGLISH = "the cat and the dog were walking through the long street with their old friends this evening"
GERMAN = "der hund und die katze gingen durch die lange strasse mit ihren alten freunden an diesem abend"
GREEK = "η γάτα και ο σκύλος περπατούσαν στον μακρύ δρόμο με τους παλιούς φίλους τους απόψε"


def corpus(spark):
    texts, langs = [], []
    for i in range(8):
        for lang, text in (("en", ENGLISH), ("de", GERMAN), ("el", GREEK)):
            parts = text.split()
            texts.append(" ".join(parts[i:] + parts[:i])), langs.append(lang)
    return docs(spark, texts, langs)


def brute_path(scores, penalty):
    best, paths = None, []
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        total = sum(scores[t, s] for t, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        if best is None or total > best + 1e-9:
            best, paths = total, [path]
        elif abs(total - best) <= 1e-9:
            paths.append(path)
    return paths


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    scores = [(-6 * rng.random((n, 3))).astype(np.float32) for n in (0, 1, 2, 5, 6, 6, 7)]
    for one, path in zip(scores, language_id.best_paths(scores, 2.0)):
        if len(one):
            assert tuple(path) in brute_path(one.astype(float), 2.0)
        else:
            assert len(path) == 0


def test_spans_of_mixed_text(spark):
    known = corpus(spark)
    mixed = docs(spark, [f"{ENGLISH}. {GERMAN}", GREEK, "123 !!", None, "", "中文"], first_id=500)
    both = known.union(mixed)
    rows = {r.doc_id: r for r in language_id.identify(both, F.col("doc_id") < 500).collect()}
    assert [s.lang for s in rows[500].spans] == ["en", "de"]
    assert [s.first_word for s in rows[500].spans] == [0, len(ENGLISH.split())]
    assert rows[501].lang_pred == "el" and 0.9 < rows[501].score <= 1
    assert 0.3 < rows[500].score < 0.6
    for i in (502, 503, 504):
        assert (rows[i].lang_pred, rows[i].score, rows[i].spans) == ("und", 0.0, [])
    assert rows[505].lang_pred in ("en", "de", "el") and rows[505].score == 0
    assert all(rows[i].lang_pred == lang for i, lang in zip(range(1, 25), ["en", "de", "el"] * 8))


def brute(rows, penalty):
    """lang_pred and score of (doc_id, text, lang): plain counting of the same sequences and Viterbi word by word."""
    counts, letters = {}, {}
    for i, text, lang in rows:
        if text is None or lang is None or remainder(i, 4) == 2:
            continue
        own, scripts = counts.setdefault(lang, {}), letters.setdefault(lang, {})
        for word in language_id.words_of(text):
            for bucket in language_id.sequences([word])[0]:
                own[int(bucket)] = own.get(int(bucket), 0) + 1
            script = int(language_id.script_of([word])[0])
            scripts[script] = scripts.get(script, 0) + len(word)
    names = sorted(counts)
    totals = {n: math.log(sum(counts[n].values()) + 0.5 * language_id.BUCKETS) for n in names}
    known = {}

    def word_scores(word):
        if word not in known:
            script = int(language_id.script_of([word])[0])
            uses = [letters[n].get(script, 0) >= 0.01 * sum(letters[n].values()) for n in names]
            each = [sum(math.log(counts[n].get(int(b), 0) + 0.5) - totals[n] for b in language_id.sequences([word])[0]) if u else -math.inf for n, u in zip(names, uses)]
            known[word] = ([x - max(each) for x in each] if any(uses) else [0.0] * len(names), any(uses))
        return known[word]

    out = {}
    for i, text, _ in rows:
        words = language_id.words_of(text or "")
        if not any(c.isalpha() for w in words for c in w):
            out[i] = ("und", 0.0)
            continue
        sums, back = list(word_scores(words[0])[0]), []
        for word in words[1:]:
            top = max(range(len(names)), key=lambda s: (sums[s], -s))
            came = [s if sums[s] >= sums[top] - penalty else top for s in range(len(names))]
            sums = [max(sums[s], sums[top] - penalty) + x for s, x in enumerate(word_scores(word)[0])]
            back.append(came)
        state = max(range(len(names)), key=lambda s: (sums[s], -s))
        path = [state]
        for came in reversed(back):
            path.append(state := came[state])
        weight = [sum(map(str.isalpha, w)) for w in words]
        share = [sum(n for w, n, s in zip(words, weight, reversed(path)) if s == lang and word_scores(w)[1]) / sum(weight) for lang in range(len(names))]
        top = share.index(max(share))
        mine = [w for w, s in zip(words, reversed(path)) if s == top and word_scores(w)[1]]
        mean = [sum(max(word_scores(w)[0][s], -30.0) for w in mine) / max(1, len(mine)) for s in range(len(names))]
        out[i] = names[top], share[top] / sum(math.exp(m - mean[top]) for m in mean)
    return out


def test_registered_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows, language_id.SWITCH_PENALTY)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.op4_language_id(spark, SF).collect()}
    assert {i: x[0] for i, x in found.items()} == {i: x[0] for i, x in want.items()}
    assert max(abs(found[i][1] - want[i][1]) for i in want) < 2e-3


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = language_id.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if remainder(r.doc_id, 4) == 2}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_edges(spark):
    frame = clashing(edge_docs(spark), "score", "spans", "row")
    rows = language_id.identify(frame, F.lit(True)).collect()
    assert len(rows) == 9 and all(r.row == "was here" for r in rows)
    nothing = language_id.identify(frame, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    kept = language_id.drop_unidentified(frame)
    assert kept.columns == frame.columns and {2, 3, 4}.isdisjoint({r.doc_id for r in kept.collect()})
    unlabelled = language_id.drop_unidentified(frame.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(map(str, unlabelled.collect())) == sorted(map(str, frame.withColumn("lang", F.lit(None).cast("string")).filter("doc_id is null or doc_id not in (2, 3, 4)").collect()))
    assert language_id.identify(docs(spark, ["a"]).limit(0), F.lit(True)).count() == 0
