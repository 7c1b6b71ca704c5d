import math
import random
import re

import pytest

from codelattice.llm import license_scan
from tests.llm.helpers import SF, clashing, docs, edge_docs

WORDS = re.compile(license_scan.WORD)


def words_of(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def places(words, phrase):
    parts = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(parts)] == parts]


def brute(texts):
    """(base places, {label: share}) of each text; every place of every text is tried for every notice."""
    cut, index = [words_of(t) for t in texts], license_scan.postings()
    weight = {p.word: 1000 + math.floor(1000 * math.log((len(cut) + 1) / (sum(p.word in w for w in cut) + 1))) for p in index}
    out = []
    for words in cut:
        base = sorted((i, label) for phrase, label in license_scan.BASE.items() for i in places(words, phrase))
        labels = {}
        for notice, (label, text, phrases) in enumerate(license_scan.NOTICES):
            own = [p for p in index if p.notice == notice]
            total = sum(weight[p.word] for p in own)
            by_weight = sorted(own, key=lambda p: (-weight[p.word], p.at))
            rare = [p for i, p in enumerate(by_weight) if 100 * sum(weight[q.word] for q in by_weight[i:]) >= license_scan.SHARE * total]
            within = lambda i, at, begin: abs(i - at - begin) <= license_scan.SLACK
            for begin in range(-60, len(words)):
                if not any(0 <= begin + p.at < len(words) and words[begin + p.at] == p.word for p in rare):
                    continue
                held = sum(weight[p.word] for p in own if any(w == p.word and within(i, p.at, begin) for i, w in enumerate(words)))
                if 100 * held >= license_scan.SHARE * total and all(any(within(i, places(words_of(text), k)[0], begin) for i in places(words, k)) for k in phrases):
                    labels[label] = max(labels.get(label, 0), held * 10000 // total / 10000)
        out.append((base, labels))
    return out


def drawn(seed=11, n=60):
    draw = random.Random(seed)
    filler = "license mit public use software cc by all rights version 2 house green été free copy General".split()
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randrange(4)):
            notice = words_of(draw.choice(license_scan.NOTICES)[1])
            for _ in range(draw.randrange(3)):
                at = draw.randrange(len(notice))
                notice[at : at + draw.randrange(2)] = [draw.choice(filler)]
            parts += [draw.choice(filler) for _ in range(draw.randrange(6))] + notice
        texts.append(draw.choice([" ", "\n * ", ", "]).join(parts))
    return texts


def test_against_every_place_of_every_notice(spark):
    texts = [*drawn(), "CC BY cc by, All Rights\nReserved. all rights. reserved", "Licensed under CC BY-NC 4.0.", "The MIT License", None, "mit " * 50]
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert len(found) == len(texts)
    some = set()
    for i, (base, labels) in enumerate(brute(texts), 1):
        assert sorted(map(tuple, found[i].base)) == base
        assert {x.label: x.share for x in found[i].licenses} == labels
        some |= labels.keys()
        assert found[i].n_words == len(words_of(texts[i - 1]))
    assert len(some) > 12


@pytest.mark.parametrize("label", sorted({n[0] for n in license_scan.NOTICES}))
def test_each_notice_is_found_and_needs_its_phrases(spark, label):
    own = [n for n in license_scan.NOTICES if n[0] == label]
    whole = [f"// some words before\n// {text.upper()}\n and more" for _, text, _ in own]
    broken = [text.lower().replace(phrases[-1].split()[-1], "xyz") for _, text, phrases in own]
    rows = license_scan.scan_licenses(docs(spark, [*whole, *broken])).orderBy("doc_id").collect()
    for i in range(len(own)):
        assert label in {x.label for x in rows[i].licenses}
        assert label not in {x.label for x in rows[len(own) + i].licenses}


def test_edge_rows_and_clashing_names(spark):
    frame = clashing(edge_docs(spark), "words", "hits", "n_words", "base", "_row", "licenses", "label")
    rows = license_scan.scan_licenses(frame).collect()
    assert len(rows) == frame.count() and all(r.licenses == [] and r.base == [] and r.label == "was here" for r in rows)
    assert {r.doc_id: r.n_words for r in rows}[2] == 0
    assert license_scan.scan_licenses(docs(spark, []).limit(0)).count() == 0
    many = license_scan.scan_licenses(docs(spark, ["Released under the MIT License. " * 5000])).first()
    assert [(x.label, x.share, x.first, x.last) for x in many.licenses] == [("mit", 1.0, 0, 24999)]


def test_plan_has_no_python(spark):
    rows = license_scan.stored(docs(spark, ["a"]).selectExpr("1L as _row", "array(named_struct('pos', 1, 'word', 'mit', 'phrases', array('mit license'))) as hits"))
    plan = license_scan._found(rows, license_scan._weighed(license_scan.postings(), {}, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    source = open(license_scan.__file__).read()
    assert "udf" not in source and "mapIn" not in source and "rdd" not in source


def test_query_shape(spark):
    frame = license_scan.op13_license_scan(spark, SF)
    assert frame.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
