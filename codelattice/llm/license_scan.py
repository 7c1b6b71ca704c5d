"""Licence notices in texts, by a positional index of the rare words of notices."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import finished, stored, table
from codelattice.llm.line_dedup import UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places count by themselves, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, words of the notice, phrases that it can't do without.
NOTICES = (
    ("agpl-3.0", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("bsd", "distributed under the BSD License", ("bsd license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0", ("cc0 1 0",)),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "license version 2")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "license version 3")),
    ("gpl", "free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("redistribute it and or modify", "gnu general public license")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy", "fee is hereby granted")),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted", "restriction")),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("zlib", "provided as-is, without any express or implied warranty. In no event will the authors be held liable", ("express or implied warranty", "held liable")),
)
#: Words that tell nothing and are in no posting. A phrase may hold them, but not begin with them.
FUNCTION_WORDS = frozenset("a and any are as at be by for from in into is it no not of on or that the this to under v will with without you 0 1 2 3 4".split())
#: Per cent of a notice's weight that must stand in place, and by how many words places may be off.
SHARE, SLACK = 50, 2


@dataclass(frozen=True)
class Posting:
    notice: int
    label: str
    at: int
    word: str
    #: The phrases that begin here.
    keys: tuple[str, ...]


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def postings(notices=NOTICES) -> list[Posting]:
    """Where each word of each notice stands, without ``FUNCTION_WORDS``."""
    out = []
    for notice, (label, text, phrases) in enumerate(notices):
        words = _words(text)
        starts: dict[int, list[str]] = {}
        for phrase in phrases:
            parts = phrase.split()
            at = next((i for i in range(len(words)) if words[i : i + len(parts)] == parts), None)
            if at is None or parts[0] in FUNCTION_WORDS:
                raise ValueError(f"{label}: its notice must hold {phrase!r}, from a word that is indexed")
            starts.setdefault(at, []).append(phrase)
        out += [Posting(notice, label, at, w, tuple(starts.get(at, ()))) for at, w in enumerate(words) if w not in FUNCTION_WORDS]
    return out


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _hits(index: list[Posting]) -> Column:
    """(pos, word, phrases) of each word of ``words`` that is indexed or begins a base phrase; phrases are those that begin there."""
    phrases = sorted({*BASE, *(k for p in index for k in p.keys)})
    known = sorted({p.word for p in index} | {p.split()[0] for p in phrases})
    longest = max(len(p.split()) for p in phrases)

    def hit(word: Column, at: Column) -> Column:
        ahead = F.concat(F.array_join(F.slice("words", at + 1, F.lit(longest)), " "), F.lit(" "))
        begun = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.startswith(ahead, F.concat(p, F.lit(" "))))
        return F.when(word.isin(known), F.struct(at.alias("pos"), word.alias("word"), begun.alias("phrases")))

    return F.array_compact(F.transform("words", hit))


def _weighed(index: list[Posting], frequency: dict[str, int], n: int) -> list[tuple]:
    """(notice, label, at, word, weight, total, rare, keys, of) of each posting.

    The weight is the word's inverse document frequency. Rare postings are a
    notice's heaviest; those that are not rare weigh less than ``SHARE`` of it,
    so what stands in place of it holds a rare one.
    """
    weight = {p.word: 1000 + math.floor(1000 * math.log((n + 1) / (frequency.get(p.word, 0) + 1))) for p in index}
    out = []
    for notice in {p.notice for p in index}:
        own = sorted((p for p in index if p.notice == notice), key=lambda p: (-weight[p.word], p.at))
        total, left = sum(weight[p.word] for p in own), sum(weight[p.word] for p in own)
        keys = sum(len(p.keys) for p in own)
        for p in own:
            out.append((notice, p.label, p.at, p.word, weight[p.word], total, 100 * left >= SHARE * total, p.keys, keys))
            left -= weight[p.word]
    return sorted(out, key=lambda row: (row[0], row[2]))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _index_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The weighed postings as a table in the plan; they are as many as the words of ``NOTICES``."""
    each = (f"({a}, {_quoted(label)}, {at}, {_quoted(word)}, {weight}L, {total}L, {str(rare).lower()}, array({', '.join(map(_quoted, keys))}), {of})" for a, label, at, word, weight, total, rare, keys, of in rows)
    return spark.sql("select notice, label, at, word, weight, total, rare, cast(keys as array<string>) as keys, of from values " + ", ".join(each) + " as t(notice, label, at, word, weight, total, rare, keys, of)")


def _found(rows: DataFrame, weighed: list[tuple]) -> DataFrame:
    """(_row, licenses) of the rows of ``rows`` (_row, hits) that hold notices.

    A row's rare words are looked up first. Every posting of a hit is a vote
    for the place at which its notice would begin; votes near a place at which
    a rare word votes are added up, each posting once.
    """
    spark = rows.sparkSession
    index = F.broadcast(_index_table(spark, weighed))
    rare = sorted({r[3] for r in weighed if r[6]})
    near = rows.filter(F.exists("hits", lambda h: h["word"].isin(rare))).select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
    votes = near.join(index, "word").select("_row", "notice", "label", "at", "weight", "total", "rare", "of", (F.col("pos") - F.col("at")).alias("begins"), F.array_intersect("keys", "phrases").alias("keys"))
    off = F.explode(F.sequence(F.lit(-SLACK), F.lit(SLACK))).alias("off")
    placed = votes.select("*", off).withColumn("begin", F.col("begins") + F.col("off"))
    windows = placed.groupBy("_row", "notice", "begin").agg(
        F.first("label").alias("label"),
        F.first("total").alias("total"),
        F.first("of").alias("of"),
        F.max(F.col("rare") & (F.col("off") == 0)).alias("anchored"),
        F.collect_set(F.struct("at", "weight")).alias("held"),
        F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"),
    )
    weight = F.aggregate("held", F.lit(0).cast("long"), lambda sum_, p: sum_ + p["weight"])
    last = F.array_max(F.transform("held", lambda p: p["at"]))
    judged = windows.filter(F.col("anchored") & (F.size("keys") == F.col("of"))).select("_row", "label", "begin", (F.col("begin") + last).alias("end"), weight.alias("weight"), "total")
    kept = judged.filter(100 * F.col("weight") >= SHARE * F.col("total"))
    share = F.floor(10000 * F.col("weight") / F.col("total")) / F.lit(10000.0)
    of_label = kept.groupBy("_row", "label").agg(F.max(share).alias("share"), F.greatest(F.min("begin"), F.lit(0)).alias("first"), F.max("end").alias("last"))
    return of_label.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("label", "share", "first", "last"))).alias("licenses"))


def scan_licenses(docs: DataFrame, passed: list[str] | None = None) -> DataFrame:
    """Stored rows with ``n_words``, ``base`` and ``licenses`` beside their columns.

    ``base`` holds (pos, label) of each place of a base phrase, places in words
    from 0. ``licenses`` holds (label, share, first, last) of each licence of
    ``NOTICES`` that the text has: the share of its best notice's weight that
    stands in place, and the first and last word of all its places.

    Only words that notices have are kept of a text, with their places. How
    many documents have each of them comes from the whole table; the rarer a
    word, the more it weighs. Rows without a rare word go no further. A notice
    is found where postings of half its weight, among them a rare one, stand at
    their places from its begin, off by no more than ``SLACK`` words, and all
    its mandatory phrases stand there whole.

    All of it is column expressions. Votes (not texts) are shuffled, by row,
    notice and place, so a very long text of one notice after another is spread
    too. What comes to the driver is the number of documents of each word of
    ``NOTICES``.

    Edge cases: a null or empty text has no words. Rows are told apart by
    their place in the table, so repeated and null ids are fine, and each row
    is a document. Columns other than the three new ones pass (``passed``, if given).
    """
    return finished(docs.sparkSession, lambda: _scanned(docs, passed))


def _scanned(docs: DataFrame, passed: list[str] | None) -> DataFrame:
    own = [c for c in (passed if passed is not None else docs.columns) if c not in ("n_words", "base", "licenses")]
    index = postings()
    text = lowered(F.coalesce(F.col("text"), F.lit("")))
    split = docs.select(F.struct(*own).alias("_own"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    cut = split.select("_own", F.size("words").cast("long").alias("n_words"), _hits(index).alias("hits"))
    rows = stored(cut.withColumn("_row", F.monotonically_increasing_id()))
    counted = rows.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").count().collect()
    weighed = _weighed(index, {r["word"]: r["count"] for r in counted}, rows.count())
    found = stored(_found(rows, weighed))
    labels = F.create_map(*(F.lit(x) for pair in BASE.items() for x in pair))
    places = F.flatten(F.transform("hits", lambda h: F.transform(F.array_intersect(h["phrases"], F.array(*map(F.lit, BASE))), lambda p: F.struct(h["pos"].alias("pos"), F.element_at(labels, p).alias("label")))))
    met = rows.select("_row", "_own", "n_words", places.alias("base")).join(found, "_row", "left")
    none = F.array().cast("array<struct<label:string,share:double,first:int,last:int>>")
    return met.select("_own.*", "n_words", "base", F.coalesce("licenses", none).alias("licenses"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), passed=["doc_id"])
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("licenses.share"), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.pos").cast("long").alias("first_word"),
        F.array_max("base.pos").cast("long").alias("last_word"),
        _joined(F.col("base.label")).alias("base_labels"),
        _joined(F.concat(F.col("base.label"), F.col("licenses.label"))).alias("labels"),
        score.alias("score"),
    )


_SQL_PHRASES = sorted({*BASE, *(k for p in postings() for k in p.keys)})
_SQL_HEADS = ", ".join(_quoted(h) for h in sorted({p.split()[0] for p in _SQL_PHRASES}))
_SQL_KEYS = "(values " + ", ".join(f"({p.notice}, {p.at}, {_quoted(k)})" for p in postings() for k in p.keys) + ") as k(notice, nth, phrase)"
ORACLE = f"""
with posting as (select * from (values {", ".join(f"({p.notice}, {_quoted(p.label)}, {p.at}, {_quoted(p.word)})" for p in postings())}) as t(notice, label, nth, word)),
keyed as (select * from {_SQL_KEYS}),
base(phrase, label) as (values {", ".join(f"({_quoted(p)}, {_quoted(b)})" for p, b in BASE.items())}),
texts as (
  select row_number() over () as id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') as w from documents),
each_word as (select id, unnest(w) as word, unnest(range(len(w))) as pos from texts),
heads as (select h.id, h.word, h.pos, t.w from each_word h join texts t using (id) where h.word in ({_SQL_HEADS})),
phrase_at as (
  select id, pos, phrase from heads join (select unnest([{", ".join(map(_quoted, _SQL_PHRASES))}]) as phrase)
  on array_to_string(w[pos + 1:pos + len(string_split(phrase, ' '))], ' ') = phrase),
hit as (select id, word, pos from each_word where word in (select word from posting)),
weight as (
  select p.word, 1000 + floor(1000 * ln(((select count(*) from texts) + 1) / (coalesce(n, 0) + 1)))::bigint as weight
  from (select distinct word from posting) p left join (select word, count(distinct id) as n from hit group by word) using (word)),
weighed as (
  select p.*, weight, sum(weight) over (partition by notice) as total,
    100 * sum(weight) over (partition by notice order by weight desc, nth rows between current row and unbounded following)
      >= {SHARE} * sum(weight) over (partition by notice) as rare
  from posting p join weight using (word)),
vote as (select h.id, notice, label, nth, weight, total, rare, pos - nth as begins from hit h join weighed using (word)),
anchor as (select distinct id, notice, begins as at_word from vote where rare),
held as (
  select distinct a.id, a.notice, a.at_word, label, nth, weight, total
  from anchor a join vote v on v.id = a.id and v.notice = a.notice and abs(v.begins - a.at_word) <= {SLACK}),
shares as (
  select id, notice, at_word, label, sum(weight) as held, any_value(total) as total from held group by id, notice, at_word, label),
whole as (
  select s.* from shares s where 100 * held >= {SHARE} * total
  and not exists (select 1 from keyed k where k.notice = s.notice and not exists (
    select 1 from phrase_at f where f.id = s.id and f.phrase = k.phrase and abs(f.pos - k.nth - s.at_word) <= {SLACK}))),
licence as (select id, label, floor(10000 * held / total) / 10000.0 as share from whole),
place as (select id, pos, label from phrase_at join base using (phrase)),
named as (select id, label from licence union select id, label from place)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, case when n_base > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
from texts
left join (select id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels from place group by id) using (id)
left join (select id, string_agg(label, ',' order by label) as labels from named group by id) using (id)
left join (select id, max(share) as share from licence group by id) using (id)
"""
