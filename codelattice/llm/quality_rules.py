"""Rules on counts and on repeated passages inside a text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import table, text_batches, texts_of

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: The method's own limits: words of a passage that counts as repeated, percent
#: of a text in such passages, and words of the longest one.
PASSAGE = 12
MAX_COVERED_PERCENT = 15
MAX_LONGEST = 40
SYMBOLS = "#*$%&|<>"


def suffix_order(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of many texts in order, and the words each shares with the one before it.

    ``words`` are word numbers, those of text t being where ``owner`` is t. The
    order is by text first, so each text has a suffix array of its own within
    the result, and a text's end ranks below every word. Ranks of the first k
    words are doubled to 2k; only suffixes that still tie are sorted again.
    The second array is the longest common prefix with the suffix before in
    the same text, 0 for a text's first.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True])
    end = last[np.cumsum(np.r_[0, owner[1:] != owner[:-1]])] + 1
    key = owner.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    by_step = [rank.astype(np.int32)]  # equal just for suffixes that agree in the first 1, 2, 4, ... words
    k = 1
    while True:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, n])
        slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(slots):
            break
        suffix = order[slots]
        ahead = suffix + k
        second = np.where(ahead < end[suffix], rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[suffix]
        within = np.lexsort((second, first))
        order[slots] = suffix[within]
        first, second = first[within], second[within]
        new[slots] = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[order[slots]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[slots]
        by_step.append(rank.astype(np.int32))
        k *= 2
    return order, _common(owner, end, order, by_step)


def _common(owner: np.ndarray, end: np.ndarray, order: np.ndarray, by_step: list[np.ndarray]) -> np.ndarray:
    """Longest common prefixes of neighbours: from the longest step to the shortest, what still agrees by rank is taken."""
    common = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    both = np.flatnonzero(owner[a] == owner[b])
    a, b = a[both], b[both]
    got = np.zeros(len(both), np.int64)
    for step in range(len(by_step) - 1, -1, -1):
        x, y = a + got, b + got
        inside = np.flatnonzero((x < end[a]) & (y < end[b]))
        same = inside[by_step[step][x[inside]] == by_step[step][y[inside]]]
        got[same] += 1 << step
    common[both + 1] = got
    return common


def covered_words(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a passage of ``least`` or more words that its text repeats.

    A suffix opens a repeated passage as long as the larger of its common
    prefixes with the suffixes before and after it: the longest of the
    common-prefix intervals that hold it. The union of these spans is marked.
    """
    n = len(order)
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(common, np.r_[common[1:], 0]) if n else 0
    spans = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans, 1)
    np.add.at(edge, spans + longest[spans], -1)
    return np.cumsum(edge[:-1]) > 0


def _counts(texts: list[str]) -> dict[str, np.ndarray]:
    byte_words = [text.encode().split() for text in texts]  # blanks are 20 and 09 to 0D
    sizes = np.array([len(w) for w in byte_words], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(byte_words)), np.int64, int(sizes.sum()))
    order, common = suffix_order(flat, owner)
    per_text = lambda marked: np.diff(np.r_[0, np.cumsum(marked)][np.r_[0, ends]])
    longest = np.zeros(len(texts), np.int64)
    if len(flat):
        np.maximum.at(longest, owner[order], common)
    out = {
        "n_words": sizes,
        "word_chars": np.array([len("".join(text.split(" "))) - sum(map(text.count, "\t\n\x0b\x0c\r")) for text in texts], np.int64),
        "n_symbols": np.array([sum(map(text.count, SYMBOLS)) for text in texts], np.int64),
        "n_dup_lines": np.array([_dup_lines(text) for text in texts], np.int64),
        "n_repeat_words": per_text(covered_words(order, common, WINDOW)),
        "n_passage_words": per_text(covered_words(order, common, PASSAGE)),
        "longest_repeat": longest,
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def _dup_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")] if "\n" in text else ()
    return len(lines) - len(set(lines))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_passage_words", "longest_repeat"]


def count_rules(docs: DataFrame, passed: list[str] | None = None) -> DataFrame:
    """Each row with its counts and the verdicts ``base_failed`` and ``kept``.

    Words are runs without blanks. A suffix array over the words of each text
    gives the passages that the text repeats: all in passages of ``WINDOW``
    words or more are n_repeat_words, all in passages of ``PASSAGE`` or more
    n_passage_words, and longest_repeat is the longest. base_failed is true
    under ``MIN_WORDS`` words or over ``MAX_REPEAT_PERCENT`` percent repeated
    ones; kept is false then, and where passages cover more than
    ``MAX_COVERED_PERCENT`` percent of the words or one exceeds ``MAX_LONGEST``.

    Rows are independent: no shuffle, one suffix array for each few MB of texts.
    Edge cases: a null or empty text has no words and is not kept. Columns of
    the new names are replaced, others pass (``passed``, if given).
    """
    verdicts = ["base_failed", "kept"]
    own = [c for c in (passed if passed is not None else docs.columns) if c not in COUNTS + verdicts]
    rows = docs.select(F.struct(*own).alias("row"), F.col("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = _counts(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(found[c]) for c in COUNTS)], ["row", *COUNTS])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    counted = rows.mapInArrow(count, schema).select("row.*", *COUNTS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    repeats = (100 * F.col("n_passage_words") > MAX_COVERED_PERCENT * F.col("n_words")) | (F.col("longest_repeat") > MAX_LONGEST)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeats)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rules(table(spark, sf_dir, "documents"), passed=["doc_id"]).drop("longest_repeat")


def _covered(least: int, name: str) -> str:
    return f"""
{name}_runs as (
  select doc_id, p, list_slice(w, p, p + {least - 1}) as run from places where p + {least - 1} <= n),
{name}_starts as (
  select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, run) as c from {name}_runs) where c > 1),
{name} as (
  select doc_id, count(distinct p + i)::bigint as covered
  from {name}_starts, (select unnest(range({least})) as i) group by doc_id)"""


_BLANK = "[\\x20\\x09-\\x0D]"

ORACLE = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
words as (
  select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from texts),
places as (
  select doc_id, w, len(w) as n, unnest(range(1, len(w) + 1)) as p from words),
{_covered(WINDOW, "repeated")},
{_covered(PASSAGE, "passages")},
{_covered(MAX_LONGEST + 1, "too_long")},
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from texts),
dup as (
  select doc_id, sum(c - 1)::bigint as n_dup_lines from (
    select doc_id, line, count(*) as c from lines
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id, line) group by doc_id),
counted as (
  select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(r.covered, 0)::bigint as n_repeat_words, coalesce(p.covered, 0)::bigint as n_passage_words, l.covered is not null as long_one
  from words d left join dup using (doc_id) left join repeated r using (doc_id) left join passages p using (doc_id) left join too_long l using (doc_id)),
judged as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_passage_words, base_failed,
  not base_failed and 100 * n_passage_words <= {MAX_COVERED_PERCENT} * n_words and not long_one as kept
from judged
"""
