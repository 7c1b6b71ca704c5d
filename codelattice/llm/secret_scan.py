"""Secrets in texts: fixed patterns, and strings of high entropy in a sliding window."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.llm.common import table

KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
VALUE = "[A-Za-z0-9+/_.=-]+"
AFTER = "[\"']?\\x20*[:=]\\x20*[\"']?"
#: kind: pattern, group whose length counts, least length
BASE = {
    "assign": (f"(?i)({'|'.join(KEYWORDS)}){AFTER}({VALUE})", 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
CANDIDATE = "[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: class of the candidate's characters, in the order in which they are tried: pattern, bits a character
CLASSES = {
    "entropy_hex": ("^[0-9A-Fa-f]+$", 2.95),
    "entropy_alnum": ("^[A-Za-z0-9]+$", 3.65),
    "entropy_base64": ("^[A-Za-z0-9+/=]+$", 3.75),
    "entropy_token": ("^[A-Za-z0-9+/=_-]+$", 3.85),
}
#: What looks random and is no secret: whole candidates, and spans that hold alphabets or say that they are examples.
ALLOWED = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^[0-9]+$",
)
ALLOWED_SPANS = ("0123456789|abcdefghij|ABCDEFGHIJ", "EXAMPLE|example|PLACEHOLDER|placeholder")
#: Candidates all of whose segments read like words of an identifier or a path: capitalised or not, some digits at the end, or a short number.
SEGMENT_ENDS = "[+/=_-]"
SEGMENT_DIGITS = "[0-9]{1,4}$"
SEGMENT_WORDS = "[A-Z]?[a-z]{2,}|[A-Z]{2,}"
KINDS = [*BASE, *CLASSES]


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Every match of ``pattern``: the length of the text before it since the last match, its own, whether it holds, and what it matched."""
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matched
    each = F.arrays_zip(matched.alias("m"), groups.alias("g"), F.slice(pieces, F.lit(1), F.size(matched)).alias("p"))
    rows = F.transform(
        each,
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind) if kind in KINDS else len(BASE)).alias("kind"),
            i.alias("i"),
            F.char_length(x["p"]).alias("gap"),
            F.char_length(x["m"]).alias("length"),
            (F.char_length(x["g"]) >= least).alias("holds"),
            F.when(F.lit(kind not in BASE), x["m"]).alias("string"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), rows)


def _spread(counts: int) -> float:
    return counts * math.log2(counts) if counts else 0.0


def entropy_span(string: Column, least: Column) -> Column:
    """(first, last) character, from 1, of the windows of ``string`` with ``least`` bits a character or more; null if none has.

    One pass: a character that enters the window and the one that leaves it
    change two counts, and with them the sum of count * log2(count), from which
    the window's entropy follows.
    """
    spread = F.array(*(F.lit(_spread(n)) for n in range(WINDOW + 2)))
    g = lambda n: F.get(spread, n)
    index = lambda at: F.call_function("locate", F.substr(string, at, F.lit(1)), F.lit(ALPHABET)) - 1

    def advance(state: Column, at: Column) -> Column:
        comes = index(at)
        goes = F.when(at > WINDOW, index(at - WINDOW)).otherwise(-1)
        changed = F.struct(state.alias("s"), comes.alias("comes"), goes.alias("goes"), at.alias("at"))
        return F.get(F.transform(F.array(changed), _advance), 0)

    def _advance(x: Column) -> Column:
        counts, comes, goes = x["s"]["counts"], x["comes"], x["goes"]
        one, other = F.get(counts, comes), F.when(goes >= 0, F.get(counts, goes)).otherwise(0)
        gained = g(one + 1) - g(one)
        lost = F.when(goes >= 0, g(other) - g(other - 1)).otherwise(0.0)
        total = x["s"]["total"] + F.when(comes == goes, 0.0).otherwise(gained - lost)
        high = (x["at"] >= WINDOW) & (math.log2(WINDOW) - total / WINDOW >= least)
        return F.struct(
            F.transform(counts, lambda n, i: n + (i == comes).cast("int") - (i == goes).cast("int")).alias("counts"),
            total.alias("total"),
            F.when(high & x["s"]["first"].isNull(), x["at"] - WINDOW + 1).otherwise(x["s"]["first"]).alias("first"),
            F.when(high, x["at"]).otherwise(x["s"]["last"]).alias("last"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.char_length(string)), start, advance, lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"].alias("first"), s["last"].alias("last"))))


def _made_of_words(string: Column) -> Column:
    """Whether nothing is left of any segment without the digits at its end and without its words."""
    return F.forall(F.split(string, SEGMENT_ENDS), lambda s: F.regexp_replace(F.regexp_replace(s, SEGMENT_DIGITS, ""), SEGMENT_WORDS, "") == "")


def scan_secrets(docs: DataFrame, passed: list[str] | None = None) -> DataFrame:
    """Each row with ``secrets``, an array of (start, kind, end) in order, kind by its place in ``KINDS``.

    Places are code points from 0, ends exclusive. The patterns of ``BASE`` are
    matched from the left without overlap, and short matches dropped after
    that. Strings of 20 or more letters, digits and signs are candidates for
    the entropy kinds; those that overlap a base span, that ``ALLOWED`` knows
    or that are made of words are left out. The span of a candidate runs over
    all its windows whose entropy reaches the bound of its class, unless
    ``ALLOWED_SPANS`` knows something in the span. Random letters without a
    digit that are not in mixed case look like a word and are not found.

    All of it is column expressions. Matches (not texts) are shuffled once, by
    row, to add up the lengths before each of them and to see overlaps, so a
    text with very many matches costs no more than their sorting.

    Edge cases: a null or empty text has no secrets (an empty array). Rows are
    told apart by their place in the table, not their id, so repeated and null
    ids are fine. Columns other than ``secrets`` pass (``passed``, if given).
    """
    own = [c for c in (passed if passed is not None else docs.columns) if c != "secrets"]
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = {**BASE, "candidate": (CANDIDATE, 0, WINDOW)}
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,length:int,holds:boolean,string:string>>")
    hits = F.concat(*(F.coalesce(_found(text, kind, *rest), none) for kind, rest in patterns.items()))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*own).alias("_own"), hits.alias("_hits"))
    matches = rows.select("_row", "_own", F.explode_outer("_hits").alias("_hit")).select("_row", "_own", "_hit.*")
    dealt = matches.repartition("_row")
    before = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before)).withColumn("start", F.col("end") - F.col("length"))
    is_base = F.col("kind") < len(BASE)
    known = placed.filter(F.col("holds") | F.col("kind").isNull())
    earlier = Window.partitionBy("_row").orderBy("start", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("_row").orderBy("start", F.col("kind").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    seen = known.withColumn("_reached", F.max(F.when(is_base, F.col("end"))).over(earlier)).withColumn("_next", F.min(F.when(is_base, F.col("start"))).over(later))
    string = F.col("string")
    kind = F.lit(None).cast("int")
    for name in reversed(CLASSES):
        kind = F.when(F.regexp_like(string, F.lit(CLASSES[name][0])), F.lit(KINDS.index(name))).otherwise(kind)
    least = F.get(F.array(*(F.lit(CLASSES[k][1] if k in CLASSES else 0.0) for k in KINDS)), F.col("class"))
    free = (F.coalesce("_reached", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    matches_any = lambda text, patterns: reduce(Column.__or__, [F.regexp_like(text, F.lit(p)) for p in patterns])
    judged = seen.withColumn("class", F.when(~is_base & free & ~matches_any(string, ALLOWED) & ~_made_of_words(string), kind)).withColumn("_span", F.when(F.col("class").isNotNull(), entropy_span(string, least)))
    found = F.substr(string, F.col("_span.first"), F.col("_span.last") - F.col("_span.first") + 1)
    judged = judged.withColumn("_span", F.when(~matches_any(found, ALLOWED_SPANS), F.col("_span")))
    span = F.when(is_base, F.struct("start", "kind", "end")).when(
        F.col("_span").isNotNull(),
        F.struct((F.col("start") + F.col("_span.first") - 1).alias("start"), F.col("class").alias("kind"), (F.col("start") + F.col("_span.last")).alias("end")),
    )
    return judged.groupBy("_row").agg(F.first("_own").alias("_own"), F.array_sort(F.collect_list(span)).alias("secrets")).select("_own.*", "secrets")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), passed=["doc_id"])
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *(of(k) for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sql_matches(kind: str, pattern: str, group: int, least: int) -> str:
    p = _sql_text(pattern)
    return f"""
{kind}_raw as (
  select doc_id, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', {group}) as g, string_split_regex(t, '{p}') as s
  from texts where regexp_matches(t, '{p}')),
{kind}_each as (
  select doc_id, unnest(m) as m, unnest(g) as g, unnest(s[1:len(m)]) as s, unnest(range(len(m))) as i from {kind}_raw),
{kind}_at as (
  select doc_id, m, g, sum(length(s) + length(m)) over (partition by doc_id order by i) as e, length(m) as n from {kind}_each),
{kind} as (
  select doc_id, m, (e - n)::bigint as start, e::bigint as stop from {kind}_at where length(g) >= {least})"""


_SQL_ASSIGN = f"({'|'.join(_any_case(k) for k in KEYWORDS)}){AFTER}({VALUE})"
ORACLE = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
{_sql_matches("assign", _SQL_ASSIGN, *BASE["assign"][1:])},
{_sql_matches("access", *BASE["access"])},
{_sql_matches("hex", *BASE["hex"])},
{_sql_matches("candidate", CANDIDATE, 0, WINDOW)},
base as (
  select doc_id, 0 as k, start, stop from assign union all
  select doc_id, 1, start, stop from access union all select doc_id, 2, start, stop from hex),
open_ones as (
  select doc_id, m, start from candidate c
  where not exists (select 1 from base b where b.doc_id = c.doc_id and b.start < c.stop and c.start < b.stop)
  {"".join(f" and not regexp_matches(m, '{p}')" for p in ALLOWED)}
  and exists (select 1 from (select unnest(string_split_regex(m, '{SEGMENT_ENDS}')) as s) where regexp_replace(regexp_replace(s, '{SEGMENT_DIGITS}', ''), '{SEGMENT_WORDS}', '', 'g') <> '')),
classed as (
  select *, case {" ".join(f"when regexp_matches(m, '{p}') then {KINDS.index(k)}" for k, (p, _) in CLASSES.items())} end as k from open_ones),
starts as (select doc_id, m, start, k, unnest(range(1, length(m) - {WINDOW} + 2)) as q from classed),
chars as (select doc_id, start, k, q, m[q + j] as c from starts, (select unnest(range({WINDOW})) as j)),
counts as (select doc_id, start, k, q, count(*) as n from chars group by doc_id, start, k, q, c),
bits as (select doc_id, start, k, q, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} as h from counts group by doc_id, start, k, q),
high as (
  select doc_id, start, k, min(q) as a, max(q) as b from bits
  where h + 1e-9 >= case k {" ".join(f"when {KINDS.index(k)} then {h}" for k, (_, h) in CLASSES.items())} end group by doc_id, start, k),
kept as (
  select high.*, m[a:b + {WINDOW - 1}] as span from high join classed using (doc_id, start, k)),
spans as (
  select * from base union all select doc_id, k, start + a - 1, start + b - 1 + {WINDOW} from kept
  where {" and ".join(f"not regexp_matches(span, '{p}')" for p in ALLOWED_SPANS)}),
named as (
  select doc_id, k, start, (case k {" ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS))} end) || ':' || start || ':' || stop as s from spans)
select d.doc_id, count(*) filter (k = 0)::bigint as n_assign, count(*) filter (k = 1)::bigint as n_access, count(*) filter (k = 2)::bigint as n_hex,
  sha256(coalesce(string_agg(s, ',' order by start, k) filter (k < {len(BASE)}), '')) as base_sha256,
  coalesce(string_agg(s, ',' order by start, k), '') as spans
from documents d left join named n on n.doc_id = d.doc_id group by d.doc_id
"""
