"""How far the words of a source are from those of the other sources of its language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.llm.common import finished, stored, table, text_batches, texts_of

MIN_DOCUMENTS = 10
TOP_TERMS = 10
ONE = 1_000_000_000
#: Sources of a language are numbered, and met in blocks of so many.
SOURCE_BLOCK = 512
#: A task holds the sums of so many pairs of blocks before it sends them on.
HELD_TILES = 8
#: Bytes of a UTF-8 text: letters of terms are A-Z, a-z and all beyond ASCII.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()

WHOLE = "decimal(38,0)"


def count_vectors(docs: DataFrame) -> DataFrame:
    """(lang, source, terms, counts) of each document: its sparse vector over all terms, before any is dropped.

    Terms come as text, so nothing is hashed together; a text without terms has
    empty arrays.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            counted = [Counter(t.encode().translate(_LETTERS).split()) for t in texts_of(batch)]
            ends = pa.array(np.cumsum([0, *map(len, counted)]), pa.int32())
            terms = pa.array([t for c in counted for t in c], pa.binary()).cast(pa.string())
            counts = pa.array([n for c in counted for n in c.values()], pa.int64())
            lists = [pa.ListArray.from_arrays(ends, values) for values in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), *lists], ["lang", "source", "terms", "counts"])

    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    return named.mapInArrow(count, "lang string, source string, terms array<string>, counts array<long>")


def group_sums(vectors: DataFrame) -> DataFrame:
    """(lang, source, term, docs, count): the vectors of each group added up, and how many have the term.

    A group without terms has one row with a null term. Sums are combined
    before the shuffle, so a hot source costs a row for each of its terms and task.
    """
    entries = vectors.select("lang", "source", F.explode_outer(F.arrays_zip("terms", "counts")).alias("e"))
    return entries.groupBy("lang", "source", F.col("e.terms").alias("term")).agg(F.count("*").alias("docs"), F.sum("e.counts").alias("count"))


def vocabularies(sums: DataFrame, min_documents: int) -> DataFrame:
    """(lang, term, total): the terms that ``min_documents`` documents of the lang have, however many they are."""
    return sums.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).filter(F.col("docs") >= min_documents).select("lang", "term", "total")


def share(count: Column, n: Column, v: Column) -> Column:
    """The smoothed share of a term, in parts of ``ONE``; exact for counts of any size."""
    top = (count.cast("decimal(20,0)") + 2).cast("decimal(27,0)") * F.lit(ONE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top.cast(WHOLE), (n + 2 * v).cast(WHOLE))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shares(sums: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, n, v, zero, place) of each group, zero being a term's share that the group lacks; and (lang, source, term, p, q) of each term that it has, q the lang's share.

    Groups are as many as the sources of all langs.
    """
    kept = stored(sums.filter(F.col("term").isNotNull()).join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "count", "total"))
    of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    known = sums.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    filled = known.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "n_lang")))
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(0)
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stored(filled.withColumn("zero", zero).withColumn("place", numbered))
    met = kept.join(groups, ["lang", "source"])
    found = met.select("lang", "source", "place", "zero", "term", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"))
    return groups, stored(found)


def shared_terms(present: DataFrame) -> DataFrame:
    """(lang, one, other, extra) for places one < other that share terms.

    For a term of both, ``extra`` is its gap instead of those that it has as a
    term of one or the other alone, which count it twice among the terms of the
    lang. A term's sources are a sparse row, cut into
    blocks of ``SOURCE_BLOCK``; blocks of a term meet by a join, and a task adds
    up their pairs in matrices, so no row is made for a pair and a term.
    """
    block = F.floor(F.col("place") / SOURCE_BLOCK).cast("int")
    entry = F.struct(F.col("place").cast("int").alias("place"), "p", "zero")
    rows = stored(present.groupBy("lang", "term", block.alias("block")).agg(F.collect_list(entry).alias("held")))
    other = rows.select("lang", "term", F.col("block").alias("block_b"), F.col("held").alias("held_b"))
    met = rows.join(other, ["lang", "term"]).filter("block <= block_b").select("lang", "block", "block_b", "held", "held_b")

    def flush(tiles: dict) -> Iterator[pa.RecordBatch]:
        for (lang, a, b), extra in tiles.items():
            i, j = np.nonzero(extra)
            ordered = i + a * SOURCE_BLOCK < j + b * SOURCE_BLOCK
            i, j = i[ordered], j[ordered]
            columns = [pa.array([lang] * len(i), pa.string()), pa.array(i + a * SOURCE_BLOCK, pa.int32()), pa.array(j + b * SOURCE_BLOCK, pa.int32()), pa.array(extra[i, j])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "one", "other", "extra"])

    def unfold(column: pa.Array) -> tuple[np.ndarray, ...]:
        fields = column.flatten()
        return (column.value_lengths().to_numpy(), *(fields.field(f).to_numpy() for f in ("place", "p", "zero")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict = {}
        for batch in batches:
            (size, *left), (size_b, *right) = unfold(batch.column("held")), unfold(batch.column("held_b"))
            end, end_b = np.cumsum(size), np.cumsum(size_b)
            keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "block_b")), strict=True)
            for row, key in enumerate(keys):
                if key not in tiles:
                    if len(tiles) >= HELD_TILES:
                        yield from flush(tiles)
                        tiles = {}
                    tiles[key] = np.zeros((SOURCE_BLOCK, SOURCE_BLOCK), np.int64)
                i, p, y = (x[end[row] - size[row] : end[row]] for x in left)
                j, q, z = (x[end_b[row] - size_b[row] : end_b[row]] for x in right)
                at = np.ix_(i % SOURCE_BLOCK, j % SOURCE_BLOCK)
                p, y = p[:, None], y[:, None]
                tiles[key][at] += _gap(p, q) - _gap(p, z) - _gap(y, q) + _gap(y, z)
        yield from flush(tiles)

    sums = met.mapInArrow(add, "lang string, one int, other int, extra long")
    return sums.groupBy("lang", "one", "other").agg(F.sum("extra").alias("extra"))


def source_pairs(groups: DataFrame, present: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a lang, in both orders: the sum of gaps over all its terms.

    Terms that neither has count as often as the constant gap of their zero
    shares; those that one has are summed from the numbers of terms by share,
    which are far fewer than the terms; those that both have come from
    ``shared_terms``.
    """
    one = groups.select("lang", "source", "place", "zero", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("place_b"), F.col("zero").alias("zero_b"))
    pairs = stored(one.join(other, "lang").filter("place <> place_b"))
    by_share = stored(present.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")))
    alone = stored(pairs.join(by_share, ["lang", "source"]).groupBy("lang", "place", "place_b").agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("zero_b"))).alias("alone"), F.sum("terms").alias("own")))
    back = alone.select("lang", F.col("place_b").alias("place"), F.col("place").alias("place_b"), F.col("alone").alias("alone_b"), F.col("own").alias("own_b"))
    forth = stored(shared_terms(present))
    both = forth.select("lang", F.col("one").alias("place"), F.col("other").alias("place_b"), "extra").union(forth.select("lang", "other", "one", "extra"))
    ends = ["lang", "place", "place_b"]
    met = pairs.join(alone, ends, "left").join(back, ends, "left").join(both, ends, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # Terms of both are taken off twice here, for which ``extra`` makes up.
    neither = F.col("v") - zero("own") - zero("own_b")
    constant = F.when(F.col("v") > 0, gap(F.col("zero"), F.col("zero_b"))).otherwise(0)
    return met.select("lang", "source", "item", (zero("alone") + zero("alone_b") + zero("extra") + neither * constant).alias("value"))


def audit_sources(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Stored (lang, source, part, item, value, rank): what tells the sources of each lang apart.

    Each lang keeps the terms that ``min_documents`` of its documents have, with
    no bound on their number. A source's share of a term is smoothed and whole,
    and two shares differ by floor((p-q)^2/(p+q)). Part ``pair`` has the sum of
    these gaps over all terms for each other source of the lang, part ``term``
    the ``top_terms`` terms that the source has more often than its lang.

    Vectors of documents are added up before anything is shuffled, and all
    langs are one job: vocabularies are tables here, of which neither the driver
    nor a task holds one. Arithmetic is on whole numbers.

    Edge cases: null text, lang and source are like empty ones, which are a lang
    and a source. Each row is a document, so repeated rows count again; no id is
    read, and no column but text, lang and source. A lang without terms gives
    pairs of value 0, an empty table no rows. A very long text is counted by one
    task in a table of its distinct terms. Ties rank by the bytes of item.
    """
    return finished(docs.sparkSession, lambda: _audited(docs, min_documents, top_terms))


def _audited(docs: DataFrame, min_documents: int, top_terms: int) -> DataFrame:
    sums = stored(group_sums(count_vectors(docs)))
    groups, present = shares(sums, stored(vocabularies(sums, min_documents)))
    ranked = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = source_pairs(groups, present).withColumn("rank", ranked()).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    over = present.filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = over.withColumn("rank", ranked()).filter(F.col("rank") <= top_terms)
    return pairs.union(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents").select("text", "lang", "source"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL_SHARE = f"(1 + ({ONE}::hugeint * ({{count}} + 2)) // ({{n}} + 2 * v))"
_SQL_GAP = "(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"
ORACLE = f"""
with docs as (
  select row_number() over () as id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') as t,
    coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
found as (
  select id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
vocabulary as (
  select lang, term, count(*)::hugeint as total from found group by lang, term having count(distinct id) >= {MIN_DOCUMENTS}),
of_lang as (select lang, count(*)::hugeint as v, sum(total)::hugeint as n_lang from vocabulary group by lang),
groups as (select distinct lang, source from docs),
counted as (
  select lang, source, term, count(*)::hugeint as c from found join vocabulary using (lang, term) group by lang, source, term),
sized as (
  select g.lang, g.source, coalesce(sum(c), 0)::hugeint as n from groups g left join counted using (lang, source) group by g.lang, g.source),
dense as (
  select s.lang, s.source, w.term, coalesce(c.c, 0) as c,
    {_SQL_SHARE.format(count="coalesce(c.c, 0)", n="n")} as p, {_SQL_SHARE.format(count="total", n="n_lang")} as q
  from sized s join of_lang using (lang) join vocabulary w on w.lang = s.lang
  left join counted c on c.lang = s.lang and c.source = s.source and c.term = w.term),
pairs as (
  select a.lang, a.source, b.source as item, sum({_SQL_GAP.format(p="a.p", q="b.p")}) as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, {_SQL_GAP.format(p="p", q="q")} from dense where c > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as r from parts)
select lang, source, part, item, value::bigint as value, r::int as rank from ranked where part = 'pair' or r <= {TOP_TERMS}
"""
