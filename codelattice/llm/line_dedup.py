"""Lines that several documents share are kept in the first of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import stored, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
MIN_KEY_LENGTH = 10
MIN_DOCUMENTS = 2


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case, other letters as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _keyed_lines(rows: DataFrame, min_key_length: int) -> DataFrame:
    lines = rows.select("doc_id", "row_hash", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key"))
    long_enough = keyed.filter(F.char_length("key") >= min_key_length)
    return long_enough.select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(h1, h2, keeper) of each line hash that at least ``min_documents`` ids have."""
    if min_documents <= 2:
        ids = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        return ids.filter((F.col("keeper") != F.col("last")) | F.lit(min_documents <= 1)).select("h1", "h2", "keeper")
    per_document = lines.filter(F.col("doc_id").isNotNull()).select("h1", "h2", "doc_id").distinct()
    ids = per_document.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"))
    return ids.filter(F.col("n") >= min_documents).select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, min_key_length: int = MIN_KEY_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` beside its columns.

    A text is split at every newline. Lines whose key has ``min_key_length``
    code points or more and occurs in ``min_documents`` ids or more go, except
    in the smallest of these ids, which keeps all of its own.

    Only 128-bit hashes are shuffled to find shared lines: a hash needs just
    the smallest and the largest id that has it, which Spark combines before
    the shuffle, so a line of a third of all documents costs one row per task.
    The few shared hashes are written out and joined back; a hot hash is then
    split by adaptive execution. Texts are shuffled once, to meet the positions
    they lose.

    Edge cases: a null or empty text is one empty line and is kept as such.
    Rows that repeat an id count as one document. A row without id keeps all
    its lines and is no document for others. Nothing is read from columns other
    than ``doc_id`` and ``text``, and all columns of ``docs`` come back; those
    of the three names above are replaced.
    """
    own = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("row_hash"), F.split(text, "\n", -1).alias("lines"))
    lines = _keyed_lines(rows, min_key_length)
    shared = stored(shared_lines(lines, min_documents))
    hit = lines.join(shared, ["h1", "h2"]).filter(F.col("doc_id") > F.col("keeper"))
    lost = hit.groupBy(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).agg(F.collect_set("pos").alias("_lost"))
    whole = docs.select(F.struct(*own).alias("_row")).select("_row", F.coalesce("_row.text", F.lit("")).alias("_text"))
    joined = whole.join(lost, (F.col("_row.doc_id") == F.col("_id")) & (F.xxhash64("_text") == F.col("_hash")), "left")
    split = joined.select("_row", F.split("_text", "\n", -1).alias("_lines"), F.coalesce("_lost", F.array().cast("array<int>")).alias("_lost"))
    kept = split.withColumn("_kept", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost")))
    return kept.select(
        "_row.*",
        F.when(F.size("_lost") == 0, F.array_join("_lines", "\n"))
        .otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n"))
        .alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_lost").cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
with lines as (
  select doc_id, unnest(l) as line, unnest(range(len(l))) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
  select doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') as key
  from lines),
shared as (
  select key, min(doc_id) as keeper from keyed where length(key) >= {MIN_KEY_LENGTH}
  group by key having count(distinct doc_id) >= {MIN_DOCUMENTS}),
flagged as (
  select k.doc_id, pos, line, keeper is not null and k.doc_id > keeper as lost
  from keyed k left join shared s on k.key = s.key and length(k.key) >= {MIN_KEY_LENGTH})
select doc_id, count(*)::bigint as n_lines, count(*) filter (lost)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
from flagged group by doc_id
"""
