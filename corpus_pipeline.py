"""The stages that turn raw documents into token counts, each a whole-table job.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` applies them to the documents of ``sf_dir``, each
written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm import bpe, decontaminate, language_id, line_dedup, simhash, similar
from codelattice.llm.common import discard, finished, table


# In all stages repeated rows are judged like any, each for itself, and columns
# beyond those of documents pass, whatever their names, up to the last stage.


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty or no letter) go.

    Where no row has a lang to learn from, all that have a letter stay.
    """
    return language_id.drop_unidentified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in their first document; a document that loses all its lines goes.

    Null and empty texts have one empty line, which is too short to be shared,
    and stay. n_chars, if there, is counted anew where lines went.
    """
    found = line_dedup.dedup_lines(docs).filter(F.col("n_dropped") < F.col("n_lines"))
    changed = found.withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return changed.select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Near are op3's links, and texts that share four fifths of their five-word
    shingles. Texts without words are alike. Rows that repeat an id stay or go
    together; rows without id stay.
    """
    return simhash.drop_near_duplicates(docs, similar.near_duplicates(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none. Rows without id stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, as counts and digests; a null text is like an empty one."""
    return bpe.encode_texts(docs, bpe.model_path(), passed=["doc_id"])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_benchmark_leaks),
    ("subword_codec", encode),
]

#: XXH64 fingerprints, the learned languages and the subword merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote goes when the next one is done."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(spark, *before)
        before = docs.inputFiles()
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
