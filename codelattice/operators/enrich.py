"""Descriptions from a model that the caller brings, and how its replies are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.columns import class_type, json_in_reply, readme
from codelattice.operators.graph import apply_enrichment
from codelattice.operators.snapshots import update
from codelattice.schema import Catalog
from codelattice.storage import stored

IN_FLIGHT, BATCH = 5, 20
REPLY = "description string, classType string, methods map<string, struct<description:string, businessLogic:array<string>>>"


# File endings and the language they tell.
LANGUAGES = {"java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go"}


def prompts(classes: DataFrame, methods: DataFrame, files: DataFrame | None = None, readmes: DataFrame | None = None) -> DataFrame:
    """(class_id, prompt) of classes without a description: language, type, name, file and method names.

    With ``files`` (project_id, path, content) comes the source, with
    ``readmes`` (project_id, content) what the project says of itself.
    """
    names = methods.groupBy("class_id").agg(F.array_join(F.array_sort(F.collect_set("method_name")), ", ").alias("names"))
    rows = classes.filter("description is null").select(F.col("id").alias("class_id"), "project_id", "full_class_name", "class_type", "source_file").join(names, "class_id", "left")
    ending = F.lower(F.regexp_extract("source_file", r"[.](\w+)$", 1))
    language = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), ending), F.lit("source"))
    about, source = F.lit(""), F.lit("")
    if readmes is not None:
        rows = rows.join(readmes.select("project_id", readme(F.col("content")).alias("_readme")), "project_id", "left")
        about = F.coalesce(F.concat(F.lit("\n\nThe project says of itself:\n"), "_readme"), F.lit(""))
    if files is not None:
        rows = rows.join(files.select("project_id", F.col("path").alias("source_file"), F.col("content").alias("_source")), ["project_id", "source_file"], "left")
        source = F.coalesce(F.concat(F.lit("\n\nSource:\n"), "_source"), F.lit(""))
    text = F.concat(F.lit("Describe what this "), language, F.lit(" "), F.lower("class_type"), F.lit(" does for its users: "), "full_class_name", F.lit(" in "), "source_file", F.lit(" with the methods "), F.coalesce("names", F.lit("(none)")), F.lit(". Answer with JSON: description, classType if another fits better, and methods by name with description and businessLogic."), about, source)
    return rows.select("class_id", "full_class_name", text.alias("prompt"))


def ask(asked: DataFrame, client: Callable[[list[str]], list[str]], in_flight: int = IN_FLIGHT, batch: int = BATCH) -> DataFrame:
    """(class_id, reply, error): ``client`` answers ``batch`` prompts at a time, ``in_flight`` tasks at once.

    A batch that fails gives its error to each of its classes and stops nothing.
    """

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    replies, errors = client(part.prompt.tolist()), None
                except Exception as failure:  # noqa: BLE001
                    replies, errors = None, str(failure)
                yield pd.DataFrame({"class_id": part.class_id.tolist(), "reply": replies, "error": errors})

    return asked.select("class_id", "prompt").repartition(in_flight).mapInPandas(answer, "class_id string, reply string, error string")


def close_json(text: Column) -> Column:
    """A JSON object that was cut off, cut back to its last closed part and closed.

    Brackets inside strings do not count: strings are blanked, at their
    length, before brackets are looked at.
    """
    blank = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"?|[^"]++'), F.lit(0)), lambda t: F.when(F.startswith(t, F.lit('"')), F.repeat(F.lit("_"), F.char_length(t))).otherwise(t)), "")
    count = lambda c, mark: F.char_length(c) - F.char_length(F.replace(c, F.lit(mark), F.lit("")))
    balanced = (count(blank, "{") == count(blank, "}")) & (count(blank, "[") == count(blank, "]"))
    last = F.char_length(blank) - F.least(*(F.coalesce(F.nullif(F.instr(F.reverse(blank), m), F.lit(0)), F.char_length(blank) + 1) for m in "}]")) + 1
    cut, rest = F.substr(text, F.lit(1), last), F.substr(blank, F.lit(1), last)
    closed = F.concat(cut, F.repeat(F.lit("]"), F.greatest(F.lit(0), count(rest, "[") - count(rest, "]"))), F.repeat(F.lit("}"), F.greatest(F.lit(0), count(rest, "{") - count(rest, "}"))))
    return F.when(balanced | (last < 1), text).otherwise(closed)


def read_replies(replies: DataFrame) -> DataFrame:
    """(class_id, success, description, class_type, methods, error) of replies that hold a JSON object, whole or cut off."""
    parsed = replies.withColumn("r", F.from_json(close_json(json_in_reply(F.col("reply"))), REPLY))
    fine = F.col("error").isNull() & F.col("r.description").isNotNull()
    error = F.coalesce("error", F.when(~fine, F.lit("no description in the reply")))
    return parsed.select("class_id", fine.alias("success"), F.col("r.description").alias("description"), F.col("r.classType").alias("class_type"), F.col("r.methods").alias("methods"), error.alias("error"))


def method_updates(read: DataFrame) -> DataFrame:
    """What ``operators.graph.apply_enrichment`` takes."""
    rows = read.filter("success").select("class_id", F.explode("methods").alias("method_name", "m"))
    return rows.select("class_id", "method_name", F.col("m.description").alias("description"), F.to_json("m.businessLogic").alias("business_logic"))


def class_updates(read: DataFrame) -> DataFrame:
    """What ``operators.snapshots.update`` takes."""
    return read.filter("success").select(F.col("class_id").alias("id"), "description", F.when(F.col("class_type").isNotNull(), class_type(F.col("class_type"))).alias("class_type"))


def enriched(catalog: Catalog, client: Callable[[list[str]], list[str]], files: DataFrame | None = None, readmes: DataFrame | None = None, passes: int = 2) -> Catalog:
    """The catalog with the descriptions that ``client`` gives; a later pass asks again for those that failed.

    Replies are stored, so that no plan asks for them twice.
    """
    for _ in range(passes):
        asked = prompts(catalog.classes, catalog.methods, files, readmes)
        read = stored(read_replies(ask(asked, client)))
        catalog = replace(catalog, classes=update(catalog.classes, class_updates(read)), methods=apply_enrichment(catalog.methods, method_updates(read)))
    return catalog
