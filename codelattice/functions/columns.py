"""Scalar functions of the catalog as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelattice.schema import CLASS_TYPES

# The two forms of a repository's URL.
HTTPS_URL = r"^https://[\w.-]+(/[\w.-]+)+\.git$"
SSH_URL = r"^git@[\w.-]+:[\w.-]+(/[\w.-]+)*\.git$"
README_CHARS, DESCRIPTION_CHARS = 10_000, 500


def simple_name(name: Column) -> Column:
    """What follows the last dot; all of it without one."""
    return F.substring_index(name, ".", -1)


def package_name(name: Column) -> Column:
    """What comes before the last dot; null without one."""
    return F.nullif(F.regexp_extract(name, r"^(.*)[.][^.]*$", 1), F.lit(""))


def in_package(package: Column, prefix: Column | str) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (package == prefix) | F.startswith(package, F.concat(prefix, F.lit(".")))


def dotted_prefixes(package: Column) -> Column:
    """a.b.c -> [a, a.b, a.b.c]: all that ``in_package`` holds for, to be joined by equality."""
    parts = F.split(package, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def common_prefix(first: Column, last: Column) -> Column:
    """The dotted segments with which both arrays of segments begin."""
    agree = F.zip_with(first, last, lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    length = F.coalesce(F.array_position(agree, False).cast("int") - 1, F.size(agree))
    stop = F.when(F.array_position(agree, False) > 0, length).otherwise(F.size(agree))
    return F.array_join(F.slice(first, F.lit(1), stop.cast("int")), ".")


def is_endpoint(http_method: Column, http_path: Column) -> Column:
    return http_method.isNotNull() & http_path.isNotNull()


def http_endpoint(http_method: Column, http_path: Column) -> Column:
    """``GET /path``; null if either is."""
    return F.concat(http_method, F.lit(" "), http_path)


def repository_name(url: Column) -> Column:
    """Last part of the URL's path, without .git."""
    return F.regexp_extract(url, r"([^/:]*?)(?:\.git)?$", 1)


def is_ssh(url: Column) -> Column:
    return url.rlike(SSH_URL)


def is_https(url: Column) -> Column:
    return url.rlike(HTTPS_URL)


def is_repository_url(url: Column) -> Column:
    return F.coalesce(is_https(url) | is_ssh(url), F.lit(False))


def class_type(text: Column) -> Column:
    """A class type by its name in any case; OTHER for all else, null included."""
    name = F.upper(F.trim(text))
    return F.when(name.isin(*CLASS_TYPES), name).otherwise("OTHER")


def handles_requests(kind: Column) -> Column:
    return kind.isin("CONTROLLER", "LISTENER")


def has_business_logic(kind: Column) -> Column:
    return kind.isin("SERVICE", "ENTITY")


def json_list(text: Column) -> Column:
    """The strings of a JSON list; none for null and what is no list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def to_json_list(items: Column) -> Column:
    """The reverse: null for no strings."""
    return F.when(F.size(items) > 0, F.to_json(items))


def identifier_of_path(path: Column, extension: str) -> Column:
    """a/b/C.java -> a.b.C"""
    return F.translate(F.regexp_replace(path, rf"\.{extension}$", ""), "/", ".")


def bare_method_name(name: Column) -> Column:
    """save(Order) -> save"""
    return F.trim(F.regexp_replace(name, r"(?s)^([^(]+)[(].*", "$1"))


def bare_type(name: Column) -> Column:
    """A parameter's type without generics, dots for many, and one pair of brackets."""
    plain = F.regexp_replace(name, r"(?s)(?<=.)<.*", "")
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(plain, r"[.][.][.]$", ""), r"\[\]$", "")), F.lit(""))


def readme(text: Column) -> Column:
    """The part of a README that is kept; null if it is blank."""
    cut = F.concat(F.substring(text, 1, README_CHARS), F.lit("\n...(truncated)"))
    kept = F.when(F.char_length(text) > README_CHARS, cut).otherwise(text)
    return F.when(F.char_length(F.trim(text)) > 0, kept)


def readme_description(text: Column) -> Column:
    return F.substring(readme(text), 1, DESCRIPTION_CHARS)


def json_in_reply(reply: Column) -> Column:
    """The JSON object in a model's reply: from the first brace to the last; ``{}`` if it is blank."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```\w*\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.coalesce(F.trim(reply), F.lit("")) == "", F.lit("{}")).otherwise(F.when(inner != "", inner).otherwise(bare))


def lenient_list(text: Column) -> Column:
    """A JSON list as it is, other text as one element, and none for blank text and other JSON values."""
    bare = F.trim(text)
    plain = F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).when(F.regexp_like(bare, F.lit(r"^[{\[]")), json_list(bare))
    return plain.otherwise(F.array(text))


def route_path(path: Column) -> Column:
    """app/api/users/[id]/route.ts -> /api/users/:id; null for files that are no routes."""
    inner = F.regexp_extract(path, r"^.*?app/(.*)/route[.][^/]*$", 1)
    return F.when(F.regexp_like(path, F.lit(r"app/.*/route[.]")), F.concat(F.lit("/"), F.regexp_replace(inner, r"\[([^\]]+)\]", ":$1")))
