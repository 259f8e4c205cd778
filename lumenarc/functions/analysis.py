"""Analysis replies and media bytes: what is accepted, and why not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenarc.functions.text import CONTENT_TYPES, normalize_content_type

#: Fields of an analysis.
TEXT_FIELDS = ("description", "meme_context")
LIST_FIELDS = ("tags", "emotions", "subjects", "suggested_search_phrases")


def normalized(reply: str | Column) -> Column:
    """A JSON reply as a struct of all fields and `error`, the first field of a wrong type.

    Missing or null fields are empty. What is no JSON object has the error `object`; with an error, no field is filled.
    """
    raw = F.col(reply) if isinstance(reply, str) else reply
    doc = F.try_parse_json(raw)
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{f}", "variant")), F.lit("VOID"))
    items = lambda f: F.try_variant_get(doc, f"$.{f}", "array<string>")
    no_object = F.coalesce(~F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(True))
    wrong = F.when(no_object, F.lit("object"))
    for f in TEXT_FIELDS:
        wrong = wrong.when(~kind(f).isin("STRING", "VOID"), F.lit(f))
    for f in LIST_FIELDS:
        holed = F.coalesce(F.exists(items(f), lambda x: x.isNull()), F.lit(False))
        wrong = wrong.when(~kind(f).isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID") | holed, F.lit(f))
    texts = [F.when(wrong.isNull(), F.coalesce(F.try_variant_get(doc, f"$.{f}", "string"), F.lit(""))).alias(f) for f in TEXT_FIELDS]
    lists = [F.when(wrong.isNull(), F.coalesce(items(f), F.array().cast("array<string>"))).alias(f) for f in LIST_FIELDS]
    return F.struct(*texts, *lists, wrong.alias("error"))


def json_array(values: str | Column) -> Column:
    """A list as JSON; null is an empty list."""
    v = F.col(values) if isinstance(values, str) else values
    return F.to_json(F.coalesce(v, F.array().cast("array<string>")))


def media_problem(declared: str | Column, found: str | Column) -> Column:
    """Why media are refused: the declared type is not accepted, the bytes are of no known type, or both differ; else null."""
    said, is_ = normalize_content_type(declared), F.col(found) if isinstance(found, str) else found
    accepted = list(CONTENT_TYPES)
    return F.when(said.isNotNull() & ~said.isin(*accepted), "unsupported").when(is_.isNull() | ~is_.isin(*accepted), "unknown content").when(said != is_, "mismatch")
