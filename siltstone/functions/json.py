"""JSON out of model replies: fences, embedded objects, validation in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import strip

KEYS = ["entities", "key_points", "sentiment", "summary", "why_it_matters"]  # fixed values, sorted
SENTIMENTS = ["positive", "negative", "neutral"]  # fixed values


def unfenced(c: Column) -> Column:
    """Without a surrounding Markdown code fence."""
    return strip(F.regexp_replace(strip(c), r"^```(?:json)?[ \t]*\n?|\n?```$", ""))


def embedded_object(c: Column) -> Column:
    """From the first { to the last }, null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def field(c: Column, *names: str) -> Column:
    """The text of the first of several top-level fields that is present."""
    return F.coalesce(*[F.get_json_object(c, f"$.{n}") for n in names])


def _strings(c: Column) -> Column:
    return F.from_json(c, "array<string>")


def summary_fault(obj: Column) -> Column:
    """The first fault of a structured summary, ``valid`` if none; null input is no object."""
    keys = F.array_sort(F.json_object_keys(obj))
    text = lambda n: strip(F.coalesce(field(obj, n), F.lit("")))
    points, entities = field(obj, "key_points"), field(obj, "entities")
    blank = lambda a: F.exists(_strings(a), lambda x: x.isNull() | (strip(x) == ""))
    return (
        F.when(obj.isNull() | F.try_parse_json(obj).isNull() | keys.isNull(), "output is not a JSON object")
        .when(keys != F.array(*[F.lit(k) for k in KEYS]), "keys mismatch")
        .when(text("summary") == "", "summary must be a non-empty string")
        .when(~F.coalesce(points.startswith("["), F.lit(False)), "key_points must be a list")
        .when(~F.coalesce(F.json_array_length(points).between(3, 5), F.lit(False)), "key_points must contain 3 to 5 items")
        .when(F.coalesce(blank(points), F.lit(True)), "all key_points items must be non-empty strings")
        .when(~F.coalesce(field(obj, "sentiment").isin(SENTIMENTS), F.lit(False)), "sentiment is not allowed")
        .when(~F.coalesce(entities.startswith("["), F.lit(False)), "entities must be a list")
        .when(F.coalesce(blank(entities), F.lit(True)), "all entities must be non-empty strings")
        .when(text("why_it_matters") == "", "why_it_matters must be a non-empty string")
        .otherwise("valid")
    )


def target(c: Column) -> Column:
    """A structured summary as JSON in the fixed key order summary, key_points, sentiment, entities, why_it_matters."""
    kinds = {"summary": "string", "key_points": "array<string>", "sentiment": "string", "entities": "array<string>", "why_it_matters": "string"}
    body = F.from_json(c, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return F.to_json(F.struct(*[body[n].alias(n) for n in kinds]))


def string_list(c: Column) -> Column:
    """A list from the text of one, with single or double quotes; null and blank give an empty list."""
    text = strip(F.coalesce(c, F.lit("")))
    quoted = F.when(text.contains('"'), text).otherwise(F.translate(text, "'", '"'))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(_strings(quoted))
