"""JSON documents as VARIANT with strict whole-text parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import let


def json_document(text: Column) -> Column:
    """The single JSON document in the text, or NULL; trailing text makes it invalid.

    Wrapping in brackets turns trailing text into a syntax error or a second element.
    """
    items = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    return let(items, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))


def json_type(doc: Column) -> Column:
    """VOID, STRING, BIGINT, BOOLEAN, OBJECT<…>, ARRAY<…> …"""
    return F.schema_of_variant(doc)


def json_object(doc: Column) -> Column:
    """Members of an object as a map, NULL for anything else."""
    return let(
        doc, lambda d: F.when(json_type(d).startswith("OBJECT"), F.try_variant_get(d, "$", "map<string,variant>"))
    )


def string_member(members: Column, key: Column) -> Column:
    """A member that is a JSON string, else NULL."""
    return let(
        F.try_element_at(members, key),
        lambda v: F.when(json_type(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )
