"""Find the service an alert is about: text patterns, then JSON keys, then a word heuristic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.jsonv import json_document, json_object, string_member
from logloom.functions.text import BLANK, let, trim_space

# fixed values: label names in text, JSON keys in order of preference, nested objects, stop words
TEXT_LABELS = "service|app|job|namespace|service_name|serviceName"
NESTED_LABELS = "service|app|job"
JSON_KEYS = (
    "service", "service_name", "serviceName", "app", "app_name", "appName",
    "job", "namespace", "pod", "deployment", "service_id",
)
JSON_NESTED = ("labels", "commonLabels", "alert", "payload")
STOP_WORDS = (
    "is", "are", "was", "were", "has", "have", "had", "the", "a", "an", "this", "that",
    "to", "for", "of", "in", "on", "and", "or", "with", "from", "null", "unknown", "nil",
)

_START = r"(?<![0-9A-Za-z_])"
_VALUE = rf'[{BLANK}]*"?([^"{BLANK},;]+)"?'
TEXT_PATTERNS = (
    rf"{_START}(?:{TEXT_LABELS})[{BLANK}]*={_VALUE}",
    rf"{_START}(?:{TEXT_LABELS})[{BLANK}]*:{_VALUE}",
    rf"{_START}labels?\.(?:{NESTED_LABELS})[{BLANK}]*={_VALUE}",
)


def service_from_text(text: Column) -> Column:
    """First usable label value in the text, or NULL."""

    def usable(pattern: str) -> Column:
        found = F.btrim(trim_space(F.regexp_extract(text, pattern, 1)), F.lit("\"'"))
        return F.when((found != "") & (found != "null"), found)

    return F.coalesce(*[usable(p) for p in TEXT_PATTERNS])


def service_from_json(data: Column) -> Column:
    """First non-empty string among the known keys, at top level and then in the nested label objects."""
    keys = F.array(*[F.lit(k) for k in JSON_KEYS])

    def first_name(obj: Column) -> Column:
        names = F.transform(keys, lambda k: string_member(obj, k))
        return F.get(F.filter(names, lambda s: s.isNotNull() & (s != "") & (s != "null")), F.lit(0))

    def search(top: Column) -> Column:
        nested = [let(json_object(F.try_element_at(top, F.lit(n))), first_name) for n in JSON_NESTED]
        return F.coalesce(first_name(top), *nested)

    return let(json_object(json_document(data)), search)


def service_heuristic(text: Column) -> Column:
    """The word before the first 'service', else the word after it, or NULL."""

    def word_before(before: Column) -> Column:
        # a text that is one word is tested before trimming, the last of several words after it
        last = trim_space(F.regexp_extract(before, r"([^ \t]*)\z", 1))
        several = F.when(_is_name(last), last)
        return F.when(before.rlike(r"[ \t]"), several).otherwise(F.when(_is_name(before), trim_space(before)))

    def word_after(after: Column) -> Column:
        head = F.btrim(trim_space(F.regexp_extract(after, r"^([^ \t\n,;}]*)", 1)), F.lit("=\"':"))
        return F.when(~after.rlike('^[=:"]') & _is_name(head), head)

    def search(low: Column) -> Column:
        at = F.instr(low, "service")
        before = F.regexp_replace(F.substring(low, F.lit(1), at - 1), r"[ \t]+\z", "")
        after = F.regexp_replace(F.substring(low, at + len("service"), F.length(low)), r"^[ \t]+", "")
        return F.when(at > 0, F.coalesce(let(before, word_before), let(after, word_after)))

    return let(F.lower(text), search)


def _is_name(word: Column) -> Column:
    return (F.octet_length(word) >= 2) & ~word.isin(*STOP_WORDS)


def extract_service(alert: Column, message: Column, data: Column) -> Column:
    """Service name of an alert, or the empty string."""
    return F.coalesce(
        service_from_text(alert),
        service_from_text(message),
        service_from_json(data),
        service_heuristic(alert),
        service_heuristic(message),
        F.lit(""),
    )
