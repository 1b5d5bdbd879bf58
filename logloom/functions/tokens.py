"""Log tokens, parameter masks and token-array similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import BLANK, trim_space

WILDCARD = "<*>"

# fixed values: token separators
SEPARATORS = rf"""[{BLANK}\[\](){{}}<>"',;:!?]+"""

# fixed values: what counts as a parameter token
PARAMETER_PATTERNS = (
    r"\d+\z",
    r"\d+\.\d+\z",
    r"[0-9a-fA-F]{8,}\z",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}:\d{2}:\d{2}",
    r"(?:true|false|TRUE|FALSE)\z",
    rf"/[^{BLANK}]*\z",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z",
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\z",
)
PARAMETER = "^(?:" + "|".join(PARAMETER_PATTERNS) + ")"


# the same patterns inside a text of tokens with single spaces between them
_IN_TEXT = "(?<![^ ])(?:" + "|".join(
    p.replace(r"\z", "") if p.endswith(r"\z") else p + "[^ ]*" for p in PARAMETER_PATTERNS
) + ")(?![^ ])"


def token_text(body: Column) -> Column:
    """The tokens of a body joined by single spaces, without building the array."""
    return F.trim(F.regexp_replace(trim_space(F.coalesce(body, F.lit(""))), SEPARATORS, " "))


def mask_text(text: Column) -> Column:
    """Masked form of a token text: what reconstruct(mask_parameters(tokenize(body))) gives, in one pass."""
    return F.regexp_replace(text, _IN_TEXT, WILDCARD)


def count_tokens(text: Column) -> Column:
    """Number of tokens in a token text."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def tokenize(body: Column) -> Column:
    """Tokens of a log body; empty array when there are none."""
    return F.filter(F.split(trim_space(F.coalesce(body, F.lit(""))), SEPARATORS), lambda t: t != "")


def is_parameter(token: Column) -> Column:
    return token.rlike(PARAMETER)


def is_wildcard(token: Column) -> Column:
    return token == WILDCARD


def mask_parameters(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(is_parameter(t), F.lit(WILDCARD)).otherwise(t))


def reconstruct(tokens: Column) -> Column:
    return F.concat_ws(" ", tokens)


def token_similarity(a: Column, b: Column) -> Column:
    """Matching positions over the longer length; a wildcard on either side matches."""
    hits = F.zip_with(
        a, b, lambda x, y: x.isNotNull() & y.isNotNull() & ((x == y) | is_wildcard(x) | is_wildcard(y))
    )
    matched = F.size(F.filter(hits, lambda h: h))
    longest = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(matched / longest)


def merge_tokens(existing: Column, incoming: Column) -> Column:
    """Keep equal positions; differing or overhanging positions become wildcards."""
    return F.zip_with(existing, incoming, lambda x, y: F.when(x == y, x).otherwise(F.lit(WILDCARD)))
