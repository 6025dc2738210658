"""Parsing of stored model replies: fenced, wrapped in prose, or cut off half-way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import text_or_empty


def strip_fences(c) -> Column:
    c = F.regexp_replace(F.trim(text_or_empty(c)), r"^```[a-z]*\n?", "")
    return F.regexp_replace(c, r"\n?```$", "")


def _typed(json_text: Column, schema: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json_text), "$", schema)


def parse_reply(c, schema: str, default: Column) -> Column:
    """The reply as a struct: the whole text, else its outermost braces, else the default."""
    t = strip_fences(c)
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.coalesce(_typed(t, schema), _typed(F.nullif(braces, F.lit("")), schema), default)


def checked_label(c: Column, allowed, aliases: dict[str, str] | None = None) -> Column:
    """A label of the allowed set after aliasing; null for anything else."""
    for alias, label in (aliases or {}).items():
        c = F.when(c == alias, F.lit(label)).otherwise(c)
    return F.when(c.isin(*allowed), c)


def parse_reply_array(c, element: str) -> Column:
    """Array of objects; a list cut off half-way is closed after its last whole object."""
    t = strip_fences(c)
    start = F.instr(t, "[")
    body = F.when(start > 0, F.substr(t, start))
    whole = F.regexp_extract(body, r"(?s)^.*\]", 0)
    before_comma = F.regexp_extract(body, r"(?s)^(.*\}),", 1)
    last_brace = F.regexp_extract(body, r"(?s)^.*\}", 0)
    cut = F.when(before_comma != "", before_comma).otherwise(last_brace)
    return F.coalesce(
        _typed(F.nullif(whole, F.lit("")), f"array<{element}>"),
        _typed(F.concat(F.nullif(cut, F.lit("")), F.lit("]")), f"array<{element}>"),
        F.array().cast(f"array<{element}>"),
    )
