"""Query strings, paths and label text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(text: Column) -> Column:
    """Percent-decode (``+`` is a space); text with a malformed escape stays as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; empty where there is none, NULL for NULL."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + 1)).when(at == 0, F.lit(""))


def path_of(endpoint: Column) -> Column:
    return _before(endpoint, "?")


def query_of(endpoint: Column) -> Column:
    return _after(endpoint, "?")


def query_param(endpoint: Column, key: str) -> Column:
    """Decoded value of the first parameter named ``key``: NULL if absent, empty if it has no ``=``."""
    pairs = F.split(query_of(endpoint), "&")
    found = F.filter(pairs, lambda pair: decode(_before(pair, "=")) == F.lit(key))
    return decode(_after(F.get(found, F.lit(0)), "="))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def label_text(text: Column) -> Column:
    """Escape backslash, double quote and newline for a quoted label value."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))
