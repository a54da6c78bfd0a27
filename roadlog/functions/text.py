"""Text helpers of the log parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_id(data: Column) -> Column:
    """Array of byte values to a hex string with two digits per byte."""
    return F.concat_ws("", F.transform(data, lambda b: F.lpad(F.lower(F.hex(F.pmod(b, F.lit(256)))), 2, "0")))


def unescape(text: Column) -> Column:
    """Undo the escapes that log lines put on markup."""
    for escaped, plain in ((r"\\u003e", ">"), (r"\\u003c", "<"), (r"\\n", "")):
        text = F.regexp_replace(text, escaped, plain)
    return F.regexp_replace(text, r"\\", '"')


def field_of(text: Column | str, name: str, item: str = ",", pair: str = ":") -> Column:
    """Value of a name in `k:v,k:v` text, without blanks around it; the last one when repeated, null when absent."""
    sep = re.escape(item)
    pattern = rf"(?s)^(?:.*{sep})?\s*{re.escape(name)}\s*{re.escape(pair)}\s*([^{sep}]*?)\s*(?:{sep}.*)?$"
    # the greedy start makes the last occurrence win
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def any_of(column: Column, words: list[str]) -> Column:
    """True when the text contains any of the words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | column.contains(word)
    return hit


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def last_rule(rules: list[tuple[Column, str]], default: Column | None = None) -> Column:
    """Label of the last rule that holds."""
    chain = None
    for condition, label in reversed(rules):
        chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    return chain if default is None else chain.otherwise(default)


def first_rule(rules: list[tuple[Column, str]], default: Column | None = None) -> Column:
    """Label of the first rule that holds."""
    return last_rule(list(reversed(rules)), default)


def decode(code: Column, labels: dict, other: str = "other") -> Column:
    """Label of an enum value, or `other`."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[code], F.lit(other))
