"""LIKE and GLOB patterns as regular expressions and Spark patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII letters, which alone LIKE, lower() and upper() fold, and the ASCII white space that trim() strips.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def fold(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def _plain(x: str) -> str:
    return f"octet_length({x}) = char_length({x})"


def lower_sql(x: str) -> str:
    """x with A-Z lower-cased. On pure ASCII, Spark's own function does the same, and faster."""
    text = f"CAST({x} AS STRING)"
    return f"(CASE WHEN {_plain(text)} THEN lower({text}) ELSE translate({text}, '{UPPER}', '{LOWER}') END)"


def upper_sql(x: str) -> str:
    text = f"CAST({x} AS STRING)"
    return f"(CASE WHEN {_plain(text)} THEN upper({text}) ELSE translate({text}, '{LOWER}', '{UPPER}') END)"


def lower(x: Column) -> Column:
    text = x.cast("string")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def upper(x: Column) -> Column:
    text = x.cast("string")
    return F.when(F.octet_length(text) == F.char_length(text), F.upper(text)).otherwise(F.translate(text, LOWER, UPPER))


def like_pattern(pattern: str) -> str:
    """A pattern for Spark's LIKE that has no escapes of its own; its text is to be folded too."""
    return fold(pattern).replace("\\", "\\\\")


def glob_regex(pattern: str) -> str:
    """``*``, ``?``, ``[abc]``, ``[a-z]``, ``[^x]`` and ``[!x]``; a bracket without an end stands for itself."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] in ("^", "!")))) > 0:
            body, negated = pattern[i:end], pattern[i] in "^!"
            body = body[1:] if negated else body
            inner = "".join("-" if x == "-" and 0 < k < len(body) - 1 else re.escape(x) if not x.isalnum() else x for k, x in enumerate(body))
            out.append(f"[{'^' * negated}{inner}]")
            i = end + 1
        else:
            out.append("\\" + c if c in r"\^$.|?*+()[]{}" else c)
    return "".join(out) + "$"


def like(text: Column, pattern: str) -> Column:
    return lower(text).like(like_pattern(pattern))


def glob(text: Column, pattern: str) -> Column:
    return text.cast("string").rlike(glob_regex(pattern))


def contains(text: Column, part: str) -> Column:
    return F.contains(lower(text), F.lit(fold(part)))


def starts_with(text: Column, part: str) -> Column:
    return F.startswith(lower(text), F.lit(fold(part)))


def ends_with(text: Column, part: str) -> Column:
    return F.endswith(lower(text), F.lit(fold(part)))
