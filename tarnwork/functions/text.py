"""Text expressions that agree with ASCII-exact, Unicode-white-space string rules.

All are Column -> Column and stay in the JVM. Spark's own trim, lower and line anchors differ in
details (only blanks, full case folding, more line ends), so patterns spell out what is meant.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The White_Space property without and with the line feed.
WHITE = r"\p{IsWhite_Space}"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def trim_start(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITE}+", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!{WHITE}){WHITE}++\z", "")


def trim(text: Column) -> Column:
    return trim_end(trim_start(text))


def lines(text: Column) -> Column:
    """Lines without their ends; no empty piece after a final line feed, and one carriage return is part of the end."""
    pieces = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    pieces = F.when(text == "", F.array().cast("array<string>")).otherwise(pieces)
    return F.transform(pieces, lambda x: F.regexp_replace(x, r"\r\z", ""))


def tokens(text: Column) -> Column:
    """Lower-cased runs of at least two ASCII letters, digits and underscores, repeats kept."""
    return F.filter(F.split(ascii_lower(text), "[^A-Za-z0-9_]"), lambda t: F.length(t) >= 2)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once for a row.

    Inside a lambda an outer expression would be computed again for every element.
    """
    return F.transform(F.array(value), lambda x: use(x))[0]
