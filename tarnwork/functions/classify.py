"""Payload kind and source language by simple votes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tarnwork.functions import text as tx

#: Lines at the head of a text that take part in a vote.
VOTERS = 80
# What starts or marks a line of build output.
TICKER_STARTS = ("Compiling ", "Checking ", "Downloading ")
TICKER_PARTS = ("% |", "ETA")
# File endings and line starts of each language.
ENDINGS = {"rust": (".rs",), "python": (".py",), "javascript": (".js", ".jsx", ".ts", ".tsx")}
STARTS = {
    "rust": ("fn ", "pub fn ", "impl ", "struct ", "enum "),
    "python": ("def ", "class ", "async def "),
    "javascript": ("function ", "export function "),
}


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def looks_like_json(text: Column) -> Column:
    body = tx.trim(text)
    closed = (body.startswith("{") & body.endswith("}")) | (body.startswith("[") & body.endswith("]"))
    return closed & _any(body.contains(x) for x in (":", "true", "null"))


def _head(text: Column) -> Column:
    # The rest of the text is one more piece, so a long text isn't cut up.
    return F.transform(F.slice(F.split(text, "\n", VOTERS + 1), 1, VOTERS), tx.trim)


def looks_like_log(text: Column) -> Column:
    def ticks(line: Column) -> Column:
        return _any(line.startswith(x) for x in TICKER_STARTS) | _any(line.contains(x) for x in TICKER_PARTS) | (line.startswith("[") & line.contains("/"))

    two = lambda c: F.when(c, 2).otherwise(0)
    score = two(text.contains("\r")) + two(text.contains("\x1b[")) + two(text.contains("[1/") | text.contains("[ 1/"))
    return score + F.floor(F.size(F.filter(_head(text), ticks)) / 2) >= 3


def payload_kind(text: Column) -> Column:
    """json, log or code."""
    return F.when(looks_like_json(text), "json").when(looks_like_log(text), "log").otherwise("code")


def language(path: Column, source: Column) -> Column:
    """rust, python, javascript or unknown: by the path's ending, else by the first lines; ties go in that order."""
    low = tx.ascii_lower(path)

    def votes(head: Column, starts: tuple[str, ...]) -> Column:
        return F.size(F.filter(head, lambda line: _any(line.startswith(x) for x in starts)))

    def winner(votes_of: Column) -> Column:
        most = F.array_max(votes_of)
        return F.when(most > 0, F.element_at(F.array(*map(F.lit, STARTS)), F.array_position(votes_of, most).cast("int"))).otherwise("unknown")

    by_lines = tx.bound(_head(source), lambda head: tx.bound(F.array(*(votes(head, starts) for starts in STARTS.values())), winner))
    out = F.when(F.lit(False), "")
    for name, ends in ENDINGS.items():
        out = out.when(_any(low.endswith(x) for x in ends), name)
    return out.otherwise(by_lines)
