"""Build-log compression as JVM expressions: frames, escapes and tickers within lines, then runs of lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tarnwork.functions import text as tx

# Escape sequences; tickers, removed in this order; lines that are dropped; starts of compile lines.
ANSI = r"\x1b(?:\[[0-9;?]*[A-Za-z]|\].*?(?:\x07|\x1b\\)|[()][AB012])"
TICKERS = (
    r"\[\s*\d+\s*/\s*\d+\s*\]",
    r"\(\s*\d+\s*/\s*\d+\s*\)",
    r"\{\s*\d+\s*/\s*\d+\s*\}",
    r"\b\d{1,3}(?:\.\d+)?\s*%",
    r"\b\d+(?:\.\d+)?\s*(?:[kKmMgGtT]i?[bB])/s\b",
    r"\[\s*[=#\-\x{2500}-\x{259F}]{2,}[>\s]*\]",
    r"\x{2588}{2,}|\x{2593}{2,}|\x{2591}{2,}",
    r"(?i)\b(?:eta|elapsed|remaining|took)\s*[:=]?\s*\d+[smh:\d]*",
    r"(?i)\b(?:building|compiling|linking|downloading)\s*\[\s*[\d\s/%]+\]",
)
DROPPED = (
    r"^[\s\|/\-\\\.\x{2800}-\x{28FF}\x{2022}\x{2219}\*]+\z",
    r"(?i)^\s*(?:progress|downloading|waiting|installing)[:\s].*\z",
    r"^\s*\d+\s*/\s*\d+\s*\z",
    r"^\s*\[=+>+?\s*\]\s*\z",
)
COMPILE_STARTS = ("Compiling ", "Checking ", "Downloading ", "Downloaded ", "Fresh ")
#: Classes and case as in Unicode, and only the line feed ends a line.
_MODE = "(?Ud)"
#: First character of every line while runs are searched: compile line or another one.
_COMPILE, _OTHER = "c", "o"


def last_frame(line: Column) -> Column:
    """What a terminal shows: the text after the last carriage return."""
    return F.substring_index(line, "\r", -1)


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, _MODE + ANSI, "")


def strip_tickers(line: Column) -> Column:
    for pattern in TICKERS:
        line = F.regexp_replace(line, _MODE + pattern, "")
    return line


def collapse_blanks(line: Column) -> Column:
    return F.regexp_replace(line, "[ \t]++", " ")


def is_dropped(line: Column) -> Column:
    out = F.lit(False)
    for pattern in DROPPED:
        out = out | line.rlike(_MODE + pattern)
    return out


def is_compile_line(line: Column) -> Column:
    out = F.lit(False)
    for start in COMPILE_STARTS:
        out = out | line.startswith(start)
    return out


def clean_line(line: Column) -> Column:
    return tx.trim(collapse_blanks(strip_tickers(strip_ansi(last_frame(line)))))


def crate_token(line: Column) -> Column:
    parts = F.filter(F.split(line, rf"{tx.WHITE}+"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(2)), line)


def compress_run(run: Column) -> Column:
    """An array of a run's distinct lines as (line, always): up to three lines, or first, summary and last."""
    entry = lambda line, always: F.struct(line.alias("line"), F.lit(always).alias("always"))
    first, last = F.try_element_at(run, F.lit(1)), F.try_element_at(run, F.lit(-1))
    summary = F.concat(F.lit("compiled "), F.size(run).cast("string"), F.lit(" crates ("), crate_token(first), F.lit(" … "), crate_token(last), F.lit(")"))
    return F.when(F.size(run) <= 3, F.transform(run, lambda x: entry(x, False))).otherwise(F.array(entry(first, True), entry(summary, True), entry(last, True)))


def compress_lines(lines: Column) -> Column:
    """Cleaned lines in order (empty: a gap) without repeats and with long compile runs summed up.

    Every line gets a first character that tells compile lines from others, whatever they hold, and all
    are joined, so that one linear pattern finds the runs.
    """
    marked = F.transform(lines, lambda x: F.concat(F.when(is_compile_line(x), _COMPILE).otherwise(_OTHER), x, F.lit("\n")))
    parts = F.regexp_extract_all(F.array_join(marked, ""), F.lit(rf"(?:{_COMPILE}[^\n]*+\n)++|{_OTHER}[^\n]*+\n"), F.lit(0))
    bare = lambda p: F.transform(F.split(F.regexp_replace(p, r"\n\z", ""), "\n"), lambda x: F.substr(x, F.lit(2)))
    single = lambda p: F.array(F.struct(bare(p)[0].alias("line"), F.lit(False).alias("always")))
    entries = F.flatten(F.transform(parts, lambda p: F.when(p.startswith(_COMPILE), compress_run(F.array_distinct(bare(p)))).otherwise(single(p))))
    entries = F.filter(entries, lambda e: e["line"] != "")
    # A skipped line equals the one before it, so comparing with the entry before is comparing with the line last kept.
    fresh = lambda all_of, e, i: e["always"] | (i == 0) | (e["line"] != F.get(all_of, i - 1)["line"])
    marks = tx.bound(entries, lambda all_of: F.transform(all_of, lambda e, i: F.when(fresh(all_of, e, i), e["line"])))
    return F.filter(marks, lambda x: x.isNotNull())


def clean_log(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), clean_line)
    out = F.array_join(compress_lines(F.filter(lines, lambda x: ~is_dropped(x) | (x == ""))), "\n")
    return F.when(text.endswith("\n") & (out != "") & ~out.endswith("\n"), F.concat(out, F.lit("\n"))).otherwise(out)
