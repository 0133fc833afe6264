"""Structural scopes of source files: one row per function, type, trait, implementation or module.

Headers are found by pattern and closed by matching braces or indentation, file by file in Arrow
batches. Offsets are in bytes, line numbers start at 1, points are 0-based row and byte column.
The imports, call sites and struct fields that the graph needs are taken in the same pass.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwork.functions import classify

# Header patterns of each language, in order.
_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
_PATH = r"([A-Za-z_][A-Za-z0-9_:]*)"
_VIS = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
HEADERS = {
    "rust": (
        ("function", rf'^[\t ]*{_VIS}(?:async\s+)?(?:const\s+)?(?:unsafe\s+)?(?:extern\s+(?:"[^"]+"\s+)?)?fn\s+{_NAME}'),
        ("struct", rf"^[\t ]*{_VIS}struct\s+{_NAME}"),
        ("enum", rf"^[\t ]*{_VIS}enum\s+{_NAME}"),
        ("trait", rf"^[\t ]*{_VIS}(?:unsafe\s+)?(?:auto\s+)?trait\s+{_NAME}"),
        ("impl", rf"^[\t ]*{_VIS}(?:unsafe\s+)?impl\b(?:\s*<[^>]*>)?\s*(?:{_PATH}\s+for\s+)?{_PATH}"),
        ("module", rf"^[\t ]*{_VIS}mod\s+{_NAME}"),
    ),
    "python": (
        ("function", rf"^([ \t]*)(?:async\s+)?def\s+{_NAME}"),
        ("class", rf"^([ \t]*)class\s+{_NAME}"),
    ),
    "javascript": (
        ("function", rf"^[\t ]*(?:export\s+)?(?:async\s+)?function\s+{_NAME}"),
        ("class", rf"^[\t ]*(?:export\s+)?class\s+{_NAME}"),
        ("function", rf"^[\t ]*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_][A-Za-z0-9_]*)\s*=>"),
    ),
}
USE = r"^\s*(?:pub\s+)?use\s+([A-Za-z0-9_:,\{\}\s]+);"
IMPORT = r"^\s*(?:from\s+([A-Za-z0-9_\.]+)\s+import\s+([A-Za-z0-9_\*,\s]+)|import\s+([A-Za-z0-9_\.]+))"
DEFINING = ("def", "class", "fn", "struct", "enum", "trait", "mod", "impl")
NOT_NAMES = ("self", "super", "crate")
CALLABLE = ("function", "method")

_headers = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in HEADERS.items()}
_use, _import = re.compile(USE, re.M), re.compile(IMPORT, re.M)
_braces = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|'(?:[^'\\]|\\.)*+(?:'|\\?\Z)|[{};]""", re.S)
_brackets = re.compile(r""""(?:[^"\\]|\\.)*+(?:"|\\?\Z)|'(?:[^'\\]|\\.)*+(?:'|\\?\Z)|[][(){}:]""", re.S)
_sites = re.compile(r"(?<!\w)\w+(?:::\w+)*(?=[\t ]*(?:\(|::))")
_lead = re.compile(r"[ \t]*")

CHUNK = (
    "file_path string, name string, kind string, line_start int, line_end int, byte_start int, byte_end int, "
    "start_row int, start_col int, end_row int, end_col int, source string, position int, calls array<string>, fields array<string>"
)


def is_callable(kind: Column) -> Column:
    return kind.isin(*CALLABLE)


def chunk_id() -> Column:
    """path:kind:name:line."""
    return F.concat_ws(":", "file_path", "kind", "name", F.col("line_start").cast("string"))


def _indent(line: str) -> int:
    return _lead.match(line).end()


def brace_end(text: str, at: int) -> int | None:
    """Where the block that opens after ``at`` ends; a semicolon before any brace ends it at once.

    Closing braces before the first opening one belong to what surrounds the header and are passed over.
    """
    depth = 0
    for m in _braces.finditer(text, at):
        match m[0]:
            case "{":
                depth += 1
            case ";" if not depth:
                return m.end()
            case "}" if depth == 1:
                return m.end()
            case "}":
                depth = max(depth - 1, 0)
    return None


def indent_end(text: str, at: int, indent: int) -> int | None:
    """Where the indented block ends whose header goes on at ``at``: deeper and blank lines belong to it."""
    depth = 0
    for m in _brackets.finditer(text, at):
        c = m[0]
        if c == ":" and not depth:
            break
        depth += (c in "([{") - (c in ")]}") if len(c) == 1 else 0
    else:
        return None
    end = text.find("\n", m.start()) + 1 or len(text)
    while end < len(text):
        after = text.find("\n", end) + 1 or len(text)
        line = text[end:after]
        if line.strip() and _indent(line) <= indent:
            break
        end = after
    return end


def _with_decorators(text: str, start: int, indent: int) -> int:
    """The start of the decorators and blank lines right above a definition."""
    while start:
        before = text.rfind("\n", 0, start - 1) + 1
        line = text[before : start - 1]
        if line.strip() and not (_indent(line) == indent and line.strip().startswith("@")):
            break
        start = before
    return start


def headers(text: str, lang: str) -> list[tuple[int, int, str, str, int]]:
    """start, end, kind, name and indent of each header, in order of start."""
    out = []
    for kind, pattern in _headers[lang]:
        for m in pattern.finditer(text):
            if lang == "python":
                indent = len(m[1])
                out.append((_with_decorators(text, m.start(), indent), m.end(), "method" if kind == "function" and indent else kind, m[2], indent))
            else:
                out.append((m.start(), m.end(), kind, m[2] if kind == "impl" else m[1], 0))
    return out


def call_sites(text: str) -> list[str]:
    """Names, and paths joined by ::, that are called or qualify a call, other than where they are defined."""
    out = set()
    for m in _sites.finditer(text):
        parts = m[0].split("::")
        at = m.start()
        begin = text.rfind("\n", 0, max(at - 1, 0)) + 1
        words = re.split(r"[\s:>]", text[begin : max(at - 1, 0)].rstrip())
        first = 1 if words[-1] in DEFINING else 0
        # A part after :: has nothing but that before it, which never defines.
        for i in range(first, len(parts)):
            for j in range(i, len(parts)):
                out.add("::".join(parts[i : j + 1]))
    return sorted(out)


def _imported(text: str):
    """Names brought in by each statement, with repeats: the parts of a used path; a module's last part and its listed names."""
    for use in _use.finditer(text):
        yield from (part for part in map(str.strip, re.split(r"[:{}, \n]", use[1])) if part not in ("", *NOT_NAMES))
    for module, listed, plain in _import.findall(text):
        yield (module or plain).rpartition(".")[2]
        # An alias is the last word of its entry.
        yield from (entry.split()[-1] for entry in listed.split(",") if entry.strip() not in ("", "*"))


def imports(text: str) -> list[str]:
    """Names that a file's use and import statements bring in, distinct and sorted."""
    return sorted(set(_imported(text)))


def struct_fields(text: str) -> list[str]:
    """Field names of a struct: what stands before the colon in the lines after its first brace."""
    out, inside = [], False
    for line in text.split("\n"):
        line = line.strip()
        if "{" in line:
            inside = True
        elif line.startswith("}"):
            break
        elif inside:
            while line.startswith("pub "):
                line = line[4:]
            name, colon, _ = line.partition(":")
            if colon and re.fullmatch(r"[A-Za-z0-9_]+", name.strip()):
                out.append(name.strip())
    return out


def scopes(path: str, text: str, lang: str) -> list[dict]:
    """The chunk rows of a file."""
    found = headers(text, lang) if lang in ("python", "javascript") else headers(text, "rust") or headers(text, "python") + headers(text, "javascript")
    found.sort(key=lambda h: h[0])
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    # Bytes before each line; within a line they are counted when needed.
    before = [0, *accumulate(len(text[a:b].encode()) for a, b in zip(starts, [*starts[1:], len(text)]))]

    def point(at: int) -> tuple[int, int, int]:
        row = bisect_right(starts, at) - 1
        column = len(text[starts[row] : at].encode())
        return before[row] + column, row, column

    out = []
    for start, end, kind, name, indent in found:
        close = indent_end(text, end, indent) if lang == "python" else brace_end(text, end)
        if close is None and lang != "python":
            close = indent_end(text, end, indent)
        if close is None or close <= start:
            continue
        (b0, r0, c0), (b1, r1, c1), (_, last, _) = point(start), point(close), point(close - 1)
        source = text[start:close]
        out.append(
            {
                "file_path": path, "name": name, "kind": kind, "line_start": r0 + 1, "line_end": last + 1, "byte_start": b0, "byte_end": b1,
                "start_row": r0, "start_col": c0, "end_row": r1, "end_col": c1, "source": source, "position": len(out),
                "calls": call_sites(source), "fields": struct_fields(source) if kind == "struct" else [],
            }
        )
    return out


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def parse_files(files: DataFrame) -> DataFrame:
    """Chunks of the files (file_path, source); null rows give none."""
    schema = _arrow_schema(CHUNK)
    files = files.select("file_path", "source", classify.language(F.col("file_path"), F.col("source")).alias("lang")).where("file_path IS NOT NULL AND source IS NOT NULL")

    def run(batches):
        for batch in batches:
            rows = [row for path, text, lang in zip(*(c.to_pylist() for c in batch.columns)) for row in scopes(path, text, lang)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, CHUNK).withColumn("chunk_id", chunk_id())


def parse_imports(files: DataFrame) -> DataFrame:
    """file_path and name, a row per imported name."""
    schema = pa.schema([("file_path", pa.string()), ("name", pa.string())])

    def run(batches):
        for batch in batches:
            rows = [{"file_path": p, "name": n} for p, t in zip(*(c.to_pylist() for c in batch.columns)) if p is not None and t is not None for n in imports(t)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("file_path", "source").mapInArrow(run, "file_path string, name string")


def line_offsets(texts: DataFrame, key: str, text: str) -> DataFrame:
    """A row per line of each text: key, line (from 1), byte_start and n_bytes. Only lengths are shuffled."""
    rows = texts.select(key, F.monotonically_increasing_id().alias("_row"), F.transform(F.split(text, "\n"), F.octet_length).alias("_n"))
    rows = rows.select(key, "_row", F.posexplode("_n").alias("_i", "n_bytes"))
    before = Window.partitionBy("_row").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.col("n_bytes") + 1).over(before), F.lit(0))
    return rows.select(key, (F.col("_i") + 1).alias("line"), begin.alias("byte_start"), "n_bytes")
