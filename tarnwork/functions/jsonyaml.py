"""JSON to block YAML and back, keeping key order, repeated keys and the digits of numbers.

Python's parser does the reading, with hooks that keep what Spark's variants would lose. Texts that
aren't JSON stay as they are. Columns go through Arrow in batches; flat objects with known keys also
have an expression that stays in the JVM.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tarnwork.functions import text as tx


class Number(str):
    """A number as it was written."""


class Pairs(list):
    """An object: its (key, value) pairs in order."""


# Words that YAML reads as other than strings, and characters that need quotes first or anywhere.
RESERVED = ("true", "false", "null", "yes", "no", "on", "off", "y", "n", "~")
FIRST = "-?:{}[],&*!|>'\"%@`#"
ANYWHERE = ":#&,"
NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}

_number = re.compile(NUMBER)
#: Words that Python's reader takes for numbers, outside strings.
_constant = re.compile(r'"(?:[^"\\]|\\.)*+"|(-?(?:NaN|Infinity))', re.S)
_surrogate = re.compile(r"(?<!\\)(?:\\\\)*\\u[dD][89a-fA-F]")
_blank = re.compile(r"[ \n\r\t]*")
_white = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _not_json(_):
    raise ValueError("not a JSON literal")


_decoder = json.JSONDecoder(object_pairs_hook=Pairs, parse_float=Number, parse_int=Number, parse_constant=_not_json, strict=False)


def read_json(text: str):
    """The value of a JSON text; JSONDecodeError, at the place where reading stopped, if it isn't one. Escaped surrogates aren't accepted."""
    if surrogate := _surrogate.search(text):
        raise json.JSONDecodeError("Surrogate escape", text, surrogate.end() - 4)
    value, end = _decoder.raw_decode(text, _blank.match(text).end())
    if (end := _blank.match(text, end).end()) < len(text):
        raise json.JSONDecodeError("Extra data", text, end)
    return value


def is_plain(s: str) -> bool:
    return bool(s) and tx_lower(s) not in RESERVED and not _number.fullmatch(s) and s[0] not in FIRST and not any(c in s for c in ANYWHERE) and not _white.search(s)


def tx_lower(s: str) -> str:
    return s.lower() if s.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def _escaped(s: str) -> str:
    return '"' + "".join(ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def _scalar(value) -> str | None:
    """How a value looks on one line; None for a container with members."""
    if value is None or value is True or value is False:
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return value if is_plain(value) else _escaped(value)
    if value:
        return None
    return "{}" if isinstance(value, Pairs) else "[]"


def _members(value, depth: int):
    """The lines of a container's members, without the first one's indent."""
    pad = " " * depth
    if isinstance(value, Pairs):
        for key, item in value:
            name, flat = (key if is_plain(key) else _escaped(key)), _scalar(item)
            if flat is not None:
                yield f"{pad}{name}: {flat}"
            else:
                yield f"{pad}{name}:"
                yield from _members(item, depth + 2)
        return
    for item in value:
        flat = _scalar(item)
        if flat is not None:
            yield f"{pad}- {flat}"
        elif isinstance(item, Pairs):  # the first key stands behind the dash
            inner = _members(item, depth + 2)
            yield f"{pad}- {next(inner)[depth + 2:]}"
            yield from inner
        else:
            yield f"{pad}- "
            yield from _members(item, depth + 2)


def to_yaml(text: str | None) -> str | None:
    """Block YAML of a JSON text; any other text unchanged."""
    if text is None:
        return None
    try:
        value = read_json(text)
        flat = _scalar(value)
        out = flat if flat is not None else "\n".join(_members(value, 0))
    except (ValueError, RecursionError):
        return text
    return out + "\n" if text.endswith("\n") and not out.endswith("\n") else out


def to_json(value) -> str:
    """Compact JSON."""
    if isinstance(value, Pairs):
        return "{" + ",".join(f"{_escaped(k)}:{to_json(v)}" for k, v in value) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(to_json, value)) + "]"
    if isinstance(value, str) and not isinstance(value, Number):
        return _escaped(value)
    return _scalar(value)


def _unquoted(s: str) -> str:
    if len(s) < 2 or s[0] != '"' or s[-1] != '"':
        return s
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), s[1:-1], flags=re.S)


def _value(raw: str):
    named = {"[]": [], "{}": Pairs(), "null": None, "~": None, "true": True, "false": False}
    if raw in named:
        return named[raw]
    return Number(raw) if _number.fullmatch(raw) else _unquoted(raw)


#: A key and what follows: quoted, or up to the first colon.
_entry = re.compile(r'("(?:[^"\\]|\\.)*"|[^":][^:]*):(?: (.*))?\Z', re.S)


class _Reader:
    """Reads the block YAML that ``to_yaml`` writes, and inverts it for every JSON value."""

    def __init__(self, text: str):
        self.rows = [(len(x) - len(x.lstrip(" ")), x.lstrip(" ")) for x in text.split("\n") if x.strip(" ")]
        self.at = 0

    def block(self, depth: int):
        body = self.rows[self.at][1]
        return self.array(depth) if body == "-" or body.startswith("- ") else self.pairs(depth)

    def nested(self, depth: int):
        if self.at < len(self.rows) and self.rows[self.at][0] > depth:
            return self.block(self.rows[self.at][0])
        return None

    def pairs(self, depth: int):
        out = Pairs()
        while self.at < len(self.rows) and self.rows[self.at][0] == depth and (m := _entry.match(self.rows[self.at][1])) and not self.rows[self.at][1].startswith("- "):
            self.at += 1
            out.append((_unquoted(m[1]), self.nested(depth) if not m[2] else _value(m[2])))
        return out

    def array(self, depth: int):
        out = []
        while self.at < len(self.rows) and self.rows[self.at][0] == depth and self.rows[self.at][1][:1] == "-" and self.rows[self.at][1][:2] in ("-", "- "):
            rest = self.rows[self.at][1][2:]
            if not rest:
                self.at += 1
                out.append(self.nested(depth))
            elif (m := _entry.match(rest)):
                self.rows[self.at] = (depth + 2, rest)
                out.append(self.pairs(depth + 2))
            else:
                self.at += 1
                out.append(_value(rest))
        return out


def from_yaml(text: str | None) -> str | None:
    """Compact JSON of block YAML; null where the text isn't in the dialect or is nested deeper than Python's recursion limit."""
    if text is None:
        return None
    reader = _Reader(text)
    if not reader.rows:
        return None
    first = reader.rows[0][1]
    if len(reader.rows) == 1 and first != "-" and not first.startswith("- ") and not _entry.match(first):
        return to_json(_value(first))
    try:
        value = reader.block(reader.rows[0][0])
        return to_json(value) if reader.at == len(reader.rows) else None
    except RecursionError:
        return None


@pandas_udf(T.StringType())
def json_to_yaml(texts: pd.Series) -> pd.Series:
    return texts.map(to_yaml)


@pandas_udf(T.StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    return texts.map(from_yaml)


@pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("message", T.StringType()), T.StructField("position", T.IntegerType())]))
def json_error(texts: pd.Series) -> pd.DataFrame:
    """Whether a text is JSON, and else why not and where (characters from 0)."""

    def row(text):
        if text is None:
            return None, None, None
        try:
            read_json(text)
            return True, None, None
        except json.JSONDecodeError as e:
            return False, e.msg, e.pos
        except ValueError:
            return False, "Expecting value", next(m.start() for m in _constant.finditer(text) if m[1])
        except RecursionError:
            return False, "Nested too deeply", None

    out = pd.DataFrame([row(t) for t in texts], columns=["ok", "message", "position"])
    return out.astype({"position": "Int32"})


def plain_scalar(s: Column) -> Column:
    """Whether a string needs no quotes in YAML."""
    quoted = (s == "") | tx.ascii_lower(s).isin(*RESERVED) | s.rlike(rf"\A(?:{NUMBER})\z") | F.substring(s, 1, 1).isin(*FIRST)
    return ~(quoted | s.rlike(rf"[{ANYWHERE}]|{tx.WHITE}"))


def quoted_scalar(s: Column) -> Column:
    """A string as a YAML scalar. Control characters other than line feed, return and tab are left to ``json_to_yaml``."""
    body = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for c, e in ESCAPES.items():
        if c != "\\":
            body = F.replace(body, F.lit(c), F.lit(e))
    return F.when(plain_scalar(s), s).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def flat_object_yaml(text: Column, keys: tuple[str, ...]) -> Column:
    """Block YAML of flat JSON objects that hold these plain keys in this order with numbers, in the JVM; others are null."""
    gap = r"[ \t\r\n]*"
    member = lambda k: rf'"{re.escape(k)}"{gap}:{gap}({NUMBER})'
    pattern = rf"\A{gap}\{{{gap}" + rf"{gap},{gap}".join(map(member, keys)) + rf"{gap}\}}{gap}\z"
    parts = [F.concat(F.lit(f"{k}: "), F.regexp_extract(text, pattern, i + 1)) for i, k in enumerate(keys)]
    return F.when(text.rlike(pattern), F.concat(F.concat_ws("\n", *parts), F.when(text.endswith("\n"), "\n").otherwise("")))
