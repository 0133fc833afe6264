"""Comment and white-space stripping of source text as one JVM expression.

A text is cut into tokens by one pattern; comments become nothing (a block comment keeps its line
feeds), all other tokens stay. Quantifiers are possessive, so long tokens need no deep recursion.
The rules know no language: # and // begin a comment everywhere but in strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_TOKENS = "(?s)" + "|".join(
    (
        r"#[\[!]",  # attributes and the shebang stay
        r"#[^\n]*+",
        r"//[^\n]*+",
        r"/\*.*?(?:\*/|\z)",
        r"'(?=[A-Za-z_](?!')[A-Za-z0-9_]*+(?:[>,);|&+= \t\n\r]|\z))",  # a lifetime, not a string
        r'"{3}.*?(?:"{3}|\z)',
        r"'{3}.*?(?:'{3}|\z)",
        r"`{3}.*?(?:`{3}|\z)",
        r'"(?:[^"\\]|\\.)*+(?:"|\\?\z)',
        r"'(?:[^'\\]|\\.)*+(?:'|\\?\z)",
        r"`(?:[^`\\]|\\.)*+(?:`|\\?\z)",
        r'[bc]?r(?<h>#*+)".*?(?:"\k<h>|\z)',
        r"""(?:[^#/"'`rbc]|r(?!#*+")|[bc](?!r#*+"))++""",
        r".",
    )
)


@dataclass(frozen=True)
class CodeOptions:
    preserve_shebang: bool = True
    collapse_blank_lines: bool = True


def strip_comments(text: Column) -> Column:
    def kept(t: Column) -> Column:
        line = t.startswith("//") | (t.startswith("#") & ~t.startswith("#[") & ~t.startswith("#!"))
        return F.when(t.startswith("/*"), F.regexp_replace(t, r"[^\n]++", "")).when(line, "").otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), kept), "")


def tidy_lines(text: Column, options: CodeOptions = CodeOptions()) -> Column:
    """Line ends become line feeds, blanks before them go, and blank lines collapse.

    Leading and trailing blank lines go and a run of others becomes one. Without collapsing, all stay but
    a first one. The shebang needs no care of its own: the first line isn't blank then.
    """
    bare = F.regexp_replace(text, r"(?<![ \t\f])[ \t\f]*+\r?(?=\n|\z)", "")
    if options.collapse_blank_lines:
        bare = F.regexp_replace(bare, r"\A\n++", "")
        bare = F.regexp_replace(bare, r"\n{3,}+", "\n\n")
        return F.regexp_replace(bare, r"\n{2,}+\z", "\n")
    blank_end = text.rlike(r"\n(?:[ \t\f]++\r?|\r)\z")
    return F.concat(F.regexp_replace(bare, r"\A\n", ""), F.when(blank_end, "\n").otherwise(""))


def clean_code(text: Column, options: CodeOptions = CodeOptions()) -> Column:
    return tidy_lines(strip_comments(text), options)
