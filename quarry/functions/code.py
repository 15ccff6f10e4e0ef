"""Scalar functions on code, paths, weaknesses and repositories: column expressions, and scanners over Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def is_test_path(path: Column) -> Column:
    """Whether a path looks like a test's: a test folder, or .test. _test. spec. in it."""
    return F.concat(F.lit("/"), path).rlike(r"/tests?/|\.test\.|_test\.|spec\.")


def clean_file(path: Column) -> Column:
    """A path with / for \\ and without one leading ./; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^\./", ""), F.lit(""))


def clean_lines(start: Column, end: Column) -> tuple[Column, Column]:
    """Positive line numbers or null; the end is dropped where it's under the start or the start is missing."""
    a, b = F.expr("try_cast(null as bigint)"), F.expr("try_cast(null as bigint)")
    a = F.when(start.try_cast("bigint") > 0, start.try_cast("bigint")).otherwise(a)
    b = F.when((end.try_cast("bigint") > 0) & (end.try_cast("bigint") >= a), end.try_cast("bigint")).otherwise(b)
    return a, b


def clean_cwe(x: Column) -> Column:
    """CWE-n of a weakness's number at the end of a text, with or without the letters; else null."""
    n = F.regexp_extract(F.trim(x), r"(?i)^(?:CWE)?[\s:_-]*(\d{1,4})$", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n.cast("int").cast("string")))


def cwes(text: Column) -> Column:
    """The distinct weaknesses that a text names, by number."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)CWE[-_ ]?(\d{1,4})"), F.lit(1)), lambda x: x.cast("int"))
    return F.transform(F.array_sort(F.array_distinct(found)), lambda n: F.concat(F.lit("CWE-"), n.cast("string")))


def github_repo(url: Column) -> Column:
    """owner/name, lower-cased and without .git, of a repository's url; null if it's no such url."""
    parts = F.lower(F.regexp_extract(url, r"(?i)github\.com[/:]([\w.-]+/[\w.-]+)", 1))
    return F.nullif(F.regexp_replace(parts, r"\.git$", ""), F.lit(""))


def commit_of(url: Column) -> Column:
    """The commit's hash (7 to 40 digits, lower-cased) in a commit's url, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)/commits?/([0-9a-f]{7,40})(?:[^0-9a-z]|$)", 1)), F.lit(""))


def pull_of(url: Column) -> Column:
    """The number in a pull request's url, else null."""
    return F.nullif(F.regexp_extract(url, r"/pull/(\d+)", 1), F.lit("")).cast("bigint")


def function_name(full: Column) -> Column:
    """The bare name in a function's full name; null for module-level code and for no name.

    Four grammars: file::program:outer:name, file:<module>.Class.name, package.Class.name:type(types), and any other
    name, whose last part after . : or :: counts, without closing ().
    """
    x = F.trim(full)
    last = lambda rest, sep: F.nullif(F.element_at(F.split(rest, sep), -1), F.lit(""))
    script = F.regexp_extract(x, r"(?s)^.*?::program:*(.*?):*$", 1)
    module = F.regexp_extract(x, r"(?s)^.*?:<module>\.*(.*?)\.*$", 1)
    signed = F.regexp_extract(x, r"^([^:()\s]+):[^()]*\(.*\)$", 1)
    parts = F.filter(F.split(F.regexp_replace(x, r"\(\)$", ""), "::|[.:]"), lambda p: p != "")
    plain = F.when(F.size(parts) > 0, F.element_at(parts, -1))
    return F.when(x.contains("::program"), last(script, ":")).when(x.contains(":<module>"), last(module, r"\.")).when(signed != "", last(signed, r"\.")).otherwise(plain)


def keyword_query(text: Column, most: int = 32) -> Column:
    """The distinct letter runs of a text in their order, lower-cased, at most `most`, joined by blanks."""
    return F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))), 1, most), " ")


def stable_uid(*parts: Column) -> Column:
    """sha1 of the parts joined by |; a null part is an empty one, so that it doesn't move the others."""
    return F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


_QUOTED = r'"(?:\\.|[^"\\])*"?|\'(?:\\.|[^\'\\])*\'?|`(?:\\.|[^`\\])*`?'
#: By style of comment: quoted text, a comment to the line's end, a block comment (open or closed), or one character.
_TOKENS = {"c": re.compile(rf"(?P<q>{_QUOTED})|//(?P<tail>.*)|/\*(?P<block>.*?)(?P<end>\*/|$)|.", re.S), "hash": re.compile(rf"(?P<q>{_QUOTED})|#(?P<tail>.*)|.", re.S)}


def split_comment(line: str, in_block: bool = False, style: str = "c") -> tuple[str, str, bool]:
    """(code, comment, whether a block comment goes on) of one line.  Quoted text is code; it ends with the line."""
    notes, code, at = [], [], 0
    if in_block:
        inside, closed, _ = line.partition("*/")
        if not closed:
            return "", line, True
        notes.append(inside)
        at, in_block = len(inside) + 2, False
    for m in _TOKENS[style].finditer(line, at):
        groups = m.groupdict()
        if groups["tail"] is not None:
            notes.append(groups["tail"])
        elif groups.get("block") is not None:
            notes.append(groups["block"])
            in_block = not groups["end"]
        else:
            code.append(m[0])
    return "".join(code), " ".join(notes), in_block


_PATTERN_TOKEN = re.compile(r"(?P<atom>\\.|\\$|\[\^?\]?(?:\\.|[^\]\\])*\]?)|(?P<open>\(\??)|(?P<close>\))|(?P<many>[+*]|\{\d*,\d*\})|(?P<other>.)", re.S)


def nested_quantifier(pattern: str) -> bool:
    """Whether an unbounded repeat stands on a group that holds one itself, as in (a+)+.  Escapes and classes are atoms."""
    groups: list[bool] = []  # of each open group, whether it holds a repeat
    before, inner = "", False  # what a repeat would stand on, and whether that is a group with a repeat
    for m in _PATTERN_TOKEN.finditer(pattern):
        kind = m.lastgroup
        if kind == "open":
            groups.append(False)
        elif kind == "close":
            inner = groups.pop() if groups else False
            if inner and groups:
                groups[-1] = True
        elif kind == "many" and before in ("atom", "close", "other"):
            if before == "close" and inner:
                return True
            if groups:
                groups[-1] = True
        before = "atom" if kind == "many" and before in ("", "open", "many") else kind
    return False


def _nested(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: False if p is None else nested_quantifier(p)).astype(bool)


def has_nested_quantifier(pattern: Column) -> Column:
    """nested_quantifier() by Arrow batches; a null pattern has none."""
    return pandas_udf(_nested, "boolean")(pattern)
