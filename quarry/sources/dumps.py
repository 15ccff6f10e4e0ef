"""Readers of database dumps as text: SQLite's INSERT statements and PostgreSQL's COPY blocks.

Both read a file by blocks, so one large dump is read by many tasks; only a statement, or a line, is a unit.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.sources import blocks
from quarry.sources.blocks import AT, BLOCK, FILE

_LITERAL = re.compile(r"\s*(?:(?P<word>replace|char)\(|(?P<null>NULL)|[xX](?P<hex>'[^']*')|(?P<text>'(?:[^']|'')*')|(?P<number>[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<sign>[,)]))")
_INSERT = r'^\s*INSERT INTO "?(\w+)"? VALUES\('


def values_of(statement: str) -> list[str | None]:
    """The literals after VALUES( in one INSERT statement: text, NULL, numbers, X'hex', char(n), replace(a,b,c).

    A stack of open calls: the innermost takes each literal, and gives its own value to the next one when it is closed.
    """
    at = re.match(_INSERT, statement).end()
    stack: list[tuple[str, list]] = [("", [])]
    while True:
        m = _LITERAL.match(statement, at)
        if m is None:
            raise ValueError(f"no literal at {statement[at:at + 60]!r}")
        at = m.end()
        if m["word"]:
            stack.append((m["word"], []))
        elif m["sign"] == ")":
            call, args = stack.pop()
            if not call:
                return args
            stack[-1][1].append(chr(int(args[0])) if call == "char" else args[0].replace(args[1], args[2]))
        elif not m["sign"]:
            text = m["text"] or m["hex"]
            stack[-1][1].append(None if m["null"] else text[1:-1].replace("''", "'") if text else m["number"])


def _values(statements: pd.Series) -> pd.Series:
    return statements.map(values_of)


def sqlite_dump(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """The rows of one table in a SQLite .dump, as strings.

    Statements may span lines: quotes are counted through the file, and a line that ends in ); with an even count ends a
    statement.  Lines are grouped by the number of statements that ended before them.
    """
    d = blocks.read_lines(spark, path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit("'"), F.lit("")))
    d = blocks.running_sum(d, "__quotes", quotes)
    ends = (F.col("__quotes") % 2 == 0) & F.rtrim(F.col("value")).endswith(";")
    d = blocks.running_sum(d, "__statement", ends.cast("int"), before=True)
    order = F.array_sort(F.collect_list(F.struct(BLOCK, AT, "value")))
    whole = d.groupBy(FILE, "__statement").agg(F.array_join(F.transform(order, lambda x: x["value"]), "\n").alias("s"))
    mine = whole.where(F.regexp_extract("s", _INSERT, 1) == table).select(pandas_udf(_values, "array<string>")("s").alias("v"))
    return mine.select(*(F.get("v", F.lit(i)).alias(c) for i, c in enumerate(columns)))


def sqlite_columns(spark: SparkSession, path: str, table: str) -> list[str]:
    """The columns of a table, from its CREATE TABLE; one line for each column, as .dump writes them."""
    d = blocks.last_before(blocks.read_lines(spark, path), "__open", F.when(F.col("value").rlike(r"^CREATE TABLE"), F.regexp_extract("value", r'^CREATE TABLE (?:IF NOT EXISTS )?"?(\w+)"?', 1)).when(F.col("value").rlike(r"^(INSERT|CREATE|COMMIT|BEGIN|PRAGMA)"), ""))
    rows = d.where((F.col("__open") == table)).orderBy(FILE, BLOCK, AT).select("value").collect()  # a table's columns
    text = "\n".join(r.value for r in rows)
    inside = text[text.index("(") + 1 : text.rindex(")")]
    names = [re.match(r'\s*"?(\w+)"?', c) for c in re.split(r",(?![^(]*\))", inside)]
    return [m[1] for m in names if m and not re.match(r"(PRIMARY|FOREIGN|UNIQUE|CONSTRAINT|CHECK)$", m[1], re.I)]


# The letters that COPY escapes characters with.
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|.)", re.S)


def copy_field(text: str | None) -> str | None:
    """A field of a COPY line; \\N is null."""
    if text is None or text == "\\N":
        return None
    if "\\" not in text:
        return text
    # octal and hex escapes are bytes of UTF-8
    raw = _ESCAPE.sub(lambda m: _ESCAPES.get(m[1]) or (chr(int(m[1][1:], 16)) if re.fullmatch("x[0-9A-Fa-f]+", m[1]) else chr(int(m[1], 8) & 255) if m[1].isdigit() and m[1][0] in "01234567" else m[1]), text)
    if any(0x80 <= ord(c) < 0x100 for c in raw) and all(ord(c) < 0x100 for c in raw):
        return raw.encode("latin-1").decode("utf-8", "replace")
    return raw


def _unescape(fields: pd.Series) -> pd.Series:
    return fields.map(copy_field)


def copy_dump(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """The wanted columns of one table in a PostgreSQL dump; only theirs are unescaped."""
    d = blocks.read_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    header = F.when(F.col("value").rlike(r"^COPY .* FROM stdin;$"), F.col("value")).when(F.col("value") == "\\.", F.lit(""))
    d = blocks.last_before(d, "__head", header)
    name = F.regexp_extract("__head", r'^COPY (?:"?\w+"?\.)?"?(\w+)"? ?\(', 1)
    rows = d.where((name == table) & (F.col("value") != F.col("__head")))
    names = F.transform(F.split(F.regexp_extract("__head", r"\((.*)\) FROM stdin;$", 1), r",\s*"), lambda x: F.replace(F.trim(x), F.lit('"'), F.lit("")))
    fields = rows.select(F.split("value", "\t", -1).alias("f"), names.alias("n"))
    pick = lambda c: F.get("f", (F.array_position("n", F.lit(c)) - 1).cast("int"))
    unescape = pandas_udf(_unescape, "string")
    plain = fields.select(*(pick(c).alias(c) for c in columns))
    return plain.select(*(F.when(F.contains(F.col(c), F.lit("\\")), unescape(c)).otherwise(F.col(c)).alias(c) for c in columns))


