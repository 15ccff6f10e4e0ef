"""Lexical detectors over source lines: controls, hedge comments, risky patterns.

Lines are rows (file, lineno, text); those longer than LONG are no one's writing and are left out.  Splitting a line into
code and comment needs the lines before it only where block comments can go on over lines; all else is done by
expressions and windows by file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.code import has_nested_quantifier, split_comment

# The longest line, characters of a shown line, lines around a comment that are looked at, places by control
# and kind, rows of a shortlist.
LONG, SNIPPET, AROUND, PLACES, SHORTLIST = 400, 200, 2, 3, 60
# Endings of files whose comments start with #.
HASH_ENDINGS = "py rb sh bash pl r yaml yml toml".split()
# Words of comments that admit a weakness, the stronger ones among them, and words of security.
HEDGE = r"\b(vulnerab\w*|insecure|unsafe|disabled?|bypass\w*|hack|fix(?:me|es|ed)?|todo|xxx|workaround|temporar\w*|do not ship|remove (?:this|before))\b"
STRONG = r"vulnerab|insecure|unsafe|disable|bypass|hack"
SECURITY = (
    r"(auth|passw|passwd|secret|token|csrf|xss|saniti[sz]|escap|inject|sql|crypt|hash|session|cookie|permission|privilege|role|admin|redirect|ssl|tls|cert|https|owasp|security|"
    r"validat|whitelist|allowlist|traversal|deserial|eval\b|exec\b|regex|dos\b|header)"
)
# Characters and first words of statements.
STATEMENT_SIGNS, STATEMENT_WORDS = ";{}()=", "return if var let const def import from".split()
# Calls that take a regular expression.
REGEX_CALLS = [r"\bRegExp", r"\bre\.(?:compile|match|search|fullmatch|sub|subn|findall|finditer|split)", r"Pattern\.compile", r"regexp\.(?:MustCompile|Compile)", r"\bRegex"]
# Signs after which an expression between slashes may stand.
BEFORE_SLASH = "=(,:;!&|?{}["


def _any_of(signs: str) -> str:
    return "[" + "".join("\\" + c for c in signs) + "]"


CODE_LIKE = f"{_any_of(STATEMENT_SIGNS)}|^\\s*(?:{'|'.join(STATEMENT_WORDS)})\\b"
# A regular expression between slashes, by its grammar: a body of escapes, classes and other characters, the first no star.
_ESCAPE = r"\\."
_CLASS = rf"\[(?:{_ESCAPE}|[^\]\\])*\]"
_PART = rf"{_ESCAPE}|{_CLASS}|[^\\/\[]"
SLASHED = rf"(?:^|\s|{_any_of(BEFORE_SLASH)})/((?!\*)(?:{_PART})(?:{_PART})*)/[a-z]*"
REGEX_CALL = rf"(?:{'|'.join(REGEX_CALLS)})\s*\(\s*(.*)"
_QUOTES = "\"'`"
#: Text in quotes at the start, with a letter or two before it; a group for each kind of quote.
QUOTED = r"^[rbuf]{0,2}(?:" + "|".join(rf"{q}((?:{_ESCAPE}|[^\\{q}])*){q}" for q in _QUOTES) + ")"

#: The order of a control's kinds, and what is said of each.
KINDS = {"disabled": "explicitly switched off", "commented_out": "only appears inside a comment", "absent": "no use found in first-party source", "present": "in use"}


@dataclass(frozen=True)
class Control:
    """A security control: its name, patterns (Java regular expressions, whatever the case) of its presence and of its
    being switched off, and the weakness that its lack is."""

    name: str
    present: str | tuple[str, ...] | None = None
    disabled: str | tuple[str, ...] | None = None
    cwe: str | None = None


def _finds(text: Column, patterns: str | tuple[str, ...] | None) -> Column:
    """Whether a pattern is found; null where there is none to be found."""
    given = [patterns] if isinstance(patterns, str) else list(patterns or ())
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in given)), F.lit(False)) if given else F.lit(None).cast("boolean")


def split_lines(lines: DataFrame) -> DataFrame:
    """(file, lineno, text, code, comment): lines parted into code and comment, block comments followed across lines.

    Only files that have a block comment are gathered, each by itself; other lines are parted where they stand, and those
    without any mark of a comment by no Python at all.
    """
    d = lines.select("file", "lineno", "text").where((F.length("text") <= LONG) & F.col("file").isNotNull())
    hashed = F.col("file").rlike(rf"(?i)\.(?:{'|'.join(HASH_ENDINGS)})$")
    alone = lambda style: pandas_udf(lambda xs: pd.DataFrame([split_comment(x, False, style)[:2] for x in xs], columns=["code", "comment"]), "code string, comment string")

    def row_wise(d: DataFrame, style: str, mark: str) -> DataFrame:
        plain = d.where(~F.contains("text", F.lit(mark))).select("*", F.col("text").alias("code"), F.lit("").alias("comment"))
        marked = d.where(F.contains("text", F.lit(mark))).withColumn("parts", alone(style)("text"))
        return plain.unionAll(marked.select("file", "lineno", "text", "parts.code", "parts.comment"))

    def in_order(d: pd.DataFrame) -> pd.DataFrame:
        d, open_, parts = d.sort_values("lineno"), False, []
        for text in d["text"]:
            code, comment, open_ = split_comment(text, open_, "c")
            parts.append((code, comment))
        return d.assign(code=[p[0] for p in parts], comment=[p[1] for p in parts])

    c = d.where(~hashed)
    blocks = c.where(F.contains("text", F.lit("/*"))).select("file").distinct()
    gathered = c.join(blocks, "file", "left_semi").groupBy("file").applyInPandas(in_order, "file string, lineno bigint, text string, code string, comment string")
    return row_wise(d.where(hashed), "hash", "#").unionAll(row_wise(c.join(blocks, "file", "left_anti"), "c", "//")).unionAll(gathered)


def _snippet(text: Column) -> Column:
    return F.substring(F.trim(text), 1, SNIPPET)


def controls(split: DataFrame, checklist: list[Control], most: int = PLACES) -> DataFrame:
    """(control, kind, file, lineno, cwe, code, detail, kind_order, control_order): the first places of each control and kind.

    Kinds: disabled, if code has that pattern; and, if a control has a pattern of presence, present, else commented_out,
    else absent, which has no place.  Without any line there are no rows, so nothing is called absent that wasn't looked for.
    """
    columns = ["control", "kind", "file", "lineno", "cwe", "code", "detail", "kind_order", "control_order"]
    listed = [(i, c.name, c.cwe, bool(c.present)) for i, c in enumerate(checklist)]
    if not listed:
        return split.select(*(F.lit(None).cast(t).alias(c) for c, t in zip(columns, ["string", "string", "string", "bigint", "string", "string", "string", "int", "int"], strict=True))).limit(0)
    fields = lambda i, name, cwe, has: F.struct(F.lit(i).alias("control_order"), F.lit(name).alias("control"), F.lit(cwe).cast("string").alias("cwe"), F.lit(has).alias("has"))
    dim = F.array(*(fields(*x) for x in listed))

    def kinds(c: Control) -> Column:
        used = _finds(F.col("code"), c.present)
        found = {"disabled": _finds(F.col("code"), c.disabled), "present": used, "commented_out": ~used & _finds(F.col("comment"), c.present)}
        return F.filter(F.array(*(F.when(x, F.lit(kind)) for kind, x in found.items())), lambda x: x.isNotNull())

    per_line = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), kinds(c).alias("kinds")) for i, c in enumerate(checklist))), lambda x: F.size(x["kinds"]) > 0)
    hits = split.select("file", "lineno", "text", F.explode(per_line).alias("hit")).select("file", "lineno", "text", F.col("hit.i").alias("i"), F.explode("hit.kinds").alias("kind"))
    first = Window.partitionBy("i", "kind").orderBy("file", "lineno")
    hits = hits.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    by = Window.partitionBy("i")
    hits = hits.withColumn("used", F.max(F.col("kind") == "present").over(by)).where("not used or kind <> 'commented_out'")
    every = split.limit(1).select(F.explode(dim).alias("c")).select("c.*")
    seen = hits.where("kind <> 'disabled'").select(F.col("i").alias("control_order")).distinct()
    none = every.where("has").join(seen, "control_order", "left_anti").select("control_order", "control", "cwe", F.lit("absent").alias("kind"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("lineno"), F.lit("").alias("code"))
    placed = hits.withColumn("c", F.get(dim, F.col("i"))).select("c.control_order", "c.control", "c.cwe", "kind", "file", "lineno", _snippet(F.col("text")).alias("code"))
    rows = placed.unionAll(none)
    said, order = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (KINDS, {k: i for i, k in enumerate(KINDS)}))
    rows = rows.withColumn("detail", F.concat("control", F.lit(": "), said[F.col("kind")])).withColumn("kind_order", order[F.col("kind")])
    return rows.select(*columns)


def hedges(split: DataFrame) -> DataFrame:
    """(file, lineno, kind, score, cwe, code, detail): comments with a hedge word near a security term.

    Of hedges that follow one another within AROUND + 1 lines, only the first that has a term is a row; a term is looked
    for on the hedge's own line, then from AROUND lines above it to AROUND below.  Code in a comment of its own, up to
    AROUND + 1 lines below, marks a repair that was taken out.
    """
    lower = lambda text, pattern: F.lower(F.regexp_extract(text, "(?i)" + pattern, 0))
    note = F.trim(F.coalesce("comment", F.lit("")))
    old = F.when((F.trim("code") == "") & note.rlike(CODE_LIKE), F.substring(note, 1, 80)).otherwise("")
    d = split.select("file", "lineno", lower(F.col("comment"), HEDGE).alias("hedge"), lower(F.concat_ws(" ", "comment", "code"), SECURITY).alias("term"), old.alias("old"), _snippet(F.col("text")).alias("code"))
    # a line without any of the three has no say
    d = d.where((F.col("hedge") != "") | (F.col("term") != "") | (F.col("old") != ""))
    by = Window.partitionBy("file").orderBy("lineno")
    this = F.struct("lineno", "term", "old")
    near = F.array(*(F.lag(this, k).over(by) for k in range(AROUND, 0, -1)), *(F.lead(this, k).over(by) for k in range(1, AROUND + 2)))
    d = d.withColumn("near", F.filter(near, lambda x: x.isNotNull())).where(F.col("hedge") != "")
    first = lambda ok, c: F.try_element_at(F.transform(F.filter("near", ok), lambda x: x[c]), F.lit(1))
    beside = first(lambda x: (F.abs(x["lineno"] - F.col("lineno")) <= AROUND) & (x["term"] != ""), "term")
    below = first(lambda x: (x["lineno"] - F.col("lineno")).between(1, AROUND + 1) & (x["old"] != ""), "old")
    d = d.withColumns({"term": F.coalesce(F.nullif("term", F.lit("")), beside), "old": below})
    # a run is an island of hedges; those before its first term lie too far from any run before
    fresh = F.coalesce(F.col("lineno") - F.lag("lineno").over(by) > AROUND + 1, F.lit(True)).cast("int")
    d = d.withColumn("run", F.sum(fresh).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("term is not null")
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("file", "run").orderBy("lineno"))).where("n = 1")
    score = F.when(F.col("hedge").rlike(STRONG), 3).otherwise(2) + 2 + F.when(F.col("old").isNotNull(), 2).otherwise(0)
    detail = F.concat(F.lit("hedge '"), "hedge", F.lit("' near '"), "term", F.lit("'"), F.coalesce(F.concat(F.lit("; commented-out code: "), "old"), F.lit("")))
    kind = F.when(F.col("old").isNotNull(), "commented_out_fix").otherwise("hedge_comment")
    return d.select("file", "lineno", kind.alias("kind"), score.cast("int").alias("score"), F.lit(None).cast("string").alias("cwe"), "code", detail.alias("detail"))


def regex_calls(split: DataFrame) -> DataFrame:
    """(file, lineno, kind, pattern, cwe, code, detail): redos_regex, a literal pattern with nested repeats; dynamic_regex,
    one from a name."""
    d = split.select("file", "lineno", "code", F.explode(F.concat(
        F.transform(F.regexp_extract_all("code", F.lit(SLASHED), F.lit(1)), lambda x: F.struct(x.alias("literal"), F.lit("").alias("given"))),
        F.transform(F.regexp_extract_all("code", F.lit(REGEX_CALL), F.lit(1)), lambda x: F.struct(F.lit("").alias("literal"), F.ltrim(x).alias("given"))),
    )).alias("x"), _snippet(F.col("text")).alias("shown"))
    quoted = F.col("x.given").rlike(QUOTED)
    literal = F.concat(F.col("x.literal"), *(F.regexp_extract("x.given", QUOTED, i + 1) for i in range(len(_QUOTES))))
    named = ~quoted & F.col("x.given").rlike(r"^[\p{L}_]") & ~F.col("x.given").rlike("^r['\"]")
    name = F.substring(F.trim(F.regexp_extract("x.given", r"^[^),]*", 0)), 1, 80)
    kind = F.when(named, "dynamic_regex").when((literal != "") & has_nested_quantifier(literal), "redos_regex")
    pattern = F.when(named, name).otherwise(literal)
    d = d.select("file", "lineno", kind.alias("kind"), pattern.alias("pattern"), F.lit("CWE-1333").alias("cwe"), F.col("shown").alias("code")).where("kind is not null")
    said = F.when(F.col("kind") == "dynamic_regex", F.concat(F.lit("regex built from `"), "pattern", F.lit("`"))).otherwise(F.concat(F.lit("nested quantifier in /"), F.substring("pattern", 1, 80), F.lit("/")))
    return d.withColumn("detail", said)


def risky_patterns(split: DataFrame, declared: DataFrame) -> DataFrame:
    """(file, lineno, kind, cwe, code, detail, kind_order): regex_calls, and each declared dependency (name, version)."""
    calls = regex_calls(split).select("file", "lineno", "kind", "cwe", "code", "detail", F.when(F.col("kind") == "redos_regex", 0).otherwise(1).alias("kind_order"))
    names = declared.where("coalesce(name, '') <> ''").select("name", F.coalesce("version", F.lit("")).alias("version")).distinct()
    detail = F.concat("name", F.when(F.col("version") != "", F.concat(F.lit("@"), "version")).otherwise(""))
    return calls.unionAll(names.select(F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit("dependency"), F.lit("CWE-1104"), F.lit(""), detail, F.lit(2)))


def shape_order(shape: str) -> list[Column]:
    """The order of a shape's rows: B controls, C hedges, D patterns."""
    c = F.col
    return {"B": [c("kind_order"), c("control_order"), c("file"), c("lineno")], "C": [F.desc("score"), c("file"), c("lineno")], "D": [c("kind_order"), c("file"), c("lineno"), c("detail")]}[shape]


def shortlist(rows: DataFrame, shape: str, order: list[Column], scan_id: str, most: int = SHORTLIST) -> DataFrame:
    """The first `most` rows of a detector, with shape, rank (from 0) and a uid of scan, shape, kind, place and detail."""
    top = rows.orderBy(*order).limit(most)
    # `most` rows are left: numbering them in one task is bounded by the parameter
    ranked = top.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return ranked.withColumn("shape", F.lit(shape)).withColumn("uid", F.sha1(F.concat_ws("|", F.lit(scan_id), F.lit("CandidateFinding"), F.lit(shape), part("kind"), part("file"), part("lineno"), part("detail"))))


def shortlists(split: DataFrame, checklist: list[Control], declared: DataFrame, scan_id: str, most: int = SHORTLIST) -> DataFrame:
    """(uid, shape, rank, kind, file, lineno, cwe, code, detail) of all three shapes, `most` rows of each."""
    columns = ["uid", "shape", "rank", "kind", "file", "lineno", "cwe", "code", "detail"]
    made = {"B": controls(split, checklist), "C": hedges(split), "D": risky_patterns(split, declared)}
    lists = [shortlist(rows, shape, shape_order(shape), scan_id, most).select(*columns) for shape, rows in made.items()]
    return lists[0].unionAll(lists[1]).unionAll(lists[2])
