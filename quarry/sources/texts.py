"""Readers of repository texts: source files by lines, manifests, unified diffs, ledgers, tables with comment headers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions.code import is_test_path

# Folders that hold no first-party source, by the two readers that leave them out; endings of made files.
DETECTOR_SKIPS = "node_modules bower_components vendor site-packages .venv venv __pycache__ .git test tests __tests__ spec e2e".split()
INDEX_SKIPS = "node_modules vendor dist build target .git __pycache__ venv .venv".split()
MADE = (".min.js", ".bundle.js")
MAX_BYTES, MAX_LINE = 1_000_000, 2000


def skip_reason(rel: Column, size: Column, folders: list[str] = DETECTOR_SKIPS) -> Column:
    """Why a file isn't read, or null: its folder, whatever its case, a made or pseudo file, its size, a path that leaves the root."""
    parts = F.split(F.lower(rel), "[/\\\\]")
    folder = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(*folders))
    made = F.lit(False)
    for ending in MADE:
        made = made | F.endswith(F.lower(rel), F.lit(ending))
    return F.when(rel.startswith("../") | rel.contains("/../"), "outside").when(folder, "folder").when(made, "minified").when(rel.rlike("^<"), "pseudo").when(size > MAX_BYTES, "size")


def index_skip_reason(rel: Column, size: Column, content: Column, links: Column | None = None) -> Column:
    """Why a code index leaves a file out, or null: folder, symbolic link, minified, size, a test's path, a very long line."""
    parts = F.split(rel, "/")
    folder = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(*INDEX_SKIPS))
    long = F.exists(F.split(content, r"\r\n|[\n\r\x0b\x0c]"), lambda line: F.length(line) > MAX_LINE)
    link = F.coalesce(links, F.lit(False)) if links is not None else F.lit(False)
    return (
        F.when(folder, "folder").when(link, "symlink").when(F.endswith(rel, F.lit(".min.js")), "minified").when(size > MAX_BYTES, "too large")
        .when(is_test_path(rel), "test file").when(long, f"minified (a line over {MAX_LINE} chars)")
    )


def source_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(file, size, reason, content): the files under root; content is null where there is a reason not to read it.

    The reader leaves empty files out.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{re.escape(base)}/", "")
    d = d.select(rel.alias("file"), F.col("length").alias("size"), "content")
    d = d.withColumn("reason", skip_reason(F.col("file"), F.col("size")))
    return d.select("file", "size", "reason", F.when(F.col("reason").isNull(), F.decode("content", "UTF-8")).alias("content"))


def source_lines(files: DataFrame) -> DataFrame:
    """(file, lineno, text) of the files that are read; lineno is from 1, a closing line break makes no line."""
    lines = F.split(F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "\n$", ""), "\n", -1)
    d = files.where("reason is null").select("file", F.posexplode(lines).alias("at", "text"))
    return d.select("file", (F.col("at") + 1).cast("bigint").alias("lineno"), "text")


def latest(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """The rows of a JSON-lines ledger, the one of the largest order by key; torn lines are dropped."""
    d = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
    rest = [c for c in d.columns if c != key]
    return d.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of CSV files whose lines from # on are comments."""
    return spark.read.schema(schema).option("comment", "#").csv(path)


def header_value(spark: SparkSession, path: str, name: str) -> str | None:
    """`name: value` or `name value` from a comment line, else null."""
    line = spark.read.text(path).where(F.col("value").rlike(rf"(?i)^#.*\b{name}\b")).agg(F.min("value").alias("v")).first().v
    found = re.search(rf"(?i)\b{name}\b[:\s=]*([\w.]+)", line or "")
    return found[1] if found else None


def dependencies(manifests: DataFrame) -> DataFrame:
    """(root, name, version): declared packages of rows (root, file, content), each name once in a root.

    package.json comes first, then requirements, pom.xml and go.mod; inside a file the earlier one counts.
    """
    base = F.element_at(F.split("file", "/"), -1)
    pick = lambda cond: manifests.where(cond)
    both = F.array(*(F.map_entries(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>")) for k in ("dependencies", "devDependencies")))
    entries = F.flatten(F.filter(both, lambda x: x.isNotNull()))
    npm = pick(base == "package.json").select("root", "file", F.lit(0).alias("kind"), F.posexplode(entries).alias("at", "e")).select("root", "file", "kind", "at", F.col("e.key").alias("name"), F.col("e.value").alias("version"))
    lines = lambda cond, kind: pick(cond).select("root", "file", F.lit(kind).alias("kind"), F.posexplode(F.split("content", "\r?\n")).alias("at", "line"))
    req = r"^\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*(?:[=<>~!]=?=?\s*([\w.*+-]+))?"
    pip = lines(base.rlike(r"^requirements.*\.txt$"), 1).where(~F.col("line").rlike(r"^\s*[#-]")).select("root", "file", "kind", "at", F.regexp_extract("line", req, 1).alias("name"), F.regexp_extract("line", req, 2).alias("version"))
    blocks = F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    pom = pick(base == "pom.xml").select("root", "file", F.lit(2).alias("kind"), F.posexplode(blocks).alias("at", "b"))
    tag = lambda t: F.trim(F.regexp_extract("b", rf"(?s)<{t}>(.*?)</{t}>", 1))
    maven = pom.select("root", "file", "kind", "at", F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), tag("version").alias("version"))
    mod = r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+(v\S+)"
    go = lines(base == "go.mod", 3).where(F.col("line").rlike(mod)).select("root", "file", "kind", "at", F.regexp_extract("line", mod, 1).alias("name"), F.regexp_extract("line", mod, 2).alias("version"))
    every = npm.unionAll(pip).unionAll(maven).unionAll(go).where("name <> ''")
    first = every.groupBy("root", "name").agg(F.min_by(F.struct("version"), F.struct("kind", "file", "at")).alias("r"))
    return first.select("root", "name", F.nullif(F.col("r.version"), F.lit("")).alias("version"))


_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _path(text: str) -> str | None:
    """A path from a --- or +++ line: quotes with octal escapes are undone, a/ or b/ goes, /dev/null is none."""
    text = text.split("\t")[0].strip()
    if text.startswith('"') and text.endswith('"'):
        raw = re.sub(r"\\([0-7]{3})", lambda m: chr(int(m[1], 8)), text[1:-1]).replace('\\"', '"').replace("\\\\", "\\")
        text = raw.encode("latin-1", "replace").decode("utf-8", "replace")
    return None if text == "/dev/null" else re.sub(r"^[ab]/", "", text)


def hunks_of(diff: str | None) -> list[dict]:
    """The hunks of a unified diff without context; a hunk's own lines are counted off, so that none is taken for a header.

    Ranges are closed; a side without lines is the empty range (start, start - 1), start being the line before it.  A hunk cut short by the text's end stays.
    """
    found, old, new, owed = [], None, None, [0, 0]
    for line in (diff or "").split("\n"):
        if owed[0] and line[:1] == "-":
            owed[0] -= 1
        elif owed[1] and line[:1] == "+":
            owed[1] -= 1
        elif m := _HUNK.match(line):
            a, n, b, k = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            owed = [n, k]
            found.append({"file": new, "old_file": old, "old_start": a, "old_end": a + n - 1, "new_start": b, "new_end": b + k - 1})
        elif line.startswith("--- "):
            old, owed = _path(line[4:]), [0, 0]
        elif line.startswith("+++ "):
            new, owed = _path(line[4:]), [0, 0]
    return found


HUNK = "struct<file:string,old_file:string,old_start:bigint,old_end:bigint,new_start:bigint,new_end:bigint>"


def _hunks(diffs: pd.Series) -> pd.Series:
    return diffs.map(hunks_of)


def hunks(diffs: DataFrame) -> DataFrame:
    """id, file, old_file, old_start, old_end, new_start, new_end of rows (id, diff)."""
    return diffs.select("id", F.explode(pandas_udf(_hunks, f"array<{HUNK}>")("diff")).alias("h")).select("id", "h.*")


def map_lines(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, file, line, new_file, new_start, new_end): where lines (id, file, line) of the old side are on the new one.

    A line outside all hunks moves by what those before it added; one in a changed range maps to the whole new range;
    one that is deleted has none (nulls), nor has a line of a deleted file; a file without hunks keeps its name.
    """
    by = Window.partitionBy("id", "old_file").orderBy("old_start", "old_end")
    size = lambda s: F.col(f"{s}_end") - F.col(f"{s}_start") + 1
    h = changed.withColumn("shift", F.sum(size("new") - size("old")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # each hunk stands at the first line that it moves or holds; the latest at or before a line decides
    mark = h.select("id", F.col("old_file").alias("file"), (F.col("old_start") + (F.col("old_end") < F.col("old_start")).cast("int")).alias("line"), F.lit(0).alias("side"), F.struct("old_start", "old_end", F.col("new_start").alias("to"), F.col("new_end").alias("till"), "shift").alias("h"))
    ask = lines.select("id", "file", "line", F.lit(1).alias("side"), F.lit(None).cast(mark.schema["h"].dataType).alias("h"))
    w = Window.partitionBy("id", "file").orderBy("line", "side").rowsBetween(Window.unboundedPreceding, 0)
    d = mark.unionAll(ask).withColumn("h", F.last("h", ignorenulls=True).over(w)).where("side = 1")
    inside = F.col("line").between(F.col("h.old_start"), F.col("h.old_end"))
    gone = inside & (F.col("h.till") < F.col("h.to"))
    moved = F.col("line") + F.coalesce("h.shift", F.lit(0))
    at = lambda c: F.when(gone, None).when(inside, F.col(f"h.{c}")).otherwise(moved)
    d = d.select("id", "file", "line", at("to").alias("new_start"), at("till").alias("new_end"))
    names = changed.groupBy("id", F.col("old_file").alias("file")).agg(F.min_by(F.struct(F.col("file").alias("to")), "old_start").alias("named"))
    d = d.join(names, ["id", "file"], "left")
    new_file = F.when(F.col("named").isNull(), F.col("file")).otherwise(F.col("named.to"))
    there = lambda c: F.when(new_file.isNotNull(), F.col(c)).alias(c)
    return d.select("id", "file", "line", new_file.alias("new_file"), there("new_start"), there("new_end"))
