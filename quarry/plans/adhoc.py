"""Read-only SQL over one scan: the engine binds the scan, checks the plan, and caps rows and time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_CHARS = 8000
#: Kinds of nodes that a query's parsed plan may have; all else, commands and writes among them, is refused.
NODES = set(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join LateralJoin Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedWith "
    "UnresolvedRelation UnresolvedInlineTable UnresolvedTVFAliases OneRowRelation Generate WithWindowDefinition Pivot Unpivot UnresolvedOrdinal Tail".split()
)
#: Functions that a query may call: all of them computed from their arguments alone.
FUNCTIONS = set(
    "abs acos any any_value approx_count_distinct array array_agg array_append array_compact array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove array_size "
    "array_sort array_union arrays_overlap arrays_zip ascii avg bool_and bool_or bround btrim cardinality ceil ceiling char_length chr coalesce collect_list collect_set concat concat_ws contains corr count count_if "
    "cume_dist date_add date_diff date_format date_sub date_trunc datediff day dense_rank element_at endswith every exists exp explode explode_outer filter first first_value flatten floor forall from_json get "
    "get_json_object greatest hour if ifnull in initcap instr isnan isnotnull isnull json_tuple lag last last_value lcase lead least left length like ln locate log log10 log2 lower lpad ltrim map map_entries map_from_arrays "
    "map_keys map_values max max_by md5 mean median min min_by minute mod month named_struct not nth_value ntile nullif nvl percent_rank percentile position pow power quarter rank regexp_extract regexp_extract_all "
    "regexp_like regexp_replace repeat replace reverse right rlike round row_number rpad rtrim second sequence sha1 sha2 shuffle sign size slice some sort_array split sqrt startswith stddev struct substr substring sum "
    "to_date to_json to_timestamp transform translate trim trunc try_divide try_element_at typeof ucase upper var_pop variance week weekday year posexplode posexplode_outer inline inline_outer stack aggregate reduce zip_with "
    "and or + - * / % = == < > <= >= <=> != <> || ~ & | ^ div when between case unix_timestamp epoch grouping grouping_id".split()
)


def _seq(jvm_seq: Any) -> Iterator[Any]:
    for i in range(jvm_seq.size()):
        yield jvm_seq.apply(i)


class _Guard:
    """Walks a parsed plan; names of common table expressions hold where SQL lets them be seen and nowhere else."""

    def __init__(self, spark: SparkSession, views: set[str]):
        of = spark._jvm.java.lang.Class.forName
        self.views, self.subquery = views, of("org.apache.spark.sql.catalyst.expressions.PlanExpression")
        self.function = of("org.apache.spark.sql.catalyst.analysis.UnresolvedFunction")

    def plan(self, node: Any, names: frozenset[str]) -> str | None:
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in NODES:
            return f"not allowed here: {kind}"
        if kind == "UnresolvedRelation":
            parts = list(_seq(node.multipartIdentifier()))
            name = ".".join(parts).lower()
            return None if len(parts) == 1 and (name in names or name in self.views) else f"no such table in this scan: {name}"
        if kind == "UnresolvedWith":
            for relation in _seq(node.cteRelations()):
                why = self.plan(relation._2(), names)
                if why:
                    return why
                names = names | {relation._1().lower()}
            return self.plan(node.child(), names)
        for expression in _seq(node.expressions()):
            why = self.expression(expression, names)
            if why:
                return why
        for child in _seq(node.children()):
            why = self.plan(child, names)
            if why:
                return why
        return None

    def expression(self, e: Any, names: frozenset[str]) -> str | None:
        if self.function.isInstance(e):
            name = ".".join(_seq(e.nameParts())).lower()
            if name not in FUNCTIONS:
                return f"this function isn't allowed: {name}"
        if self.subquery.isInstance(e):
            why = self.plan(e.plan(), names)
            if why:
                return why
        for child in _seq(e.children()):
            why = self.expression(child, names)
            if why:
                return why
        return None


def blocked_reason(spark: SparkSession, query: str, views: set[str]) -> str | None:
    """Why a query isn't run, or null.  The parsed plan decides, not its words: kinds of nodes, functions and relations
    that aren't named here are refused, and so is what can't be parsed, more than one statement among it.

    (Python's own interface has no parser, so this takes the session's.)
    """
    if not query or len(query) > MOST_CHARS:
        return f"a query has 1 to {MOST_CHARS} characters"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as error:  # fail closed
        return f"not a query: {str(error).splitlines()[0]}"
    try:
        return _Guard(spark, {v.lower() for v in views}).plan(plan, frozenset())
    except Exception as error:  # a node that can't be walked
        return f"not allowed here: {str(error).splitlines()[0]}"


def time_allowed(n_items: int, least: float = 420, each: float = 0.006, most: float = 1200) -> float:
    """Seconds that a search over so many items may take."""
    return min(most, least + each * n_items)


@dataclass
class Scan:
    """Tables of one scan, each filtered by scan_id when a query names it."""

    spark: SparkSession
    scan_id: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.tables[name].where(F.col("scan_id") == self.scan_id)

    def _views(self) -> set[str]:
        for name in self.tables:
            self.table(name).createOrReplaceTempView(name)
        return {n.lower() for n in self.tables}

    def schema(self) -> dict[str, list[str]]:
        """Columns by table, without the scan's own."""
        return {n: [c for c in d.columns if c != "scan_id"] for n, d in self.tables.items()}

    def counts(self) -> dict[str, int]:
        """Rows by table."""
        return {n: self.table(n).count() for n in self.tables}

    def files(self, name: str, column: str = "file") -> DataFrame:
        """The distinct files of a table, in order."""
        return self.table(name).select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)

    def query(self, sql: str, limit: int = 100, timeout: float = 60, args: dict[str, Any] | None = None, count: bool = False) -> dict[str, Any]:
        """{rows, truncated} and, if asked for, row_count of all rows; or {error}.  Errors are data and never raise.

        One row more than the limit tells truncation.
        """
        why = blocked_reason(self.spark, sql, self._views())
        if why:
            return {"error": why}
        group, sc = f"adhoc-{uuid.uuid4().hex}", self.spark.sparkContext
        late = threading.Event()
        timer = threading.Timer(timeout, lambda: (late.set(), sc.cancelJobsWithTag(group)))
        timer.start()
        sc.addJobTag(group)
        try:
            d = self.spark.sql(sql, args=args or {})
            rows = [r.asDict(recursive=True) for r in d.limit(limit + 1).collect()]
            found = {"rows": rows[:limit], "truncated": len(rows) > limit}
            return found | ({"row_count": d.count()} if count else {})
        except Exception as error:
            return {"error": f"stopped after {timeout} s" if late.is_set() else str(error).splitlines()[0]}
        finally:
            timer.cancel()
            sc.removeJobTag(group)


def code_window(lines: DataFrame, file: str | None, start: int, end: int, most_lines: int = 200, most_line: int = 500, most_chars: int = 12_000) -> DataFrame:
    """(file, lineno, text, truncated) of a file's (none given: each file's) lines from start to end: at most most_lines of them and most_chars
    characters of all, the first line in any case, each cut at most_line; truncated tells whether the file's were cut."""
    last = min(end, start + most_lines - 1)
    d = lines if file is None else lines.where(F.col("file") == file)
    d = d.where(F.col("lineno").between(max(1, start), last)).withColumn("__cut", F.length("text") > most_line)
    d = d.withColumn("text", F.substring("text", 1, most_line))
    by = Window.partitionBy("file").orderBy("lineno")
    d = d.withColumn("__upto", F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(by))
    d = d.withColumn("__keep", (F.col("__n") == 1) | (F.col("__upto") <= most_chars))
    cut = F.max(F.col("__cut") | ~F.col("__keep")).over(Window.partitionBy("file")) | F.lit(end > last)
    return d.withColumn("truncated", cut).where("__keep").select("file", "lineno", "text", "truncated")


def context(lines: DataFrame, places: DataFrame, around: int = 8) -> DataFrame:
    """(file, line, lineno, text): the lines around each place (file, line), where the file has them."""
    # Both are dealt to blocks of as many lines as a place shows, so that a place stands in two blocks at most; merged, since the
    # dealt places would be taken for as small as the places, and sent whole to the driver.
    wide = 2 * around + 1
    block = lambda x: F.floor(x / wide)
    near = places.select("file", "line", F.explode(F.array_distinct(F.array(block(F.col("line") - around), block(F.col("line") + around)))).alias("__b"))
    d = near.hint("merge").join(lines.select("file", "lineno", "text", block(F.col("lineno")).alias("__b")), ["file", "__b"])
    return d.where(F.col("lineno").between(F.greatest(F.col("line") - around, F.lit(1)), F.col("line") + around)).select("file", "line", "lineno", "text")
