"""Read-only pattern queries over one scan's graph: a subset of openCypher compiled to joins, filters and aggregates.

Clauses: MATCH, OPTIONAL MATCH, WHERE, UNWIND, WITH, RETURN, ORDER BY, SKIP, LIMIT, UNION [ALL].  Steps of variable length
have a bound.  Whatever the grammar doesn't know is refused, writes, calls and subqueries among it, so a query can do no
more than read the scan's own nodes and edges: the scan is filtered by the engine, not by the query.

Nodes are tables by label (scan_id, uid, ...), edges tables by type (scan_id, src, dst, ...); a variable is bound to the
struct of its node's or edge's columns.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHARS, MOST_STEPS = 8000, 12


class Refused(ValueError):
    """A query that isn't run, with the reason."""


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?!\.\d))|(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<param>\$\w+)|(?P<name>[A-Za-z_]\w*)|`(?P<quoted>[^`]+)`"""
    r"""|(?P<sign><>|<=|>=|=~|\.\.|<-|->|[-+*/%=<>(){}\[\],.:|;])""",
    re.S,
)
_KEYWORDS = set("match optional where unwind as with distinct return order by skip limit asc ascending desc descending union all and or xor not in contains starts ends is null true false case when then else end any none single".split())
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    raw: str = ""


def tokens(query: str) -> list[Token]:
    """The tokens of a query; comments go, names of clauses and operators are keywords whatever their case."""
    found, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if m is None:
            raise Refused(f"unexpected {query[at]!r}")
        at, kind = m.end(), m.lastgroup or ""
        if kind == "space":
            continue
        value = raw = m[kind]
        if kind == "name" and value.lower() in _KEYWORDS:
            kind, value = "key", value.lower()
        elif kind == "text":
            value = re.sub(r"\\(.)", lambda e: _ESCAPED.get(e[1], e[1]), value[1:-1])
        found.append(Token("name" if kind == "quoted" else kind, value, raw))
    return found


@dataclass
class Node:
    var: str | None
    label: str | None
    props: dict[str, Any]


@dataclass
class Step:
    var: str | None
    types: list[str]
    least: int
    most: int
    direction: str  # out, in, any
    props: dict[str, Any]
    varied: bool = False


@dataclass
class Path:
    nodes: list[Node]
    steps: list[Step]


@dataclass
class Item:
    value: Any
    name: str


@dataclass
class Clause:
    """match: paths, where, optional; unwind: value, name; with and return: items, distinct, order, skip, limit, where."""

    kind: str
    paths: list[Path] = field(default_factory=list)
    where: Any = None
    optional: bool = False
    items: list[Item] | None = None
    distinct: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)
    skip: int = 0
    limit: int | None = None
    value: Any = None
    name: str = ""


class Parser:
    """A query's clauses, by branch of UNION.  Expressions are tuples: (kind, ...)."""

    def __init__(self, query: str):
        self.ts, self.at = tokens(query), 0

    def peek(self, *values: str, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.ts) and self.ts[i].kind in ("key", "sign") and self.ts[i].value in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            got = self.ts[self.at].value if self.at < len(self.ts) else "the end"
            raise Refused(f"expected {value.upper()}, not {got}")

    def name(self) -> str:
        if self.at < len(self.ts) and self.ts[self.at].kind in ("name", "key"):
            self.at += 1
            return self.ts[self.at - 1].raw
        raise Refused("expected a name")

    def number(self) -> int:
        if self.at < len(self.ts) and self.ts[self.at].kind == "number" and "." not in self.ts[self.at].value:
            self.at += 1
            return int(self.ts[self.at - 1].value)
        raise Refused("expected a whole number")

    def query(self) -> list[tuple[list[Clause], bool]]:
        """Branches, each with whether it is joined to the ones before by UNION ALL."""
        branches, every = [], True
        while True:
            branches.append((self.branch(), every))
            if not self.take("union"):
                break
            every = self.take("all")
        self.take(";")
        if self.at < len(self.ts):
            raise Refused(f"not allowed here: {self.ts[self.at].value}")
        return branches

    def branch(self) -> list[Clause]:
        clauses: list[Clause] = []
        while True:
            if self.peek("match", "optional"):
                optional = self.take("optional")
                self.need("match")
                paths = [self.path()]
                while self.take(","):
                    paths.append(self.path())
                clauses.append(Clause("match", paths=paths, optional=optional, where=self.expression() if self.take("where") else None))
            elif self.take("unwind"):
                value = self.expression()
                self.need("as")
                clauses.append(Clause("unwind", value=value, name=self.name()))
            elif self.peek("with", "return"):
                kind = "with" if self.take("with") else "return"
                self.take("return")
                clauses.append(self.projection(kind))
                if kind == "return":
                    return clauses
            else:
                got = self.ts[self.at].value if self.at < len(self.ts) else "the end"
                raise Refused(f"not allowed here: {got}")

    def projection(self, kind: str) -> Clause:
        c = Clause(kind, distinct=self.take("distinct"))
        if not self.take("*"):
            c.items = [self.item(kind)]
            while self.take(","):
                c.items.append(self.item(kind))
        if self.take("order"):
            self.need("by")
            while True:
                value = self.expression()
                down = self.take("desc", "descending")
                self.take("asc", "ascending")
                c.order.append((value, down))
                if not self.take(","):
                    break
        c.skip = self.number() if self.take("skip") else 0
        c.limit = self.number() if self.take("limit") else None
        if kind == "with" and self.take("where"):
            c.where = self.expression()
        return c

    def item(self, kind: str) -> Item:
        start = self.at
        value = self.expression()
        if self.take("as"):
            return Item(value, self.name())
        if kind == "with" and value[0] != "var":
            raise Refused("an expression in WITH needs AS")
        return Item(value, "".join(t.raw for t in self.ts[start : self.at]))

    def path(self) -> Path:
        path = Path([self.node()], [])
        while self.peek("-", "<-"):
            back = self.take("<-")
            if not back:
                self.need("-")
            step = self.step() if self.peek("[") else Step(None, [], 1, 1, "any", {})
            on = self.take("->")
            if not on:
                self.need("-")
            if back and on:
                raise Refused("a step has one direction")
            step.direction = "in" if back else "out" if on else "any"
            path.steps.append(step)
            path.nodes.append(self.node())
        return path

    def step(self) -> Step:
        self.need("[")
        s = Step(self.name() if self.ts[self.at].kind == "name" else None, [], 1, 1, "any", {})
        if self.take(":"):
            s.types.append(self.name())
            while self.take("|"):
                self.take(":")
                s.types.append(self.name())
        if self.take("*"):
            s.varied = True
            if self.ts[self.at].kind == "number":
                s.least = s.most = self.number()
            if self.take(".."):
                if self.ts[self.at].kind != "number":
                    raise Refused("a step of variable length needs a bound")
                s.most = self.number()
            elif not (self.ts[self.at - 1].kind == "number"):
                raise Refused("a step of variable length needs a bound")
            if s.most > MOST_STEPS or s.least > s.most:
                raise Refused(f"a step of variable length has at most {MOST_STEPS} steps")
        if self.peek("{"):
            s.props = self.map()
        self.need("]")
        return s

    def node(self) -> Node:
        self.need("(")
        n = Node(self.name() if self.ts[self.at].kind == "name" else None, None, {})
        if self.take(":"):
            n.label = self.name()
        if self.peek("{"):
            n.props = self.map()
        self.need(")")
        return n

    def map(self) -> dict[str, Any]:
        self.need("{")
        found = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            found[key] = self.expression()
            if not self.peek("}"):
                self.need(",")
        return found

    # expressions, from the loosest operator to the tightest
    _LEVELS = (("or",), ("xor",), ("and",))

    def expression(self, level: int = 0) -> Any:
        if level == len(self._LEVELS):
            return ("not", self.expression(level)) if self.take("not") else self.comparison()
        left = self.expression(level + 1)
        while self.peek(*self._LEVELS[level]):
            op = self.ts[self.at].value
            self.at += 1
            left = (op, left, self.expression(level + 1))
        return left

    def comparison(self) -> Any:
        left = self.sum()
        while True:
            if self.peek("=", "<>", "<", "<=", ">", ">=", "=~", "in", "contains"):
                op = self.ts[self.at].value
                self.at += 1
                left = (op, left, self.sum())
            elif self.peek("starts", "ends"):
                op = self.ts[self.at].value
                self.at += 1
                self.need("with")
                left = (op, left, self.sum())
            elif self.take("is"):
                negated = self.take("not")
                self.need("null")
                left = ("null", left, negated)
            else:
                return left

    def sum(self) -> Any:
        left = self.product()
        while self.peek("+", "-"):
            op = self.ts[self.at].value
            self.at += 1
            left = (op, left, self.product())
        return left

    def product(self) -> Any:
        left = self.unary()
        while self.peek("*", "/", "%"):
            op = self.ts[self.at].value
            self.at += 1
            left = (op, left, self.unary())
        return left

    def unary(self) -> Any:
        if self.take("-"):
            return ("minus", self.unary())
        value = self.atom()
        while True:
            if self.peek("."):
                self.at += 1
                value = ("prop", value, self.name())
            elif self.take("["):
                value = ("at", value, self.expression())
                self.need("]")
            else:
                return value

    def atom(self) -> Any:
        if self.at >= len(self.ts):
            raise Refused("the query ends early")
        t = self.ts[self.at]
        if t.kind in ("number", "text", "param"):
            self.at += 1
            return ("param", t.value[1:]) if t.kind == "param" else ("value", t.value if t.kind == "text" else float(t.value) if "." in t.value else int(t.value))
        if self.take("true"):
            return ("value", True)
        if self.take("false"):
            return ("value", False)
        if self.take("null"):
            return ("value", None)
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.take("["):
            return self.list()
        if self.take("case"):
            subject = None if self.peek("when") else self.expression()
            cases = []
            while self.take("when"):
                test = self.expression()
                self.need("then")
                cases.append((test if subject is None else ("=", subject, test), self.expression()))
            other = self.expression() if self.take("else") else ("value", None)
            self.need("end")
            return ("case", cases, other)
        if t.kind == "name" or t.value in ("any", "all", "none", "single"):
            self.at += 1
            if not self.take("("):
                return ("var", t.value)
            if t.value in ("any", "all", "none", "single"):
                var, values = self.bound()
                self.need("where")
                test = self.expression()
                self.need(")")
                return ("each", t.value, var, values, test)
            distinct = self.take("distinct")
            if self.take("*"):
                self.need(")")
                return ("call", t.value.lower(), distinct, None)
            args = []
            while not self.take(")"):
                args.append(self.expression())
                if not self.peek(")"):
                    self.need(",")
            return ("call", t.value.lower(), distinct, args)
        raise Refused(f"not allowed here: {t.value}")

    def bound(self) -> tuple[str, Any]:
        var = self.name()
        self.need("in")
        return var, self.sum()

    def list(self) -> Any:
        if self.ts[self.at].kind == "name" and self.peek("in", ahead=1):
            var, values = self.bound()
            test = self.expression() if self.take("where") else None
            value = self.expression() if self.take("|") else ("var", var)
            self.need("]")
            return ("listed", var, values, test, value)
        found = []
        while not self.take("]"):
            found.append(self.expression())
            if not self.peek("]"):
                self.need(",")
        return ("list", found)


AGGREGATES: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "size": lambda x: F.size(x), "length": lambda x: F.size(x), "coalesce": F.coalesce, "tolower": F.lower, "toupper": F.upper, "tostring": lambda x: x.cast("string"), "tointeger": lambda x: x.try_cast("bigint"), "tofloat": lambda x: x.try_cast("double"),
    "trim": F.trim, "split": lambda x, y: F.split(x, F.concat(F.lit("\\Q"), y, F.lit("\\E"))), "replace": F.replace, "substring": lambda x, a, n=None: F.substr(x, a + 1) if n is None else F.substr(x, a + 1, n), "head": lambda x: F.try_element_at(x, F.lit(1)),
    "last": lambda x: F.try_element_at(x, F.lit(-1)), "abs": F.abs, "round": F.round, "exists": lambda x: x.isNotNull(), "reverse": F.reverse, "sqrt": F.sqrt, "ceil": F.ceil, "floor": F.floor,
}


def aggregates(e: Any) -> bool:
    """Whether an expression holds an aggregate."""
    if isinstance(e, tuple) and e and e[0] == "call" and e[1] in AGGREGATES:
        return True
    return isinstance(e, (tuple, list)) and any(aggregates(x) for x in e)


class Graph:
    """One scan's nodes by label and edges by type."""

    def __init__(self, spark: SparkSession, scan_id: str, nodes: dict[str, DataFrame], edges: dict[str, DataFrame]):
        self.spark, self.scan_id, self.nodes, self.edges = spark, scan_id, nodes, edges

    def _of(self, tables: dict[str, DataFrame], name: str, what: str) -> DataFrame:
        if name not in tables:
            raise Refused(f"no such {what} in this scan: {name}")
        return tables[name].where(F.col("scan_id") == self.scan_id)

    def schema(self) -> dict[str, list[str]]:
        """Properties by label and type, without the scan's own."""
        return {n: [c for c in d.columns if c not in ("scan_id", "src", "dst")] for n, d in {**self.nodes, **self.edges}.items()}

    def run(self, query: str, limit: int = 100, timeout: float = 60, params: dict[str, Any] | None = None, strict: bool = True) -> dict[str, Any]:
        """{rows, truncated} or {error}; errors are data and never raise.  strict: UNION is refused."""
        group, sc, late = f"pattern-{uuid.uuid4().hex}", self.spark.sparkContext, threading.Event()
        timer = threading.Timer(timeout, lambda: (late.set(), sc.cancelJobsWithTag(group)))
        timer.start()
        sc.addJobTag(group)
        try:
            rows = [r.asDict(recursive=True) for r in self.frame(query, params, strict).limit(limit + 1).collect()]
        except Exception as error:
            return {"error": f"stopped after {timeout} s" if late.is_set() else str(error).splitlines()[0]}
        finally:
            timer.cancel()
            sc.removeJobTag(group)
        return {"rows": rows[:limit], "truncated": len(rows) > limit}

    def frame(self, query: str, params: dict[str, Any] | None = None, strict: bool = True) -> DataFrame:
        """The query as a plan; raises Refused."""
        if not query or len(query) > MOST_CHARS:
            raise Refused(f"a query has 1 to {MOST_CHARS} characters")
        branches = Parser(query).query()
        if strict and len(branches) > 1:
            raise Refused("not allowed here: UNION")
        found = None
        for clauses, every in branches:
            d = _Compiler(self, params or {}).branch(clauses)
            if found is None:
                found = d
            elif sorted(found.columns) != sorted(d.columns):
                raise Refused("the branches of a UNION return different columns")
            else:
                found = found.unionByName(d) if every else found.unionByName(d).distinct()
        return found


class _Compiler:
    """Compiles one branch: a table of bindings, a column a variable."""

    def __init__(self, graph: Graph, params: dict[str, Any]):
        self.graph, self.params, self.unnamed = graph, params | {"scan_id": graph.scan_id}, 0

    def branch(self, clauses: list[Clause]) -> DataFrame:
        d: DataFrame | None = None
        for c in clauses:
            if c.kind == "match":
                d = self.match(d, c)
            elif c.kind == "unwind":
                d = self.graph.spark.range(1).select() if d is None else d
                d = d.select("*", F.explode(self.column(c.value, set(d.columns))).alias(c.name))
            else:
                d = self.project(self.graph.spark.range(1).select() if d is None else d, c)
        return d

    def fresh(self) -> str:
        self.unnamed += 1
        return f"__{self.unnamed}"

    def match(self, d: DataFrame | None, c: Clause) -> DataFrame:
        if c.optional and d is not None:
            if not d.columns:
                raise Refused("OPTIONAL MATCH needs a variable before it")
            # rows alike in all variables find the same matches: they are looked up once
            key = F.xxhash64(*d.columns)
            once = d.distinct().withColumn("__row", key)
            hit = reduce(self.walk, c.paths, once)
            if c.where is not None:
                hit = hit.where(self.column(c.where, set(hit.columns)))
            new = [x for x in hit.columns if x not in d.columns and not x.startswith("__")]
            found = hit.select(F.col("__row").alias("__hit"), F.struct(*d.columns).alias("__same"), *new)
            same = F.struct(*d.columns).eqNullSafe(F.col("__same"))
            return d.withColumn("__row", key).join(found, (F.col("__row") == F.col("__hit")) & same, "left").select(*d.columns, *new)
        d = reduce(self.walk, c.paths, d)
        if c.where is not None:
            d = d.where(self.column(c.where, set(d.columns)))
        return d.select(*(x for x in d.columns if not x.startswith("__")))

    def _bind(self, d: DataFrame | None, n: Node, at: Column | None) -> tuple[DataFrame, str]:
        """d with the node bound to its variable, and where `at` holds its uid given."""
        var = n.var or self.fresh()
        if d is not None and var in d.columns:
            if n.label and n.label not in self.graph.nodes:
                raise Refused(f"no such label in this scan: {n.label}")
            d = d if at is None else d.where(F.col(var)["uid"] == at)
        else:
            if n.label is None:
                labels = list(self.graph.nodes)
                t = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (self.graph._of(self.graph.nodes, x, "label") for x in labels))
            else:
                t = self.graph._of(self.graph.nodes, n.label, "label")
            t = t.select(F.struct(*t.columns).alias(var))
            d = t if d is None else d.join(t, F.col(var)["uid"] == at) if at is not None else d.crossJoin(t)
        for key, value in n.props.items():
            d = d.where(self.prop(d, var, key) == self.column(value, set(d.columns)))
        return d, var

    def prop(self, d: DataFrame, var: str, key: str) -> Column:
        kind = d.schema[var].dataType
        return F.col(var)[key] if key in getattr(kind, "names", ()) else F.lit(None)

    def walk(self, d: DataFrame | None, path: Path) -> DataFrame:
        # a path starts at a node that is bound already, if it has one
        bound = set(d.columns) if d is not None else set()
        first = next((i for i, n in enumerate(path.nodes) if n.var in bound), 0)
        d, at = self._bind(d, path.nodes[first], None)
        here = at
        for i in range(first, len(path.steps)):
            d, here = self.go(d, here, path.steps[i], path.nodes[i + 1], path.steps[i].direction)
        here = at
        for i in range(first - 1, -1, -1):
            flipped = {"out": "in", "in": "out", "any": "any"}[path.steps[i].direction]
            d, here = self.go(d, here, path.steps[i], path.nodes[i], flipped)
        return d

    def _edges(self, s: Step, direction: str) -> DataFrame:
        """(__from, __to, __edge): edges of the step's types in its direction, as its props ask."""
        parts = []
        for name in s.types or list(self.graph.edges):
            e = self.graph._of(self.graph.edges, name, "type")
            for key, value in s.props.items():
                e = e.where((F.col(key) if key in e.columns else F.lit(None)) == self.column(value, set()))
            e = e.withColumn("__type", F.lit(name))
            one = lambda a, b, e=e: e.select(F.col(a).alias("__from"), F.col(b).alias("__to"), F.struct(F.col("__type").alias("type"), *(c for c in e.columns if c not in ("__type", "scan_id"))).alias("__edge"))
            parts += [one("src", "dst")] * (direction != "in") + ([one("dst", "src") if direction == "in" else one("dst", "src").where("__from <> __to")] if direction != "out" else [])
        same = parts[0].schema["__edge"].dataType
        if any(p.schema["__edge"].dataType != same for p in parts):
            parts = [p.withColumn("__edge", F.struct(F.col("__edge.type"), F.col("__edge.src"), F.col("__edge.dst"))) for p in parts]
        return reduce(DataFrame.unionAll, parts)

    def go(self, d: DataFrame, here: str, s: Step, n: Node, direction: str) -> tuple[DataFrame, str]:
        e = self._edges(s, direction)
        to = self.fresh()
        if not s.varied:
            var = s.var or self.fresh()
            d = d.join(e.select("__from", F.col("__to").alias(to), F.col("__edge").alias(var)), F.col(here)["uid"] == F.col("__from")).drop("__from")
        else:
            # walks of each length whose edges all differ, a level of joins each
            var, levels = s.var or self.fresh(), []
            walk = d.withColumn(to, F.col(here)["uid"]).withColumn(var, F.array().cast(f"array<{e.schema['__edge'].dataType.simpleString()}>"))
            for k in range(s.most + 1):
                if k >= s.least:
                    levels.append(walk)
                if k < s.most:
                    walk = walk.join(e, F.col(to) == F.col("__from")).where(~F.array_contains(var, F.col("__edge")))
                    walk = walk.withColumn(var, F.array_append(var, F.col("__edge"))).withColumn(to, F.col("__to")).drop("__from", "__to", "__edge")
            d = reduce(DataFrame.unionAll, levels)
        return self._bind(d, n, F.col(to))

    def project(self, d: DataFrame, c: Clause) -> DataFrame:
        names = set(d.columns)
        items = c.items if c.items is not None else [Item(("var", x), x) for x in d.columns]
        if any(aggregates(i.value) for i in items):
            keys = [self.column(i.value, names).alias(i.name) for i in items if not aggregates(i.value)]
            out = d.groupBy(*keys).agg(*(self.column(i.value, names).alias(i.name) for i in items if aggregates(i.value))).select(*(F.col(f"`{i.name}`") for i in items))
            ordered = self.order(out, c, items, set(out.columns))
        elif c.distinct:
            out = d.select(*(self.column(i.value, names).alias(i.name) for i in items)).distinct()
            ordered = self.order(out, c, items, set(out.columns))
        else:
            # an order may ask for variables that aren't returned
            wide = d.select(*(F.col(x) for x in d.columns if x not in {i.name for i in items}), *(self.column(i.value, names).alias(i.name) for i in items))
            ordered = self.order(wide, c, items, set(wide.columns)).select(*(F.col(f"`{i.name}`") for i in items))
        if c.skip:
            ordered = ordered.offset(c.skip)
        if c.limit is not None:
            ordered = ordered.limit(c.limit)
        return ordered if c.where is None else ordered.where(self.column(c.where, set(ordered.columns)))

    def order(self, d: DataFrame, c: Clause, items: list[Item], names: set[str]) -> DataFrame:
        if not c.order:
            return d
        keys = []
        for value, down in c.order:
            same = next((F.col(f"`{i.name}`") for i in items if i.value == value), None)
            k = same if same is not None else self.column(value, names)
            keys.append(k.desc_nulls_first() if down else k.asc_nulls_last())
        return d.orderBy(*keys)

    def column(self, e: Any, names: set[str], local: dict[str, Column] | None = None) -> Column:
        """An expression as a column over the bindings `names`; local: variables of list predicates."""
        local = local or {}
        of = lambda x: self.column(x, names, local)
        kind = e[0]
        if kind == "value":
            return F.lit(e[1])
        if kind == "param":
            if e[1] not in self.params:
                raise Refused(f"no such parameter: ${e[1]}")
            p = self.params[e[1]]
            return F.array(*map(F.lit, p)) if isinstance(p, (list, tuple)) else F.lit(p)
        if kind == "var":
            if e[1] in local:
                return local[e[1]]
            if e[1] not in names:
                raise Refused(f"no such variable: {e[1]}")
            return F.col(f"`{e[1]}`")
        if kind == "prop":
            return of(e[1])[e[2]]
        if kind in ("and", "or"):
            a, b = of(e[1]), of(e[2])
            return a & b if kind == "and" else a | b
        if kind == "xor":
            return of(e[1]) != of(e[2])
        if kind == "not":
            return ~of(e[1])
        if kind == "null":
            return of(e[1]).isNotNull() if e[2] else of(e[1]).isNull()
        if kind == "in":
            return F.array_contains(of(e[2]), of(e[1])) if e[2][0] != "list" else of(e[1]).isin(*(of(x) for x in e[2][1])) if e[2][1] else F.lit(False)
        if kind == "list":
            return F.array(*(of(x) for x in e[1]))
        if kind == "at":
            return F.get(of(e[1]), of(e[2]).cast("int"))
        if kind == "minus":
            return -of(e[1])
        if kind == "case":
            found = of(e[2])
            for test, value in reversed(e[1]):
                found = F.when(of(test), of(value)).otherwise(found)
            return found
        if kind in ("each", "listed"):
            var, values = (e[2], e[3]) if kind == "each" else (e[1], e[2])
            within = lambda x, t: self.column(t, names, local | {var: x})
            if kind == "listed":
                xs = of(values) if e[3] is None else F.filter(of(values), lambda x: within(x, e[3]))
                return F.transform(xs, lambda x: within(x, e[4]))
            test = lambda x: within(x, e[4])
            if e[1] == "any":
                return F.exists(of(values), test)
            if e[1] == "all":
                return F.forall(of(values), test)
            if e[1] == "none":
                return ~F.exists(of(values), test)
            return F.size(F.filter(of(values), test)) == 1
        if kind == "call":
            return self.call(e[1], e[2], e[3], of)
        a, b = of(e[1]), of(e[2])
        simple = {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "=~": lambda: F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))), "contains": lambda: F.contains(a, b), "starts": lambda: F.startswith(a, b), "ends": lambda: F.endswith(a, b), "+": lambda: self.plus(e, a, b), "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}
        if kind not in simple:
            raise Refused(f"not allowed here: {kind}")
        return simple[kind]()

    def plus(self, e: Any, a: Column, b: Column) -> Column:
        """Sums of numbers, joins of texts (where one side is written as text)."""
        texts = any(x[0] == "value" and isinstance(x[1], str) for x in (e[1], e[2])) or any(x[0] == "+" and any(y[0] == "value" and isinstance(y[1], str) for y in x[1:]) for x in (e[1], e[2]))
        return F.concat(a.cast("string"), b.cast("string")) if texts else a + b

    def call(self, name: str, distinct: bool, args: list[Any] | None, of: Callable[[Any], Column]) -> Column:
        if args is None:
            if name != "count":
                raise Refused(f"{name}(*) isn't allowed")
            return F.count(F.lit(1))
        if name in AGGREGATES:
            if len(args) != 1:
                raise Refused(f"{name} takes one value")
            x = of(args[0])
            if distinct:
                return {"count": F.count_distinct, "collect": F.collect_set, "sum": F.sum_distinct}.get(name, AGGREGATES[name])(x)
            return AGGREGATES[name](x)
        if name not in FUNCTIONS or distinct:
            raise Refused(f"this function isn't allowed: {name}")
        return FUNCTIONS[name](*map(of, args))


def scope_problem(query: str, key: str = "scan_id") -> str | None:
    """Why a query that has to name its scan itself doesn't, or null: each path of each MATCH needs a node whose `key` is the
    parameter, by its properties, by a condition that holds in any case, or by a variable that was tied to it before.  WITH
    hands on what it names bare; branches of a UNION stand alone."""
    try:
        branches = Parser(query).query()
    except Refused as error:
        return str(error)
    asked = ("param", key)

    def holds(e: Any) -> set[str]:
        """Variables that a condition ties to the scan, whatever else holds."""
        if e is None:
            return set()
        if e[0] == "and":
            return holds(e[1]) | holds(e[2])
        sides = {e[1], e[2]} if e[0] == "=" and all(isinstance(x, tuple) for x in e[1:]) else set()
        return {x[1][1] for x in sides if asked in sides and x[0] == "prop" and x[2] == key and x[1][0] == "var"}

    for clauses, _ in branches:
        tied: set[str] = set()
        for c in clauses:
            if c.kind == "match":
                tied |= holds(c.where)
                waiting = list(c.paths)
                while waiting:
                    done = [p for p in waiting if any(n.props.get(key) == asked or n.var in tied for n in p.nodes)]
                    if not done:
                        return f"a path isn't tied to ${key}"
                    for p in done:
                        tied |= {n.var for n in p.nodes if n.var}
                    waiting = [p for p in waiting if p not in done]
            elif c.kind == "with" and c.items is not None:
                tied = {i.name for i in c.items if i.value[0] == "var" and i.value[1] in tied}
    return None
