"""Code-property graphs as JSON: a whole GraphSON document, or one record for each function, one a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.code import stable_uid

#: Placeholders that stand for a missing value.
MISSING = ("", "<empty>", "N/A", "<unknown>")
SEGMENT = (
    "seg bigint, method_id bigint, vertices array<struct<id:bigint,label:string,properties:map<string,string>>>, edges array<struct<label:string,outV:bigint,inV:bigint>>, "
    "call_edges array<array<bigint>>, cross_rd array<array<bigint>>, files array<struct<id:bigint,properties:map<string,string>>>, source_file struct<file_id:bigint>"
)


def untag(v: Column, kind: str = "string") -> Column:
    """A value without the type tags around it: up to three nested {"@type", "@value"}, and lists of one value."""
    paths = ["$['@value']['@value'][0]['@value']", "$['@value']['@value'][0]", "$['@value'][0]['@value']", "$['@value'][0]", "$['@value']['@value']", "$['@value']", "$[0]['@value']['@value']", "$[0]['@value']", "$[0]", "$"]
    return F.coalesce(*(F.try_variant_get(v, p, kind) for p in paths))


def graphson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, label, props) and edges (label, src, dst, src_label, dst_label) of GraphSON files, tags removed.

    One document is one row, as it has no lines to part it at; use segments() for graphs that outgrow a task.
    """
    docs = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("doc"))
    graph = F.coalesce(F.try_variant_get("doc", "$['@value']", "variant"), F.col("doc"))
    docs = docs.select(F.try_variant_get(graph, "$.vertices", "array<variant>").alias("vs"), F.try_variant_get(graph, "$.edges", "array<variant>").alias("es"))
    v = docs.select(F.explode("vs").alias("v"))
    props = F.try_variant_get("v", "$.properties", "map<string,variant>")
    clean = F.transform_values(props, lambda _, x: untag(x))
    vertices = v.select(untag(F.try_variant_get("v", "$.id", "variant"), "bigint").alias("id"), F.try_variant_get("v", "$.label", "string").alias("label"), clean.alias("props"))
    e = docs.select(F.explode("es").alias("e"))
    at = lambda k: untag(F.try_variant_get("e", f"$.{k}", "variant"), "bigint")
    text = lambda k: F.try_variant_get("e", f"$.{k}", "string")
    edges = e.select(text("label").alias("label"), at("outV").alias("src"), at("inV").alias("dst"), text("outVLabel").alias("src_label"), text("inVLabel").alias("dst_label"))
    return vertices, edges


def present(x: Column) -> Column:
    """The value, or null for a placeholder."""
    return F.when(~x.isin(*MISSING), x)


def project(vertices: DataFrame, edges: DataFrame, labels: dict[str, list[str]], kinds: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Vertices of the labels with the properties that these list, and edges of the (label, from, to) kinds."""
    props = F.lit(None).cast("map<string,string>")
    for label, names in labels.items():
        props = F.when(F.col("label") == label, F.map_filter("props", lambda k, v: k.isin(*names) & v.isNotNull())).otherwise(props)
    keep = F.lit(False)
    for label, a, b in kinds:
        keep = keep | ((F.col("label") == label) & (F.col("src_label") == a) & (F.col("dst_label") == b))
    return vertices.where(F.col("label").isin(*labels)).withColumn("props", props), edges.where(keep)


def calls(vertices: DataFrame, scan_id: str) -> DataFrame:
    """scan_id, uid, id, name, code, file, line, column of calls: missing code falls back to the name, the line to 0."""
    p = lambda k: present(F.col("props")[k])
    d = vertices.where("label = 'CALL'").select("id", p("NAME").alias("name"), p("CODE").alias("code"), p("FILENAME").alias("file"), F.coalesce(p("LINE_NUMBER").try_cast("bigint"), F.lit(0)).alias("line"), p("COLUMN_NUMBER").try_cast("bigint").alias("column"))
    d = d.withColumn("code", F.coalesce("code", "name", F.lit(""))).withColumn("file", F.coalesce("file", F.lit("<unknown>")))
    uid = stable_uid(F.lit(scan_id), F.lit("Call"), F.col("file"), F.col("line"), F.col("column"), F.col("code"))
    return d.select(F.lit(scan_id).alias("scan_id"), uid.alias("uid"), "id", "name", "code", "file", "line", "column")


def entry_methods(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id of internal methods with a known file, a parameter and a real name that nobody calls, or that are callbacks."""
    p = lambda k: present(F.col("props")[k])
    m = vertices.where("label = 'METHOD'").where(F.coalesce(~(p("IS_EXTERNAL") == "true"), F.lit(True)) & p("FILENAME").isNotNull() & ~F.coalesce(p("NAME"), F.lit("<")).rlike("^<|^:program$"))
    m = m.select("id")
    params = edges.where("label = 'AST' and dst_label = 'METHOD_PARAMETER_IN'").select(F.col("src").alias("id")).distinct()
    called = edges.where("label = 'CALL' and dst_label = 'METHOD'").select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    callback = edges.where("label = 'REF' and dst_label = 'METHOD'").select(F.col("dst").alias("id")).distinct().withColumn("callback", F.lit(True))
    flagged = m.join(params, "id", "left_semi").join(called, "id", "left").join(callback, "id", "left")
    return flagged.where("called is null or callback").select("id")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Records of a segment file, a row each; lines that aren't JSON are dropped, as a torn last line is."""
    return spark.read.schema(SEGMENT).option("mode", "DROPMALFORMED").json(path)


def segment_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (method_id, id, label, props) and edges (method_id, label, src, dst) of segment records.

    Of a method that comes more than once the record of the largest segment counts, whatever the order in which files
    are read; edges are a multiset inside a record.
    """
    last = records.where("method_id is not null").groupBy("method_id").agg(F.max_by(F.struct(*(c for c in records.columns if c != "method_id")), F.coalesce("seg", F.lit(-1))).alias("r"))
    one = last.select("method_id", "r.*")
    nodes = one.select("method_id", F.explode("vertices").alias("v")).select("method_id", "v.id", "v.label", F.col("v.properties").alias("props"))
    inside = one.select("method_id", F.explode("edges").alias("e")).select("method_id", "e.label", F.col("e.outV").alias("src"), F.col("e.inV").alias("dst"))
    pair = lambda c, label: one.select("method_id", F.explode(c).alias("e")).select("method_id", F.lit(label).alias("label"), F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst"))
    return nodes, inside.unionAll(pair("call_edges", "CALL")).unionAll(pair("cross_rd", "REACHING_DEF"))
