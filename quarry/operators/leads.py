"""Leads and verdicts: structural dedup, ranking for reports, prices of calls, row caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Confidence and decision in their order.
CONFIDENCE, DECISIONS = ("LOW", "MEDIUM", "HIGH"), ("CONFIRM", "INCONCLUSIVE", "REJECT", "ERROR")


def order_of(x: Column, names: tuple[str, ...]) -> Column:
    """The place of a name, from 0; past the end for any other."""
    at = F.array_position(F.array(*map(F.lit, names)), x)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(names)))


def fingerprint(file: Column, cwe: Column, function: Column, line: Column) -> Column:
    """Struct of file, weakness and function or else line; null if one of the three is missing."""
    at = F.coalesce(F.nullif(function, F.lit("")), line.cast("string"))
    return F.when(file.isNotNull() & cwe.isNotNull() & at.isNotNull(), F.struct(file.alias("file"), cwe.alias("cwe"), at.alias("at")))


def dedup(leads: DataFrame, by: list[str]) -> DataFrame:
    """The leads that stay, with kept_index, dense in each run (`by`).

    leads: by, index, shape, text, confidence, source_uid, sink_uid, file, line, function, cwe.  Of leads with both ends
    of a flow, the first of each pair of ends stays.  The others with a fingerprint stay if no flow of that fingerprint
    came before them: of these the surest takes the place of the first.  The rest stay if their shape and their text's
    first 80 characters are new.
    """
    anchored = F.coalesce((F.col("source_uid") != "") & (F.col("sink_uid") != ""), F.lit(False))
    d = leads.withColumn("__fp", fingerprint(F.col("file"), F.col("cwe"), F.col("function"), F.col("line")))
    d = d.withColumn("__kind", F.when(anchored, 0).when(F.col("__fp").isNotNull(), 1).otherwise(2))
    first = Window.partitionBy(*by, "source_uid", "sink_uid").orderBy("index")
    flows = d.where("__kind = 0").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumn("__slot", F.col("index"))
    earliest = flows.where("__fp is not null").groupBy(*by, "__fp").agg(F.min("index").alias("__flow"))
    same = Window.partitionBy(*by, "__fp")
    marked = d.where("__kind = 1").withColumn("__slot", F.min("index").over(same))
    marked = marked.withColumn("__n", F.row_number().over(same.orderBy(order_of(F.col("confidence"), CONFIDENCE).desc(), "index"))).where("__n = 1").drop("__n")
    marked = marked.join(earliest, [*by, "__fp"], "left").where("__flow is null or __flow > __slot").drop("__flow")
    new = Window.partitionBy(*by, "shape", F.substring("text", 1, 80)).orderBy("index")
    rest = d.where("__kind = 2").withColumn("__n", F.row_number().over(new)).where("__n = 1").drop("__n").withColumn("__slot", F.col("index"))
    kept = flows.unionByName(marked).unionByName(rest)
    at = F.row_number().over(Window.partitionBy(*by).orderBy("__slot", "index")) - 1
    return kept.withColumn("kept_index", at.cast("bigint")).drop("__fp", "__kind", "__slot")


def ranked(verdicts: DataFrame) -> DataFrame:
    """Verdicts in a report's order: decision, centrality of the sink from high to low, lead's index."""
    return verdicts.orderBy(order_of(F.col("decision"), DECISIONS), F.coalesce("sink_centrality", F.lit(0.0)).desc(), "lead_index")


def price(rates: DataFrame, calls: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """calls with usd: tokens priced by rates (model, input, output, in dollars per million), a table of a few models.

    A model is found by its name, an alias, a known name inside it or around it, an alias inside it; else the call costs
    0.  Cache reads cost a tenth.  Cache writes cost 1.25 and 2 times the input (5 minutes, 1 hour); the price is null
    if these two don't add up to all writes.
    """
    known = [tuple(r) for r in rates.select("model", "input", "output").orderBy("model").collect()]
    m = F.lower(F.trim(F.coalesce("model", F.lit(""))))
    by_name = {k: (i, o) for k, i, o in known}
    cases = [(m == k, v) for k, v in by_name.items()] + [(m == a, by_name[k]) for a, k in aliases.items()]
    cases += [(F.contains(m, F.lit(k)) | F.contains(F.lit(k), m), v) for k, v in by_name.items()] + [(F.contains(m, F.lit(a)), by_name[k]) for a, k in aliases.items()]
    found = F.lit(None).cast("struct<i:double,o:double>")
    for fits, (i, o) in reversed(cases):
        found = F.when(fits & (m != ""), F.struct(F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o"))).otherwise(found)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    writes = zero("write_5m") * 1.25 + zero("write_1h") * 2.0
    fits = (zero("cache_write") == 0) | ((F.col("write_5m").isNotNull() | F.col("write_1h").isNotNull()) & (zero("write_5m") + zero("write_1h") == F.col("cache_write")))
    writes = F.when(zero("cache_write") == 0, 0.0).otherwise(writes)
    r = F.col("__rate")
    usd = (zero("input_tokens") * r["i"] + writes * r["i"] + zero("cache_read") * r["i"] * 0.1 + zero("output_tokens") * r["o"]) / 1e6
    return calls.withColumn("__rate", found).withColumn("usd", F.when(r.isNull(), 0.0).when(fits, usd)).drop("__rate")


def cap_rows(d: DataFrame, by: list[str], order: list[Column], field_cap: int = 1000, result_cap: int = 4000) -> DataFrame:
    """The first rows of each group whose JSON together has at most result_cap characters, the first row in any case.

    Text fields are cut to field_cap characters before; truncated tells whether something of the group was cut.
    """
    kinds = dict(d.dtypes)
    long = [c for c, t in kinds.items() if t == "string" and c not in by]
    cut = F.lit(False)
    for c in long:
        cut = cut | (F.length(c) > field_cap)
    d = d.withColumn("__cut", F.coalesce(cut, F.lit(False)))
    for c in long:
        d = d.withColumn(c, F.when(F.length(c) > field_cap, F.concat(F.substring(c, 1, field_cap), F.lit("...[truncated]"))).otherwise(F.col(c)))
    w = Window.partitionBy(*by).orderBy(*order)
    names = [c for c in d.columns if c != "__cut"]
    d = d.withColumn("__n", F.row_number().over(w)).withColumn("__size", F.sum(F.length(F.to_json(F.struct(*names)))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = (F.col("__n") == 1) | (F.col("__size") <= result_cap)
    whole = Window.partitionBy(*by)
    d = d.withColumn("__keep", keep).withColumn("truncated", F.max(F.col("__cut") | ~F.col("__keep")).over(whole))
    return d.where("__keep").drop("__cut", "__n", "__size", "__keep")


def sarif_results(verdicts: DataFrame) -> DataFrame:
    """(run_id, sarif, unlocated): one SARIF 2.1.0 document a run, as JSON, and how many confirmed leads have no file.

    verdicts: run_id, lead_index, decision, text, file, line, line_end, function, cwe.  Confirmed and inconclusive leads
    with a file are results; rules are their distinct weaknesses, sorted.
    """
    v = verdicts.where(F.col("decision").isin("CONFIRM", "INCONCLUSIVE"))
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    print_of = F.sha1(F.concat_ws("|", t("file"), t("cwe"), F.when(t("function") != "", t("function")).otherwise(t("line"))))
    rule = F.coalesce("cwe", F.lit("unclassified"))
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"), F.col("line_end").alias("endLine")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    level = F.when(F.col("decision") == "CONFIRM", "error").otherwise("warning")
    result = F.struct("lead_index", F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(t("text").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(print_of.alias("primary")).alias("partialFingerprints")).alias("r"))
    has = F.col("file").isNotNull()
    g = v.groupBy("run_id").agg(F.array_sort(F.collect_list(F.when(has, result))).alias("rs"), F.array_sort(F.collect_set(F.when(has, rule))).alias("rules"), F.count_if(~has).alias("unlocated"))
    tool = F.struct(F.struct(F.lit("quarry").alias("name"), F.transform("rules", lambda x: F.struct(x.alias("id"))).alias("rules")).alias("driver"))
    run = F.struct(tool.alias("tool"), F.transform("rs", lambda x: x["r"]).alias("results"))
    return g.select("run_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"), "unlocated")
