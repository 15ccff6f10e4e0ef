"""Runs of an evaluation: queue, states, usage, pair metrics with paired resampling, samples, gates, and reviews' verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.leads import DECISIONS, order_of
from quarry.operators.matching import base_name, same_file
from quarry.plans.cut import cut

# States after which a run isn't tried again.
TERMINAL = ("ok", "crashed", "hung", "error")


def plan(arms: list[str], items: DataFrame, runs: int) -> DataFrame:
    """Every (arm, repo, commit_sha, case_id, run_no) of arms and items (repo, commit_sha, case_id)."""
    d = items.select(F.explode(F.array(*map(F.lit, arms))).alias("arm"), "repo", "commit_sha", "case_id")
    return d.withColumn("run_no", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def reconcile(attempts: DataFrame) -> DataFrame:
    """attempts whose status running becomes crashed: when a queue is planned, what still runs belongs to a dead process."""
    return attempts.withColumn("status", F.when(F.col("status") == "running", "crashed").otherwise(F.col("status")))


def pending(planned: DataFrame, attempts: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """planned slots whose latest attempt (slot, attempt_no, status) isn't terminal, with next_attempt."""
    slot = ["arm", "repo", "commit_sha", "case_id", "run_no"]
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    a = reconcile(attempts).select("arm", "repo", blank("commit_sha"), blank("case_id"), "run_no", "attempt_no", "status")
    last = a.groupBy(*slot).agg(F.max_by("status", "attempt_no").alias("status"), F.max("attempt_no").alias("last"))
    d = planned.join(last, slot, "left").where(F.col("status").isNull() | ~F.col("status").isin(*terminal))
    return d.select(*slot, (F.coalesce("last", F.lit(0)) + 1).alias("next_attempt"))


def run_state(d: DataFrame) -> Column:
    """done, stopped, running, incomplete or malformed, from has_result, has_stop, alive, readable."""
    return F.when(~F.col("readable"), "malformed").when(F.col("has_result"), "done").when(F.col("has_stop"), "stopped").when(F.col("alive"), "running").otherwise("incomplete")


_TOKENS = ("uncached_in", "cache_read", "cache_write", "out", "reasoning")


def usage(d: DataFrame) -> DataFrame:
    """(id, uncached_in, cache_read, cache_write, out, reasoning, total) of rows (id, vendor, raw JSON); null where not said.

    claude: sums over its models of what they say, else its one usage; codex: input without cached, which both must be
    given.  reasoning is part of out and isn't added again.
    """
    model = "map<string,struct<inputTokens:bigint,cacheReadInputTokens:bigint,cacheCreationInputTokens:bigint,outputTokens:bigint>>"
    one = "struct<input_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>"
    r = F.from_json("raw", f"struct<modelUsage:{model},usage:{one}>")
    d = d.withColumn("__r", r).withColumn("__m", F.map_values("__r.modelUsage"))
    some = F.coalesce(F.size("__m") > 0, F.lit(False))

    def summed(field: str) -> Column:
        given = F.filter(F.transform("__m", lambda x: x[field]), lambda x: x.isNotNull())
        return F.when(F.size(given) > 0, F.aggregate(given, F.lit(0).cast("bigint"), lambda s, x: s + x))

    u = lambda field: F.col(f"__r.usage.{field}")
    claude = {"uncached_in": F.when(some, summed("inputTokens")).otherwise(u("input_tokens")), "cache_read": F.when(some, summed("cacheReadInputTokens")).otherwise(u("cache_read_input_tokens")), "cache_write": F.when(some, summed("cacheCreationInputTokens")).otherwise(u("cache_creation_input_tokens")), "out": F.when(some, summed("outputTokens")).otherwise(u("output_tokens"))}
    fresh = u("input_tokens") - u("cached_input_tokens")
    codex = {"uncached_in": F.when(fresh.isNotNull(), F.greatest(fresh, F.lit(0))), "cache_read": u("cached_input_tokens"), "out": u("output_tokens"), "reasoning": u("reasoning_output_tokens")}
    none = F.lit(None).cast("bigint")
    cols = {k: F.when(F.col("vendor") == "claude", claude.get(k, none)).when(F.col("vendor") == "codex", codex.get(k, none)) for k in _TOKENS}
    d = d.withColumns(cols).drop("__r", "__m")
    total = sum((F.coalesce(c, F.lit(0)) for c in _TOKENS[:4]), F.lit(0).cast("bigint"))
    return d.select("id", *_TOKENS, total.alias("total"))


PAIR_COUNTS = ("n_vulnerable", "flagged_vulnerable", "n_patched", "flagged_patched", "n_negative", "flagged_negative", "two_sided", "correct")


def pair_counts(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """PAIR_COUNTS of each pair of outcomes (by, label, flagged): a two-sided pair is correct if all vulnerable rows are
    flagged and no patched one is."""
    n = lambda label: F.count_if(F.col("label") == label)
    f = lambda label: F.count_if((F.col("label") == label) & F.col("flagged"))
    d = outcomes.groupBy(*by).agg(n("vulnerable").alias("n_vulnerable"), f("vulnerable").alias("flagged_vulnerable"), n("patched").alias("n_patched"), f("patched").alias("flagged_patched"), n("negative").alias("n_negative"), f("negative").alias("flagged_negative"))
    two = (F.col("n_vulnerable") > 0) & (F.col("n_patched") > 0)
    right = two & (F.col("flagged_vulnerable") == F.col("n_vulnerable")) & (F.col("flagged_patched") == 0)
    return d.withColumn("two_sided", two.cast("bigint")).withColumn("correct", right.cast("bigint"))


def metrics(prefix: str = "") -> dict[str, Column]:
    """The metrics of summed PAIR_COUNTS; null where there is nothing to divide by."""
    c = lambda name: F.col(prefix + name).cast("double")
    quiet, rest = c("n_patched") - c("flagged_patched"), c("n_patched") + c("n_negative")
    parts = {
        "vuln_recall": (c("flagged_vulnerable"), c("n_vulnerable")), "patched_silence": (quiet, c("n_patched")), "negative_silence": (c("n_negative") - c("flagged_negative"), c("n_negative")),
        "nonvuln_silence": (rest - c("flagged_patched") - c("flagged_negative"), rest), "pair_correct": (c("correct"), c("two_sided")),
    }
    return {k: F.when(n > 0, a / n) for k, (a, n) in parts.items()}


def judged(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, metrics) of dev outcomes (by, pair_id, label, flagged), sums over pairs."""
    d = pair_counts(outcomes, [*by, "pair_id"]).groupBy(*by).agg(*(F.sum(c).alias(c) for c in PAIR_COUNTS))
    n = F.col("n_vulnerable") + F.col("n_patched") + F.col("n_negative")
    return d.select(*by, n.alias("n"), *(x.alias(k) for k, x in metrics().items()))


def paired(a: DataFrame, b: DataFrame, draws: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(metric, a, b, diff, low, high): two outcome tables (row_id, pair_id, label, flagged) over the same rows.

    Pairs are drawn with replacement, the same ones for both: how often a pair is in a draw is a Poisson number made from
    a hash of seed, draw and pair.  The interval's ends are draws, not between them; a draw without anything to divide by
    is left out; fewer than two pairs give no interval.  Raises if the rows differ.
    """
    key = ["row_id", "pair_id", "label"]
    if not a.select(*key).exceptAll(b.select(*key)).unionAll(b.select(*key).exceptAll(a.select(*key))).isEmpty():
        raise ValueError("the two outcome tables aren't over the same rows")
    ca, cb = (pair_counts(x, ["pair_id"]).select("pair_id", *(F.col(c).alias(p + c) for c in PAIR_COUNTS)) for x, p in ((a, "a_"), (b, "b_")))
    cells = cut(ca.join(cb, "pair_id"))
    cols = [p + c for p in ("a_", "b_") for c in PAIR_COUNTS]
    both = lambda d: d.select(*d.columns, *(x.alias(f"{p}{k}") for p in ("a_", "b_") for k, x in metrics(p).items()))
    point = both(cells.agg(*(F.sum(c).alias(c) for c in cols), F.count("*").alias("n_pairs"))).first()
    u = (F.pmod(F.xxhash64(F.lit(seed), "draw", "pair_id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # the smallest k whose Poisson(1) distribution reaches u
    weight, p, upto = F.lit(12), 0.36787944117144233, 0.0
    steps = []
    for k in range(12):
        upto += p
        steps.append((k, upto))
        p /= k + 1
    for k, x in reversed(steps):
        weight = F.when(u <= x, k).otherwise(weight)
    drawn = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__w", weight)
    sums = both(drawn.groupBy("draw").agg(*(F.sum(F.col(c) * F.col("__w")).alias(c) for c in cols)))
    names = list(metrics())
    diffs = sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), (F.col(f"b_{k}") - F.col(f"a_{k}")).alias("d")) for k in names))).alias("x")).select("x.*").where("d is not null")
    # ends that are draws: the value at the lower and the higher place
    n = F.count("*").over(Window.partitionBy("metric"))
    at = F.row_number().over(Window.partitionBy("metric").orderBy("d")) - 1
    ranked = diffs.withColumn("n", n).withColumn("at", at)
    low = F.max(F.when(F.col("at") == F.floor((F.col("n") - 1) * (alpha / 2)), F.col("d")))
    high = F.max(F.when(F.col("at") == F.ceil((F.col("n") - 1) * (1 - alpha / 2)), F.col("d")))
    ends = {r.metric: (r.low, r.high) for r in ranked.groupBy("metric").agg(low.alias("low"), high.alias("high")).collect()} if point.n_pairs >= 2 else {}
    rows = []
    for k in names:
        x, y = point[f"a_{k}"], point[f"b_{k}"]
        rows.append((k, x, y, None if x is None or y is None else y - x, *ends.get(k, (None, None))))
    return a.sparkSession.createDataFrame(rows, "metric string, a double, b double, diff double, low double, high double")


def gate(compared: DataFrame, gain: float = 0.0, margin: float = 0.05, names: tuple[str, str, str] = ("KEEP", "RETRAIN", "INCONCLUSIVE")) -> str:
    """The decision on a candidate: kept if pairs surely gain more than `gain` and patched silence surely loses at most
    `margin`; without an interval inconclusive."""
    low = {r.metric: r.low for r in compared.where("metric in ('pair_correct', 'patched_silence')").collect()}
    if None in (low["pair_correct"], low["patched_silence"]):
        return names[2]
    return names[0] if low["pair_correct"] > gain and low["patched_silence"] >= -margin else names[1]


def sample_pairs(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """Rows of whole pairs, in the order of a hash of seed and pair, as many as fit into `most` rows one after the other; a pair
    that doesn't fit is passed over.  The driver goes through the pairs' sizes, a part at a time, until none can fit any more."""
    g = rows.groupBy("pair_id").agg(F.count("*").alias("n"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("pair_id").cast("string")), 256)
    sizes = g.where(F.col("n") <= most).orderBy(order, "pair_id").select("pair_id", "n")
    left, taken, least = most, [], g.agg(F.min("n")).first()[0] or 0
    for r in sizes.toLocalIterator():
        if r.n <= left:
            left -= r.n
            taken.append(r.pair_id)
        if left < least:
            break
    kept = rows.sparkSession.createDataFrame([(x,) for x in taken], g.select("pair_id").schema)
    return rows.join(F.broadcast(kept), "pair_id", "left_semi")  # at most `most` ids


def balanced_sample(cases: DataFrame, total: int, seed: int) -> DataFrame:
    """cases (case_id, category, real): `total` of them, spread over categories as evenly as can be, real and trap ones at most
    one apart in each.  What is left over goes to categories in the order of a hash, odd quotas give their extra case to real
    and trap by turns, cases are drawn by hash.  Raises if a category has too few of a kind."""
    hashed = lambda *x: F.sha2(F.concat_ws(":", F.lit(str(seed)), *x), 256)
    c = cut(cases.groupBy("category").agg(F.count_if("real").alias("reals"), F.count_if(~F.col("real")).alias("traps")))
    n = c.count()
    base, extra = divmod(total, n)
    bonus = F.row_number().over(Window.orderBy(hashed(F.lit("bonus"), "category"), "category")) <= extra  # a row for each category
    c = c.withColumn("quota", F.lit(base) + bonus.cast("int"))
    turn = F.row_number().over(Window.partitionBy(F.col("quota") % 2).orderBy(hashed(F.lit("odd"), "category"), "category"))
    c = cut(c.withColumn("n_real", F.floor(F.col("quota") / 2) + ((F.col("quota") % 2 == 1) & (turn % 2 == 1)).cast("int")).withColumn("n_trap", F.col("quota") - F.col("n_real")))
    short = [r.category for r in c.where("n_real > reals or n_trap > traps").collect()]
    if short:
        raise ValueError(f"too few cases to balance: {short}")
    k = F.row_number().over(Window.partitionBy("category", "real").orderBy(hashed("case_id"), "case_id"))
    d = cases.withColumn("__k", k).join(c.select("category", "n_real", "n_trap"), "category")
    return d.where(F.col("__k") <= F.when(F.col("real"), F.col("n_real")).otherwise(F.col("n_trap"))).select(*cases.columns)


def resources(d: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_missing, mean, median, most, rss): walls summed by run (by, run_id, wall, rss), then over runs."""
    r = d.groupBy(*by, "run_id").agg(F.sum("wall").alias("wall"), F.max("rss").alias("rss"))
    return r.groupBy(*by).agg(F.count("wall").alias("n"), F.count_if(F.col("wall").isNull()).alias("n_missing"), F.avg("wall").alias("mean"), F.median("wall").alias("median"), F.max("wall").alias("most"), F.max("rss").alias("rss"))


def tally(expected: DataFrame, written: DataFrame) -> DataFrame:
    """(label, expected, written, missing): counts by label of what should be there and what is."""
    e = expected.groupBy("label").agg(F.count("*").alias("expected"))
    w = written.groupBy("label").agg(F.count("*").alias("written"))
    d = e.join(w, "label", "full_outer").select("label", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("written", F.lit(0)).alias("written"))
    return d.withColumn("missing", F.col("expected") - F.col("written"))


def gravest(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """One verdict (by, seq, decision, ...) a key: the gravest decision, the first of these; slot is where the key came first."""
    rest = [c for c in verdicts.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(order_of(F.col("decision"), DECISIONS), "seq"))
    return verdicts.groupBy(*by).agg(best.alias("best"), F.min("seq").alias("slot")).select(*by, "best.*", "slot")


def interleaved(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of all shapes by turns: rank, then shape."""
    return rows.orderBy("rank", "shape").limit(most)


# Weaknesses that one place shows (risky patterns, credentials, components, settings), and those of access control.
LIGHT_CWES = ("CWE-1333", "CWE-798", "CWE-1104", "CWE-937", "CWE-1035", "CWE-16", "CWE-693", "CWE-1021")
FULL_CWES = ("CWE-284", "CWE-285", "CWE-287", "CWE-639", "CWE-862", "CWE-863")


def route(shape: Column, cwe: Column, anchored: Column, path_files: Column) -> Column:
    """light or full: how closely a lead is looked at.  path_files: the files of its path's steps, null if it isn't known.

    Weaknesses of access control and flows that don't surely stay in one file are looked at in full; the rest lightly if
    their weakness shows in one place or they are of shape C or D without a flow.
    """
    one_file = F.coalesce(F.size(F.array_distinct(F.array_compact(path_files))) == 1, F.lit(False))
    has = lambda cwes: F.coalesce(cwe.isin(*cwes), F.lit(False))
    return F.when(has(FULL_CWES) | (anchored & ~one_file), "full").when(has(LIGHT_CWES) | (shape.isin("C", "D") & ~anchored), "light").otherwise("full")


# What plain lines of a log say at a limit of the service, what error events may say besides, and the fields
# of an event that are looked at; agents that have such a limit.
LIMIT_LINES = [r"usage limit", r"rate[- ]limit(?:ed| exceeded| reached| hit)", r"hit your limit", r"(?:usage|rate|plan)\b.*limit reached", r"limit reached.*\b(?:usage|rate|plan)\b", r"(?:http|status|code)\W{0,3}429", r"\b429\b.{0,3}too many requests"]
LIMIT_EVENTS = [*LIMIT_LINES, "rate limit"]
EVENT_FIELDS, LIMITED_AGENTS = ("subtype", "error", "message", "result", "reason"), ("claude", "codex")


def shows_limit(line: Column) -> Column:
    """Whether a log line shows a limit: a plain line by its text; a JSON event, if it is shaped like an error, by its fields."""
    said = lambda text, patterns: F.coalesce(text.rlike("(?i)" + "|".join(patterns)), F.lit(False))
    event = F.try_parse_json(line)
    is_object = F.coalesce(F.schema_of_variant(event).startswith("OBJECT"), F.lit(False))
    of = lambda name: F.try_variant_get(event, f"$.{name}", "string")
    kind = F.coalesce(of("type"), F.lit(""))
    error = F.coalesce(F.try_variant_get(event, "$.is_error", "boolean"), F.lit(False)) | kind.isin("result", "error") | F.endswith(kind, F.lit("failed")) | of("error").isNotNull()
    fields = F.replace(F.concat_ws(" ", *(of(n) for n in EVENT_FIELDS)), F.lit("_"), F.lit(" "))
    return F.when(event.isNull(), said(line, LIMIT_LINES)).otherwise(is_object & error & said(fields, LIMIT_EVENTS))


def run_outcomes(runs: DataFrame, log: DataFrame) -> DataFrame:
    """runs (run_id, status, agent): those that didn't end well are aborted if a line of their log (run_id, line) shows a limit."""
    hit = log.where(shows_limit(F.col("line"))).select("run_id").distinct().withColumn("limited", F.lit(True))
    d = runs.join(hit, "run_id", "left")
    return d.withColumn("status", F.when((F.col("status") != "ok") & F.col("agent").isin(*LIMITED_AGENTS) & F.col("limited"), "aborted").otherwise(F.col("status"))).drop("limited")


def class_matches(findings: DataFrame, keys: DataFrame, most: int = 10_000) -> DataFrame:
    """(idx, key_id): findings (idx, file, text) whose file holds a key's (key_id, file, words), or is held by it, and whose
    text has one of its words.  The keys become one expression; more than `most` of them raise."""
    known = keys.select("key_id", "file", "words").limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} keys")
    held = lambda k: (F.contains("file", F.lit(k.file)) | F.contains(F.lit(k.file), F.col("file"))) & F.exists(F.array(*(F.lit(w.lower()) for w in k.words)), lambda w: F.contains(F.lower("text"), w))
    hits = [F.when(F.coalesce(held(k), F.lit(False)), F.lit(k.key_id)) for k in known if k.file and k.words]
    if not hits:
        return findings.select("idx", F.lit(None).cast(keys.schema["key_id"].dataType).alias("key_id")).limit(0)
    return findings.select("idx", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))).alias("key_id"))


def to_leads(replies: DataFrame) -> DataFrame:
    """(reply_id, item, title, file, line, cwe, confidence) of replies (reply_id, body JSON): items that aren't objects or have
    no title are dropped, an unknown confidence is LOW; a reply that can't be read has no items."""
    item = "array<struct<title:string,file:string,line:string,cwe:string,confidence:string>>"
    d = replies.select("reply_id", F.posexplode(F.from_json(F.get_json_object("body", "$.findings"), item)).alias("item", "x")).where("x.title is not null and x.title <> ''")
    confidence = F.upper(F.coalesce("x.confidence", F.lit("")))
    return d.select("reply_id", "item", "x.title", "x.file", F.col("x.line").try_cast("bigint").alias("line"), "x.cwe", F.when(confidence.isin("LOW", "MEDIUM", "HIGH"), confidence).otherwise("LOW").alias("confidence"))


def with_verdicts(leads: DataFrame, verdicts: DataFrame) -> DataFrame:
    """leads (lead_id) with decision and reason: a lead without a readable verdict (lead_id, decision, reason) is an ERROR, never
    a silent confirmation."""
    v = verdicts.where(F.col("decision").isin(*DECISIONS)).groupBy("lead_id").agg(F.min_by(F.struct("decision", "reason"), order_of(F.col("decision"), DECISIONS)).alias("v"))
    d = leads.join(v, "lead_id", "left")
    return d.select(*leads.columns, F.coalesce("v.decision", F.lit("ERROR")).alias("decision"), F.coalesce("v.reason", F.lit("not judged")).alias("reason"))


def batches(flows: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """flows with batch, `size` of them in each, in order; they are a scan's report, at most as many as it keeps."""
    return flows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size))


def batch_leads(leads: DataFrame, flows: DataFrame) -> DataFrame:
    """leads (seq, batch, flow_id) with their flow, unresolved ones with the first flow of their batch; the resolved come first
    (order: unresolved, seq)."""
    known = flows.select("flow_id", F.lit(True).alias("__known"))
    first = flows.groupBy("batch").agg(F.min_by("flow_id", "rank").alias("__first"))
    d = leads.join(known, "flow_id", "left").join(first, "batch", "left")
    return d.select("seq", "batch", F.when(F.col("__known"), F.col("flow_id")).otherwise(F.col("__first")).alias("flow_id"), F.col("__known").isNull().alias("unresolved"))


def flow_of(leads: DataFrame, flows: DataFrame) -> DataFrame:
    """(lead_id, flow_uid, path): the flow of a lead's ends, the best-ranked, else its own path."""
    f = flows.groupBy("source_uid", "sink_uid").agg(F.min_by(F.struct("uid", "path_uids"), "rank").alias("f"))
    d = leads.join(f, ["source_uid", "sink_uid"], "left")
    return d.select("lead_id", F.col("f.uid").alias("flow_uid"), F.coalesce("f.path_uids", "path").alias("path"))


def unknown_rows(runs: DataFrame, manifest: DataFrame, key: str = "row_id") -> DataFrame:
    """The keys that runs name and the manifest doesn't have."""
    return runs.select(key).where(F.col(key).isNotNull()).distinct().join(manifest.select(key), key, "left_anti")


def failures(runs: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, status, message): runs that didn't end well, with their errors (run_id, kind, message) if there are any."""
    e = events.where("kind = 'error'").select("run_id", "message")
    return runs.where("status <> 'ok'").select("run_id", "status").join(e, "run_id", "left")


def path_scores(paths: DataFrame, sites: DataFrame, entries: DataFrame) -> DataFrame:
    """(run_id, fix_traversal, entry_hit, f1): whether a run's path (run_id, at, file, line) passes a fix site (run_id, file,
    line), within ten lines, and an entry (run_id, file); f1 of its files against those of sites and entries; null without
    either."""
    p = paths.withColumn("base", base_name(F.col("file")))
    s = sites.select("run_id", F.col("file").alias("s_file"), F.col("line").alias("s_line"), base_name(F.col("file")).alias("base"))
    hit = p.join(s, ["run_id", "base"]).where(same_file(F.col("file"), F.col("s_file")) & (F.abs(F.col("line") - F.col("s_line")) <= 10)).select("run_id").distinct().withColumn("fix", F.lit(True))
    e = entries.select("run_id", F.col("file").alias("e_file"), base_name(F.col("file")).alias("base"))
    entered = p.join(e, ["run_id", "base"]).where(same_file(F.col("file"), F.col("e_file"))).select("run_id").distinct().withColumn("entry", F.lit(True))
    want = sites.select("run_id", "file").unionAll(entries.select("run_id", "file")).distinct()
    have = paths.select("run_id", "file").distinct()
    common = have.join(want, ["run_id", "file"]).groupBy("run_id").agg(F.count("*").alias("tp"))
    n = have.groupBy("run_id").agg(F.count("*").alias("a")).join(want.groupBy("run_id").agg(F.count("*").alias("b")), "run_id", "full_outer").join(common, "run_id", "left")
    tp = F.coalesce("tp", F.lit(0))
    f1 = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.when(tp == 0, 0.0).otherwise(2 * tp / (F.col("a") + F.col("b"))))
    d = n.join(hit, "run_id", "left").join(entered, "run_id", "left")
    return d.select("run_id", F.coalesce("fix", F.lit(False)).alias("fix_traversal"), F.coalesce("entry", F.lit(False)).alias("entry_hit"), f1.alias("f1"))


def mean_levels(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means of the columns over the runs that have them."""
    return scores.groupBy(*by).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns))


def merged_fix(commits: DataFrame) -> DataFrame:
    """(id, fix_date): the earliest date of the commits that a merge brought in (id, date, truncated); null if the list was cut."""
    return commits.groupBy("id").agg(F.when(~F.bool_or("truncated"), F.min("date")).alias("fix_date"))


def submodule_hits(changed: DataFrame, modules: DataFrame) -> DataFrame:
    """(id, path): changed paths (id, path) that are a submodule's (id, module) or lie under it."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    d = changed.select("id", "path", F.explode(up).alias("module"))
    return d.join(modules.select("id", "module").distinct(), ["id", "module"]).select("id", "path").distinct()


def unrecorded(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """The scans that have nodes (scan_id) and no record (scan_id)."""
    return nodes.select("scan_id").distinct().join(records.select("scan_id"), "scan_id", "left_anti")


def usable(records: DataFrame, profile: str) -> Column:
    """Why a scan's record (complete, profile) can't be used, or null."""
    return F.when(~F.coalesce("complete", F.lit(False)), "incomplete").when(F.coalesce("profile", F.lit("")) != profile, F.concat(F.lit("built with "), F.coalesce("profile", F.lit("no profile"))))
