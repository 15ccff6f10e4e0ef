"""Evaluation: intervals, step-down tests, agreement, Pareto front, NULL-poisoned sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share, rounded to six places; nulls for no trials."""
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    side = lambda x: F.when(n > 0, F.round(x, 6))
    return side(F.greatest(F.lit(0.0), mid - half)), side(F.least(F.lit(1.0), mid + half))


def holm(tests: DataFrame, name: str, p: str) -> DataFrame:
    """Adds holm: step-down adjusted p-values.  The windows run over the family of tests, a few rows."""
    by = Window.orderBy(p, name)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    factor = F.count("*").over(all_rows) - F.row_number().over(by) + 1
    t = tests.withColumn("__f", F.least(F.lit(1.0), F.col(p) * factor))
    return t.withColumn("holm", F.max("__f").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def kappa(d: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed, kappa of two 0/1 raters; kappa is null if chance alone agrees always."""
    s = d.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", F.round("po", 6).alias("observed"), F.round(F.when(pe < 1, (F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


def poisoned_sum(x: Column) -> Column:
    """A sum that is null as soon as one value is."""
    return F.when(F.count_if(x.isNull()) > 0, None).otherwise(F.sum(x))


def pareto(d: DataFrame, cost: str, gain: str) -> DataFrame:
    """Rows that no other row beats: no row of less or equal cost has more gain, none of less cost as much."""
    by = Window.orderBy(cost)
    earlier = F.max(gain).over(by.rangeBetween(Window.unboundedPreceding, -1))
    same = F.max(gain).over(Window.partitionBy(cost))
    return d.withColumn("__e", earlier).withColumn("__s", same).where((F.col(gain) == F.col("__s")) & (F.col("__e").isNull() | (F.col(gain) > F.col("__e")))).drop("__e", "__s")


def bootstrap(cells: DataFrame, by: list[str], draws: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """by, point, low, high, p_value, n_clusters, n_undefined: log of the ratio of two arms' catches per token.

    cells: by, cluster, caught_a, tokens_a, caught_b, tokens_b, one row a cluster.  Clusters are drawn with replacement,
    both arms together; clusters that lack a number are left out.  Draws without catches in one arm count as infinite and
    keep their rank; those without any in both are left out of the interval, and count in both tails.  Bounds aren't
    interpolated.  Fewer than two clusters have no interval.  A group's clusters are one task's, a row a repository.
    """
    import numpy as np
    import pandas as pd

    def ratio(s: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(s[..., 0] * s[..., 3] / (s[..., 1] * s[..., 2]))

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        x = d.sort_values("cluster")[["caught_a", "tokens_a", "caught_b", "tokens_b"]].to_numpy(float)
        n, found = len(x), dict.fromkeys(("low", "high", "p_value", "n_undefined"))
        if n >= 2:
            rng = np.random.default_rng(seed)
            idx = rng.integers(0, n, size=(draws, n))
            r = np.concatenate([ratio(x[part].sum(axis=1)) for part in np.array_split(idx, max(1, idx.size // 1_000_000))])
            fine = np.sort(r[~np.isnan(r)])
            if len(fine):
                at = (len(fine) - 1) * np.array([alpha / 2, 1 - alpha / 2])
                found["low"], found["high"] = float(fine[int(np.floor(at[0]))]), float(fine[int(np.ceil(at[1]))])
            tail = min(np.mean((r <= 0) | np.isnan(r)), np.mean((r >= 0) | np.isnan(r)))
            found["p_value"], found["n_undefined"] = max(min(1.0, 2 * float(tail)), 1 / draws), int((~np.isfinite(r)).sum())
        row = [*key, float(ratio(x.sum(axis=0))) if n else None, found["low"], found["high"], found["p_value"], n, found["n_undefined"]]
        return pd.DataFrame([row], columns=[*by, "point", "low", "high", "p_value", "n_clusters", "n_undefined"]).astype(object)

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in by)
    d = cells.dropna(subset=["cluster", "caught_a", "tokens_a", "caught_b", "tokens_b"])
    return d.groupBy(*by).applyInPandas(run, f"{kinds}, point double, low double, high double, p_value double, n_clusters bigint, n_undefined bigint")


def pass_at(n: Column, passed: Column, k: int) -> Column:
    """The chance that one of k runs, drawn from n of which `passed` pass, does; null for fewer than k runs."""
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * F.greatest(F.lit(0.0), (n - passed - i) / (n - i))
    return F.when(n >= k, 1 - miss)


def pass_all(n: Column, passed: Column, k: int) -> Column:
    """The chance that all of k drawn runs pass; null for fewer than k runs."""
    hit = F.lit(1.0)
    for i in range(k):
        hit = hit * F.greatest(F.lit(0.0), (passed - i) / (n - i))
    return F.when(n >= k, hit)


def efficiency(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_missing, per_million: catches per million tokens of runs (caught, tokens); runs without tokens count in
    n_missing alone."""
    has = F.col("tokens").isNotNull()
    g = runs.groupBy(*by).agg(F.count_if(has).alias("n"), F.count_if(~has).alias("n_missing"), F.sum(F.when(has, F.col("caught"))).alias("__c"), F.sum("tokens").alias("__t"))
    return g.select(*by, "n", "n_missing", F.when(F.col("__t") > 0, F.col("__c") * 1e6 / F.col("__t")).alias("per_million"))


def sensitivity(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_partial, strict, loose): catches per million tokens (caught, tokens) without and with the runs whose token
    counts are partial; null without tokens."""
    d = runs.where("tokens is not null").withColumn("__whole", ~F.coalesce("partial", F.lit(False)))
    part = lambda c: F.sum(F.when(F.col("__whole"), F.col(c)))
    rate = lambda a, b: F.when(b > 0, a.cast("double") * 1e6 / b)
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("__whole")).alias("n_partial"), rate(part("caught"), part("tokens")).alias("strict"), rate(F.sum("caught"), F.sum("tokens")).alias("loose"))


def false_alarms(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_missing, rate, low, high: the share of runs with an alarm (boolean), and its bounds if those that are
    missing had none, or all."""
    hit, miss = F.count_if("alarm"), F.count_if(F.col("alarm").isNull())
    g = runs.groupBy(*by).agg(F.count("alarm").alias("n"), miss.alias("n_missing"), hit.alias("__h"))
    every = F.col("n") + F.col("n_missing")
    share = lambda a, b: F.when(b > 0, a / b)
    return g.select(*by, "n", "n_missing", share(F.col("__h"), F.col("n")).alias("rate"), share(F.col("__h"), every).alias("low"), share(F.col("__h") + F.col("n_missing"), every).alias("high"))


def youden(d: DataFrame, by: str) -> DataFrame:
    """by, tp, fp, fn, tn, tpr, fpr, j by benchmark and, with a null name, of all rows (truth, found: booleans)."""
    counts = [F.count_if(t & f).alias(n) for n, t, f in (("tp", F.col("truth"), F.col("found")), ("fp", ~F.col("truth"), F.col("found")), ("fn", F.col("truth"), ~F.col("found")), ("tn", ~F.col("truth"), ~F.col("found")))]
    g = d.rollup(by).agg(*counts)
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return g.withColumn("tpr", share("tp", "fn")).withColumn("fpr", share("fp", "tn")).withColumn("j", F.col("tpr") - F.col("fpr"))


def ppi(d: DataFrame, by: list[str], z: float = 1.96) -> DataFrame:
    """by, n_matched, n_unmatched, n_labelled, precision, low, high: prediction-powered precision.

    d: by, matched (boolean), judged and human (1.0 real, 0.0 not; human null without a label).  Matched findings are
    true; the judge's mean over the others is corrected by the mean error on the labelled ones.  No precision without
    labels, unless all are matched; no interval for fewer than two labels.
    """
    un = ~F.col("matched")
    f, e = F.when(un, F.col("judged")), F.when(un, F.col("human") - F.col("judged"))
    g = d.groupBy(*by).agg(F.count_if("matched").alias("n_matched"), F.count_if(un).alias("n_unmatched"), F.count(e).alias("n_labelled"), F.avg(f).alias("__f"), F.avg(e).alias("__e"), F.var_samp(f).alias("__vf"), F.var_samp(e).alias("__ve"))
    n, total = F.col("n_unmatched"), F.col("n_matched") + F.col("n_unmatched")
    precision = F.when((n == 0) & (F.col("n_matched") > 0), 1.0).when(F.col("n_labelled") > 0, (F.col("n_matched") + n * (F.col("__f") + F.col("__e"))) / total)
    half = F.when((F.col("n_labelled") > 1) & (n > 1), z * n / total * F.sqrt(F.col("__vf") / n + F.col("__ve") / F.col("n_labelled")))
    return g.withColumn("precision", precision).select(*by, "n_matched", "n_unmatched", "n_labelled", "precision", (F.col("precision") - half).alias("low"), (F.col("precision") + half).alias("high"))


def ac1(d: DataFrame, a: str, b: str, categories: list) -> DataFrame:
    """n, observed, ac1: agreement of two raters, corrected by how evenly the labels are spread over fixed categories."""
    s = d.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    shares = [F.avg(((F.col(a) == c).cast("double") + (F.col(b) == c).cast("double")) / 2).alias(f"__{i}") for i, c in enumerate(categories)]
    s = s.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"), *shares)
    pe = F.lit(0.0)
    for i in range(len(categories)):
        pe = pe + F.col(f"__{i}") * (1 - F.col(f"__{i}"))
    pe = pe / max(1, len(categories) - 1)
    return s.select("n", "observed", F.when(pe < 1, (F.col("observed") - pe) / (1 - pe)).alias("ac1"))


def still_rejecting(tests: DataFrame, p: str, low: str, name: str) -> DataFrame:
    """Adds rejected: whether this test and all of smaller p have a bound above zero.  Over a family of tests, a few rows."""
    w = Window.orderBy(p, name).rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("rejected", F.bool_and(F.coalesce(F.col(low) > 0, F.lit(False))).over(w))
