"""Aggregations and window computations over calls, definitions and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S


def edge_counts(refs: DataFrame, src: str = "caller", dst: str = "callee") -> DataFrame:
    """Multiplicity of each edge, self-references and file-level callers left out."""
    return refs.where(F.col(src).isNotNull() & (F.col(src) != F.col(dst))).groupBy(src, dst).agg(F.count("*").alias("n"))


def def_counts(defs: DataFrame, name: str, kind: str, *order: str) -> DataFrame:
    """Definitions of each name, the kind of the first one and whether the name is ubiquitous (more than 5)."""
    return defs.groupBy(name).agg(F.count("*").alias("def_count"), F.min_by(kind, F.struct(*order)).alias("first_kind")).withColumn("ubiquitous", F.col("def_count") > 5)


def budget_prefix(df: DataFrame, cost: Column, budget: int, order: list[Column], by: list[str] = (), keep_first: bool = True, at_least: int = 0) -> DataFrame:
    """Rows in order as long as their running cost stays within the budget; the first stays in any case.

    In ascending order of cost this is also the greedy cut that skips what doesn't fit. Where every
    row is known to cost `at_least` something, no more than that many can fit, and a bounded top-k
    comes before the running sum instead of all rows in one task.
    """
    if at_least and not by:
        df = df.orderBy(*order).limit(budget // at_least + 1)
    w = Window.partitionBy(*by).orderBy(*order)
    run = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("running_cost", run).withColumn("position", F.row_number().over(w))
    fits = F.col("running_cost") <= budget
    return out.where(fits | (F.col("position") == 1) if keep_first else fits)


def idf(tokens: DataFrame, item: str, token: str, items: Column | int) -> DataFrame:
    """Smoothed inverse document frequency ln((n + 1) / (df + 1)) + 1 of each token."""
    n = F.lit(items) if isinstance(items, int) else items
    return tokens.groupBy(token).agg(F.countDistinct(item).alias("df")).withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def resolution_rates(df: DataFrame, by: list[str], resolution: str = "resolution") -> DataFrame:
    """Hallucination and grounding rates of exact, not_found and indeterminate; the last counts in neither part."""
    r = F.col(resolution)
    missing, decided = F.count_if(r == "not_found"), F.count_if(r.isin("exact", "not_found"))
    return df.groupBy(*by).agg(
        missing.alias("numerator"), decided.alias("denominator"), F.count_if(r == "indeterminate").alias("excluded"),
        S.rate(missing, decided).alias("rate"), (1 - S.rate(missing, decided)).alias("grounding"))


def nearest_rank(value: str, q: float) -> Column:
    """The nearest-rank percentile: the value at place ceil(q * n)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def latency_stats(samples: DataFrame, by: list[str], value: str, ok: str) -> DataFrame:
    """Attempts, and nearest-rank percentiles, whole mean and maximum of those that succeeded."""
    good = samples.where(F.col(ok)).groupBy(*by).agg(
        *[nearest_rank(value, q).cast("long").alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))],
        F.expr(f"sum({value}) div count({value})").alias("mean"), F.max(value).alias("max"), F.count("*").alias("ok_count"))
    return samples.groupBy(*by).agg(F.count("*").alias("count")).join(good, by, "left")


def histogram(samples: DataFrame, by: list[str], micros: Column) -> DataFrame:
    """(by, bucket, n, running): a log2 histogram with running counts."""
    counts = samples.groupBy(*by, S.log2_bucket(micros).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("running", F.sum("n").over(Window.partitionBy(*by).orderBy("bucket")))


def histogram_percentiles(hist: DataFrame, by: list[str], points: dict[str, float]) -> DataFrame:
    """Lower edge, in whole milliseconds, of the bucket in which each percentile is reached."""
    total = F.max("running").over(Window.partitionBy(*by))
    with_total = hist.withColumn("_total", total)
    edge = F.floor(F.pow(F.lit(2.0), F.col("bucket")) / 1000)
    return with_total.groupBy(*by).agg(*[F.min(F.when(F.col("running") >= F.ceil(F.col("_total") * p), edge)).alias(n) for n, p in points.items()])


def rolling_lower_median(df: DataFrame, value: str, order: list[str], by: list[str] = (), rows: int = 16) -> DataFrame:
    """The lower median of the last `rows` values up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    seen = F.sort_array(F.collect_list(value).over(w))
    return df.withColumn("_seen", seen).withColumn("rolling_median", F.element_at("_seen", (F.floor((F.size("_seen") - 1) / 2) + 1).cast("int"))).drop("_seen")


def upper_median(value: str) -> Column:
    """The value at place n // 2 of the sorted values: the lower median from the top, by counts of values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def upper_rank(value: str, share: float) -> Column:
    """The value at place floor((1 - share) * n) of the sorted values: the nearest rank of `share` from the top."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value} DESC)")


def call_counters(calls: DataFrame, method: str) -> DataFrame:
    """Calls of each method, and of all under a null method."""
    return calls.rollup(method).agg(F.count("*").alias("n"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Hits over lookups of all caches together, 0 without lookups."""
    return F.coalesce(F.try_divide(F.sum(hits).cast("double"), F.sum(hits + misses).cast("double")), F.lit(0.0))


def severity_counts(findings: DataFrame, severity: str = "severity") -> DataFrame:
    return findings.agg(*[F.count_if(F.col(severity) == s).alias(s) for s in ("critical", "warning", "info")])


def wilson_by(df: DataFrame, by: list[str], success: Column) -> DataFrame:
    p, lo, hi = S.wilson(F.col("successes"), F.col("n"))
    return df.groupBy(*by).agg(F.count_if(success).alias("successes"), F.count("*").alias("n")).withColumns({"p": p, "lo": lo, "hi": hi})


def mcnemar(a: DataFrame, b: DataFrame, task: str, success: str) -> DataFrame:
    """Discordant pairs of two arms over the same tasks, and their p-value."""
    pairs = a.select(task, F.col(success).alias("_a")).join(b.select(task, F.col(success).alias("_b")), task)
    return pairs.agg(F.count_if(~F.col("_a") & F.col("_b")).alias("b01"), F.count_if(F.col("_a") & ~F.col("_b")).alias("b10")).withColumn("p_value", S.mcnemar_p("b01", "b10"))


def compare_metrics(baseline: DataFrame, current: DataFrame, key: str, bands: dict[str, float], ceilings: dict[str, float], exact: list[str]) -> DataFrame:
    """(key, metric, kind): pass or regression for each metric, missing or new for a row that only one side has."""
    metrics = [*exact, *bands, *ceilings]
    b = baseline.select(F.col(key), *[F.col(m).alias(f"b_{m}") for m in metrics], F.lit(True).alias("_b"))
    c = current.select(F.col(key), *[F.col(m).alias(f"c_{m}") for m in metrics], F.lit(True).alias("_c"))
    rows = []
    for m in metrics:
        x, y = F.col(f"b_{m}"), F.col(f"c_{m}")
        ok = x.eqNullSafe(y) if m in exact else S.within_band(x, y, bands[m]) if m in bands else S.under_ceiling(x, y, ceilings[m])
        rows.append(F.struct(F.lit(m).alias("metric"), F.when(ok, "pass").otherwise("regression").alias("kind")))
    lone = F.struct(F.lit("presence").alias("metric"), F.when(F.col("_c").isNull(), "missing").otherwise("new").alias("kind"))
    both = F.col("_b") & F.col("_c")
    return b.join(c, key, "full_outer").select(key, F.explode(F.when(both, F.array(*rows)).otherwise(F.array(lone))).alias("r")).select(key, "r.*")


def token_reduction(tasks: DataFrame, baseline: str, ours: str) -> DataFrame:
    """Sums, and the interpolated median of the percentage saved per task."""
    saved = S.percent_saved(F.col(baseline), F.col(ours))
    return tasks.withColumn("_saved", saved).agg(F.count("*").alias("tasks"), F.sum(baseline).alias("baseline_tokens"), F.sum(ours).alias("our_tokens"), F.percentile("_saved", F.lit(0.5)).alias("median_saved"))
