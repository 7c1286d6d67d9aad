"""Exact quantiles, delivery timing, check roll-ups and evaluation metrics."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Conclusions of checks by bucket. Fixed values.
PASSED = ("SUCCESS", "PASSED", "PASS")
FAILED = ("ACTION_REQUIRED", "CANCELLED", "ERROR", "FAILED", "FAILURE", "STARTUP_FAILURE", "TIMED_OUT")
PENDING = ("EXPECTED", "IN_PROGRESS", "PENDING", "QUEUED", "REQUESTED", "WAITING")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, str]) -> DataFrame:
    """(*keys, n, one column for each share): the value at rank ceil(n p), p an exact decimal.

    Values are counted before they are ordered, so the running sum is over
    distinct values and equal ones never meet as rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k"))
    by = W.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("k").over(by.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(by))
    picks = []
    for name, p in shares.items():
        r = Fraction(p)
        picks.append(F.min(F.when(F.col("upto") * r.denominator >= F.col("n") * r.numerator, F.col(value))).alias(name))
    return run.groupBy(*keys).agg(F.max("n").alias("n"), *picks, F.max(value).alias("max"))


def weighted_ecdf(rows: DataFrame, keys: list[str], value: str, weight: str, shares: dict[str, str]) -> DataFrame:
    """(*keys, one column for each share): the first value whose cumulated weight is at least p of all, in decimals."""
    w = F.col(weight).cast("decimal(18,6)")
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(w).alias("w"))
    by = W.partitionBy(*keys)
    run = sums.withColumn("upto", F.sum("w").over(by.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(by))
    picks = []
    for name, p in shares.items():
        r = Fraction(p)
        at_least = F.col("upto").cast("decimal(30,6)") * r.denominator >= F.col("total").cast("decimal(30,6)") * r.numerator
        picks.append(F.min(F.when(at_least, F.col(value))).alias(name))
    return run.groupBy(*keys).agg(*picks)


def effective_size(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(*keys, n_eff, tail_ok): (sum w)^2 / sum w^2, and whether it supports a 95 % tail: n_eff (1 - p) >= 5."""
    w = F.col(weight).cast("decimal(12,2)")
    s = rows.groupBy(*keys).agg(F.sum(w).alias("s"), F.sum(w * w).alias("q"))
    ratio = F.col("s").cast("double") * F.col("s").cast("double") / F.col("q").cast("double")
    return s.select(*keys, F.round(ratio, 6).alias("n_eff"), (ratio * 0.05 >= 5).alias("tail_ok"))


def check_bucket(conclusion: Column) -> Column:
    c = F.upper(conclusion)
    return F.when(c.isin(*PASSED), "passed").when(c.isin(*FAILED), "failed").when(c.isin(*PENDING), "pending").otherwise("other")


def check_rollup(checks: DataFrame, keys: list[str], conclusion: str = "conclusion") -> DataFrame:
    """Counts by bucket and the conclusion: a failure first, then pending, then mixed, then success."""
    b = check_bucket(F.col(conclusion))
    one = lambda name: F.count_if(b == name).alias(f"checks_{name}")
    out = checks.groupBy(*keys).agg(F.count(F.lit(1)).alias("checks_total"), *map(one, ("passed", "failed", "pending", "other")))
    return out.withColumn(
        "checks_conclusion",
        F.when(F.col("checks_failed") > 0, "FAILURE").when(F.col("checks_pending") > 0, "PENDING").when(F.col("checks_other") > 0, "MIXED").otherwise("SUCCESS"),
    )


def whole_seconds(start_ms: Column, end_ms: Column) -> Column:
    """Seconds between two instants, null unless positive and whole."""
    gap = end_ms - start_ms
    return F.when((gap > 0) & (gap % 1000 == 0), (gap / 1000).cast("long"))


def ci_envelope(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, envelope_seconds, service_seconds): last end less first start over coherent spans, and the sum of each."""
    ok = spans.withColumn("service", whole_seconds(F.col("start_ms"), F.col("end_ms"))).where("service is not null")
    return ok.groupBy(*keys).agg(whole_seconds(F.min("start_ms"), F.max("end_ms")).alias("envelope_seconds"), F.sum("service").alias("service_seconds"))


def duration_reason(start_ms: Column, end_ms: Column) -> Column:
    """Why a duration can't be used, in order; null if it can."""
    gap = end_ms - start_ms
    return F.when(start_ms.isNull() | end_ms.isNull(), "missing").when(gap < 0, "negative").when(gap == 0, "zero").when(gap % 1000 != 0, "not whole seconds")


def precision_recall(gold: DataFrame, run: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(*by, true_positive, false_positive, false_negative, precision, recall, f1) of a run against gold rows by key."""
    a, b = gold.select(*by, *keys).distinct().withColumn("g", F.lit(1)), run.select(*by, *keys).distinct().withColumn("r", F.lit(1))
    j = a.join(b, [*by, *keys], "full")
    s = j.groupBy(*by).agg(
        F.count_if(F.col("g").isNotNull() & F.col("r").isNotNull()).alias("true_positive"),
        F.count_if(F.col("g").isNull()).alias("false_positive"),
        F.count_if(F.col("r").isNull()).alias("false_negative"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    ratio = lambda x, y: F.round(F.when(y > 0, x / y), 6)
    return s.select(*by, "true_positive", "false_positive", "false_negative", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
