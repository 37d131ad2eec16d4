"""Scores of generated artefacts: composite, leaderboard, reconciliation of audit reports, batch summary, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The dimensions and what each can earn.
DIMENSIONS = {"schema": 25, "verbatim": 30, "pedagogy": 25, "uniqueness": 20}
#: Runs of these statuses count as failed and stay out of all means.
FAILED = ("FAILED", "RETRYING")
FATAL_CAP = 59.0
INVALID_SCORE, DEFAULT_SCORE, PASS_SCORE, LOW_SCORE = 20, 90, 80, 75


def composite(scores: dict[str, Column], delivered: Column | None = None, expected: Column | None = None, fatal: Column | None = None) -> Column:
    """Earned share of what the applicable (not null) dimensions can earn, in percent; 0 if none applies. With coverage:
    85 % or more cost a tenth at most, less costs in proportion. A fatal flag caps the score."""
    weight = sum((F.when(c.isNotNull(), F.lit(float(DIMENSIONS[k]))).otherwise(0.0) for k, c in scores.items()), F.lit(0.0))
    earned = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in scores.values()), F.lit(0.0))
    out = F.when(weight > 0, 100.0 * earned / weight).otherwise(0.0)
    if delivered is not None and expected is not None:
        share = delivered / expected
        out = F.when((expected > 0) & (delivered < expected), out * F.when(share >= 0.85, F.greatest(share, F.lit(0.9))).otherwise(share)).otherwise(out)
    return out if fatal is None else F.when(fatal, F.least(out, F.lit(FATAL_CAP))).otherwise(out)


def leaderboard(logs: DataFrame, digits: int = 1) -> DataFrame:
    """A row for each model, best composite first, models of equal score by their newest run. logs: model, status,
    task_type, composite, ts and a nullable column for each dimension. Successful arbitration runs don't count."""
    counted = logs.where((F.col("task_type") != "wsd_arbitration") | (F.col("status") == "FAILED"))
    ok = ~F.col("status").isin(*FAILED)
    done = F.count_if(ok)

    def mean(k: str) -> Column:
        n = F.count(F.when(ok, F.col(k)))
        share = F.sum(F.when(ok, F.col(k))) / (n * DIMENSIONS[k]) * 100
        return F.when(done == 0, 0.0).when(n == 0, 100.0).otherwise(F.round(share, digits))

    board = counted.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"),
        done.alias("success_runs"),
        F.count_if(~ok).alias("failed_runs"),
        F.when(done == 0, 0.0).otherwise(F.round(F.sum(F.when(ok, F.col("composite"))) / done, digits)).alias("composite_score"),
        *(mean(k).alias(f"{k}_avg") for k in DIMENSIONS),
        F.max("ts").alias("newest"),
    )
    place = F.row_number().over(Window.orderBy(F.desc("composite_score"), F.desc("newest"), "model"))
    return board.withColumn("place", place).drop("newest")


def as_bool(c: Column) -> Column:
    """true, yes and 1 as text are true, other text false, null null."""
    return F.lower(F.trim(c)).isin("true", "yes", "1")


def reconcile(items: DataFrame, reports: DataFrame) -> DataFrame:
    """Report scores from item verdicts. items: report_id, item_index, valid, score (null or beyond 0-100: the default);
    reports: report_id, expected_items, divergences. Missing items score 0 and cap at 59, other flaws cap at 70."""
    valid = F.coalesce(F.col("valid"), F.lit(True))
    score = F.when(~valid, INVALID_SCORE).when(F.col("score").between(0, 100), F.bround("score")).otherwise(DEFAULT_SCORE)
    sums = items.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum(score).alias("total"), F.count_if(~valid).alias("invalid"), F.array_sort(F.collect_list(F.when(~valid, F.col("item_index")))).alias("flawed"))
    r = reports.join(sums, "report_id", "left")
    n, expected = F.coalesce("n_items", F.lit(0)), F.coalesce("expected_items", F.lit(0))
    expected = F.when(expected == 0, n).otherwise(expected)
    missing, wide = F.greatest(expected - n, F.lit(0)), F.greatest(expected, n)
    base = F.when(wide > 0, F.bround(F.coalesce("total", F.lit(0)) / wide)).otherwise(100).cast("long")
    r = r.select("report_id", n.cast("long").alias("n_items"), missing.cast("long").alias("missing"), base.alias("base"), (F.coalesce("divergences", F.lit(0)) + F.coalesce("invalid", F.lit(0)) + missing).cast("long").alias("flaws"), F.coalesce("flawed", F.array().cast("array<long>")).alias("flawed"))
    overall = F.when(F.col("flaws") == 0, F.col("base")).when(F.col("missing") > 0, F.least("base", F.lit(59))).otherwise(F.least("base", F.lit(70)))
    return r.withColumn("overall", overall.cast("long")).withColumn("passed", (F.col("flaws") == 0) & (F.col("base") >= PASS_SCORE))


def defective_items(items: DataFrame) -> DataFrame:
    """Positions from 0 of items that are invalid, diverge or score under 75, a sorted array for each report with any.
    Indices count from 1 if none is 0 or one is as large as the number of items. items: report_id, position, item_index
    (null: the position), valid, score, diverges."""
    by = Window.partitionBy("report_id")
    given = F.col("item_index")
    one_based = F.coalesce((F.count(given).over(by) > 0) & ((F.min(F.abs(given)).over(by) > 0) | (F.max(given).over(by) == F.count(F.lit(1)).over(by))), F.lit(False))
    at = F.when(given.isNotNull(), given - one_based.cast("int")).otherwise(F.col("position"))
    bad = ~F.coalesce("valid", F.lit(True)) | F.coalesce("diverges", F.lit(False)) | (F.coalesce("score", F.lit(100)) < LOW_SCORE)
    return items.withColumn("at", at).where(bad).groupBy("report_id").agg(F.array_sort(F.collect_set("at")).alias("defective"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over re-audited units: counts, and the mean of the accuracies that are numbers. results: error, passed,
    before, accuracy."""
    ok = F.col("error").isNull()
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("audited"),
        F.count_if(ok & F.col("passed")).alias("passed"),
        F.count_if(ok & ~F.coalesce("passed", F.lit(False))).alias("failed"),
        F.count_if(~ok).alias("errors"),
        F.count_if(ok & ~F.col("passed").eqNullSafe(F.col("before"))).alias("changed"),
        F.round(F.avg("accuracy"), 3).alias("avg_accuracy"),
    )


def uniqueness(items: DataFrame, group: str, key: str, weight: float = 20.0) -> DataFrame:
    """What a group of items earns for distinct keys: all if none repeats, in proportion from 80 % on, else nothing."""
    k = F.lower(F.trim(F.col(key)))
    n, d = F.count(k), F.count_distinct(k)
    g = items.where(F.coalesce(k, F.lit("")) != "").groupBy(group).agg(n.alias("n_items"), d.alias("n_distinct"))
    share = F.col("n_distinct") / F.col("n_items")
    return g.withColumn("earned", F.when(share == 1, weight).when(share < 0.8, 0.0).otherwise(F.round(share * weight, 1)))
