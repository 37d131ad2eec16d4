"""Score queries. Events play model runs and audited items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from .registry import query, table

RUNS = """SELECT 'm' || (user_id % 7) AS model, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RETRYING' ELSE 'SUCCESS' END AS status,
    CASE WHEN k % 10 = 0 THEN 'wsd_arbitration' ELSE 'quiz' END AS task_type, least(value, 100.0) AS composite, ts, event_id, user_id, k,
    CASE WHEN k % 5 <> 1 THEN (k % 26) END AS schema, CASE WHEN k % 3 <> 1 THEN (k % 31) END AS verbatim, CASE WHEN user_id % 7 <> 6 THEN (k % 25) END AS pedagogy, CASE WHEN k % 4 <> 1 THEN (k % 21) END AS uniqueness
    FROM (SELECT *, {k} AS k FROM events)"""
DUCK_RUNS = RUNS.format(k="CAST(json_extract(props, '$.k') AS BIGINT)")


def runs(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return e.select(
        F.concat(F.lit("m"), F.col("user_id") % 7).alias("model"),
        F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "RETRYING").otherwise("SUCCESS").alias("status"),
        F.when(F.col("k") % 10 == 0, "wsd_arbitration").otherwise("quiz").alias("task_type"),
        F.least("value", F.lit(100.0)).alias("composite"), "ts", "event_id", "user_id", "k",
        F.when(F.col("k") % 5 != 1, F.col("k") % 26).alias("schema"), F.when(F.col("k") % 3 != 1, F.col("k") % 31).alias("verbatim"),
        F.when(F.col("user_id") % 7 != 6, F.col("k") % 25).alias("pedagogy"), F.when(F.col("k") % 4 != 1, F.col("k") % 21).alias("uniqueness"),
    )


def _mean(k: str, w: int) -> str:
    return f"CASE WHEN count(*) FILTER (ok) = 0 THEN 0.0 WHEN count({k}) FILTER (ok) = 0 THEN 100.0 ELSE round(sum({k}) FILTER (ok) / (count({k}) FILTER (ok) * {w}) * 100, 4) END AS {k}_avg"


@query(f"""WITH r AS ({DUCK_RUNS}), s AS (SELECT *, status NOT IN ('FAILED', 'RETRYING') AS ok FROM r WHERE task_type <> 'wsd_arbitration' OR status = 'FAILED'),
    g AS (SELECT model, count(*) AS runs, count(*) FILTER (ok) AS success_runs, count(*) FILTER (NOT ok) AS failed_runs,
        CASE WHEN count(*) FILTER (ok) = 0 THEN 0.0 ELSE round(sum(composite) FILTER (ok) / count(*) FILTER (ok), 4) END AS composite_score,
        {", ".join(_mean(k, w) for k, w in audit.DIMENSIONS.items())}, max(ts) AS newest FROM s GROUP BY model)
    SELECT * EXCLUDE newest, row_number() OVER (ORDER BY composite_score DESC, newest DESC, model)::INT AS place FROM g""")
def leaderboard(spark, sf_dir):
    return audit.leaderboard(runs(spark, sf_dir), digits=4)


@query(f"""WITH r AS ({DUCK_RUNS}), c AS (SELECT event_id, user_id, k, 100.0 * (coalesce(schema, 0) + coalesce(verbatim, 0) + coalesce(pedagogy, 0) + coalesce(uniqueness, 0))
        / nullif(CASE WHEN schema IS NULL THEN 0 ELSE 25 END + CASE WHEN verbatim IS NULL THEN 0 ELSE 30 END + CASE WHEN pedagogy IS NULL THEN 0 ELSE 25 END + CASE WHEN uniqueness IS NULL THEN 0 ELSE 20 END, 0) AS b,
        10 + k % 7 AS delivered, 12 AS expected FROM r),
    v AS (SELECT event_id, k, CASE WHEN delivered < expected THEN coalesce(b, 0) * CASE WHEN delivered / expected >= 0.85 THEN greatest(delivered / expected, 0.9) ELSE delivered / expected END ELSE coalesce(b, 0) END AS s FROM c)
    SELECT event_id, round(CASE WHEN k % 11 = 0 THEN least(s, 59.0) ELSE s END, 6) AS composite FROM v""")
def composite_scores(spark, sf_dir):
    r = runs(spark, sf_dir)
    score = audit.composite({k: F.col(k) for k in audit.DIMENSIONS}, 10 + F.col("k") % 7, F.lit(12), F.col("k") % 11 == 0)
    return r.select("event_id", F.round(score, 6).alias("composite"))


ITEMS = """SELECT user_id AS report_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS item_index, k % 9 <> 0 OR k % 2 = 1 AS valid, CASE WHEN k % 13 = 0 THEN NULL ELSE k + 20 END AS score, k % 23 = 5 AS diverges
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'view'"""


def audited_items(spark, sf_dir):
    from pyspark.sql import Window

    k = F.from_json("props", "k bigint")["k"]
    e = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("k", k)
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.select(F.col("user_id").alias("report_id"), at.alias("item_index"), ((F.col("k") % 9 != 0) | (F.col("k") % 2 == 1)).alias("valid"), F.when(F.col("k") % 13 != 0, F.col("k") + 20).alias("score"), (F.col("k") % 23 == 5).alias("diverges"))


@query(f"""WITH i AS ({ITEMS}), u AS (SELECT DISTINCT user_id AS report_id, user_id % 4 * 5 AS expected_items, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS divergences FROM events),
    g AS (SELECT report_id, count(*) AS n, sum(CASE WHEN NOT valid THEN 20 WHEN score BETWEEN 0 AND 100 THEN score ELSE 90 END) AS total, count(*) FILTER (NOT valid) AS invalid FROM i GROUP BY report_id),
    r AS (SELECT u.report_id, divergences, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(invalid, 0) AS invalid, CASE WHEN expected_items = 0 THEN coalesce(n, 0) ELSE expected_items END AS e FROM u LEFT JOIN g USING (report_id)),
    b AS (SELECT *, greatest(e - n, 0) AS missing, CASE WHEN greatest(e, n) > 0 THEN round_even(total / greatest(e, n), 0) ELSE 100 END::BIGINT AS base FROM r),
    f AS (SELECT *, divergences + invalid + missing AS flaws FROM b)
    SELECT report_id, n AS n_items, missing, base, flaws::BIGINT AS flaws, CASE WHEN flaws = 0 THEN base WHEN missing > 0 THEN least(base, 59) ELSE least(base, 70) END AS overall, flaws = 0 AND base >= 80 AS passed FROM f""")
def reconciled_reports(spark, sf_dir):
    reports = table(spark, sf_dir, "events").select(F.col("user_id").alias("report_id")).distinct()
    reports = reports.withColumn("expected_items", F.col("report_id") % 4 * 5).withColumn("divergences", F.when(F.col("report_id") % 3 == 0, 1).otherwise(0))
    return audit.reconcile(audited_items(spark, sf_dir), reports).drop("flawed")


@query(f"""WITH i AS ({ITEMS}) SELECT report_id, list_sort(list(item_index - 1)) AS defective FROM i WHERE NOT valid OR diverges OR coalesce(score, 100) < 75 GROUP BY report_id""")
def defective_items(spark, sf_dir):
    return audit.defective_items(audited_items(spark, sf_dir).withColumn("position", F.col("item_index") - 1))


@query("""WITH l AS (SELECT d.source, d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
    u AS (SELECT source, CASE WHEN count(quality) = 0 THEN 'no source' END AS error, avg(quality) >= 0.85 AS passed, avg(toxic) < 0.1 AS before, avg(quality) AS accuracy FROM l GROUP BY source)
    SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS audited, count(*) FILTER (error IS NULL AND passed) AS passed, count(*) FILTER (error IS NULL AND NOT coalesce(passed, false)) AS failed,
        count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND passed IS DISTINCT FROM before) AS changed, round(avg(accuracy), 3) AS avg_accuracy FROM u""")
def reaudit_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    units = d.groupBy("source").agg(F.when(F.count("quality") == 0, "no source").alias("error"), (F.avg("quality") >= 0.85).alias("passed"), (F.avg("toxic") < 0.1).alias("before"), F.avg("quality").alias("accuracy"))
    return audit.batch_summary(units)


@query("""WITH g AS (SELECT conv_id, lower(trim(split_part(text, ' ', 1))) AS k FROM conversations), n AS (SELECT conv_id, count(k) AS n_items, count(DISTINCT k) AS n_distinct FROM g WHERE coalesce(k, '') <> '' GROUP BY conv_id)
    SELECT conv_id, n_items, n_distinct, CASE WHEN n_distinct = n_items THEN 20.0 WHEN n_distinct / n_items < 0.8 THEN 0.0 ELSE round(n_distinct / n_items * 20.0, 1) END AS earned FROM n""")
def uniqueness_scores(spark, sf_dir):
    return audit.uniqueness(table(spark, sf_dir, "conversations").withColumn("k", F.split_part("text", F.lit(" "), F.lit(1))), "conv_id", "k")
