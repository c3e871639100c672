"""Roll-ups over ingest attempts and endpoints."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill import schema

MAX_FAILURES = 5


def batch_outcomes(attempts, batch="batch", ok="ok", time="ts", error="error", tie="seq"):
    """One job row per ingest batch: totals, times, status.

    Articles that were not saved are counted; only an exception (a message in ``error``)
    makes a job fail, and the first one is kept.
    """
    first = F.min(F.when(F.col(error).isNotNull(), F.struct(time, tie, F.col(error).alias("message"))))
    return attempts.groupBy(batch).agg(
        F.count("*").alias("total_articles"),
        F.count_if(F.col(ok)).alias("crawled_articles"),
        F.count_if(~F.col(ok)).alias("failed_articles"),
        F.min(time).alias("start_time"), F.max(time).alias("end_time"), first["message"].alias("error_message"),
    ).withColumn("status", F.when(F.col("error_message").isNull(), "completed").otherwise("failed"))


def crawl_jobs(attempts, job_id, **columns):
    """Job rows in the columns of ``crawl_jobs``; the batch is the account."""
    jobs = batch_outcomes(attempts, **columns).withColumnsRenamed({columns.get("batch", "batch"): "account_name"})
    jobs = jobs.withColumns({"id": job_id, "created_at": F.col("start_time"), "updated_at": F.col("end_time")})
    return jobs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.CRAWL_JOBS])


def jobs_by_status(jobs, status=None, limit=100, created="created_at"):
    """Jobs of a status, newest first (Q13)."""
    jobs = jobs.filter(F.col("status") == status) if status else jobs
    return jobs.orderBy(F.desc(created)).limit(limit)


def reliability(successes, failures):
    """Share of successes, 0.5 without any attempt."""
    total = successes + failures
    return F.when(total == 0, 0.5).otherwise(successes / total)


def endpoint_reliability(attempts, keys=("host", "port"), ok="ok"):
    """Attempt counts and reliability of every endpoint."""
    return attempts.groupBy(*keys).agg(
        F.count_if(F.col(ok)).alias("success_count"), F.count_if(~F.col(ok)).alias("failure_count"),
        F.max("ts").alias("last_used"),
    ).withColumn("reliability", reliability(F.col("success_count"), F.col("failure_count")))


def endpoint_state(attempts, keys=("host", "port"), ok="ok", time="ts", tie="seq"):
    """Counters after replaying the attempts in order (input of J3 and J4).

    A failure adds one to the failure counter, a success takes one off but not below
    zero.  The counter after all steps is (sum of steps) - min(0, lowest running sum).
    Running sums are taken per endpoint and minute, then over the minutes of an endpoint,
    so no endpoint's attempts have to meet in one task.
    """
    keys = list(keys)
    attempts = attempts.withColumn("_minute", F.date_trunc("minute", time)).withColumn(
        "_step", F.when(F.col(ok), -1).otherwise(1))
    order = [F.col(time), F.col(tie)]
    inside = Window.partitionBy(*keys, "_minute").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    minutes = (attempts.withColumn("_run", F.sum("_step").over(inside))
             .groupBy(*keys, "_minute").agg(
                 F.sum("_step").alias("_sum"), F.min("_run").alias("_low"),
                 F.count_if(F.col(ok)).alias("_ok"), F.max(time).alias("_last")))
    before = Window.partitionBy(*keys).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.withColumn("_low", F.coalesce(F.sum("_sum").over(before), F.lit(0)) + F.col("_low"))
    state = minutes.groupBy(*keys).agg(
        F.sum("_ok").alias("success_count"),
        (F.sum("_sum") - F.least(F.lit(0), F.min("_low"))).alias("failure_count"),
        F.max("_last").alias("last_used"))
    return state.withColumns({
        "is_alive": F.col("failure_count") < MAX_FAILURES,
        "reliability": reliability(F.col("success_count"), F.col("failure_count")),
    })


def health_summary(state):
    """Endpoints alive and dead, mean reliability of the living (J3): one row."""
    alive = F.col("is_alive") & (F.col("failure_count") < MAX_FAILURES)
    return state.agg(
        F.count("*").alias("total"), F.count_if(alive).alias("alive"), F.count_if(~alive).alias("dead"),
        F.coalesce(F.avg(F.when(alive, F.col("reliability"))), F.lit(0.0)).alias("average_reliability"))


def rank_endpoints(state, limit=100, keys=("host", "port")):
    """Living endpoints by reliability, unused ones first among equals."""
    return (state.filter(F.col("is_alive") & (F.col("failure_count") < MAX_FAILURES))
            .orderBy(F.desc("reliability"), F.col("last_used").isNull().desc(), F.desc("last_used"), *keys)
            .limit(limit))


def parse_endpoints(lines, column="value"):
    """Endpoints from lines ``proto://user:password@host:port``.

    Protocol and login are optional; a line that does not read gives no row.
    """
    line = F.trim(F.col(column))
    full = r"^(?:(.*?)://)?(?:([^@:]*):([^@]*)@)?([^@:]*):\s*(\d+)\s*$"

    def part(i):
        return F.nullif(F.regexp_extract(line, full, i), F.lit(""))
    return (lines.filter(line.rlike(full) & ~line.startswith("#")).select(
        F.coalesce(part(1), F.lit("http")).alias("protocol"), part(2).alias("username"),
        part(3).alias("password"), F.regexp_extract(line, full, 4).alias("host"),
        part(5).cast("int").alias("port")))
