"""Registered queries: ingest jobs, endpoint health and streams."""

from pyspark.sql import functions as F

from pressmill.operators import browse, jobs, trends
from pressmill.plans.common import (
    AS_OF, ATTEMPTS_SQL, IN_WINDOW, PROBE_WORDS, articles, attempts, keywords_cte, with_articles)
from pressmill.plans.etl_plans import clean_sql
from pressmill.session import new_shared_path
from pressmill.streaming import ingest

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def with_attempts(body, *ctes):
    return "WITH " + ",\n".join([ATTEMPTS_SQL, *ctes]) + "\n" + body


BATCHES = ("batches AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS batch, count(*) AS total_articles, count(*) FILTER (ok) AS crawled_articles, count(*) FILTER (NOT ok) AS failed_articles, "
           "min(ts) AS start_time, max(ts) AS end_time, arg_min('lost ' || host, (ts, seq)) FILTER (lost) AS error_message, "
           "CASE WHEN count(*) FILTER (lost) > 0 THEN 'failed' ELSE 'completed' END AS status FROM (SELECT *, event_type = 'error' AND seq % 97 = 0 AS lost FROM attempts) GROUP BY 1)")


def _batches(s, d):
    """Hourly batches; some errors are exceptions that end their batch."""
    lost = (F.col("event_type") == "error") & (F.col("seq") % 97 == 0)
    rows = attempts(s, d).withColumns({
        "batch": F.date_trunc("hour", "ts").cast("timestamp_ntz"),
        "error": F.when(lost, F.concat(F.lit("lost "), "host"))})
    return jobs.batch_outcomes(rows)


def _crawl_jobs(s, d):
    """Job rows of every host, in the columns of ``crawl_jobs``."""
    lost = (F.col("event_type") == "error") & (F.col("seq") % 97 == 0)
    rows = attempts(s, d).withColumns({"batch": F.col("host"), "error": F.when(lost, F.concat(F.lit("lost "), "host"))})
    return jobs.crawl_jobs(rows, F.substring("account_name", 5, 18).cast("long"))


register("j1_batch_outcomes", _batches, with_attempts("SELECT * FROM batches", BATCHES))
register("j1_crawl_jobs", _crawl_jobs, with_attempts(
    "SELECT substr(host, 5)::BIGINT AS id, host AS account_name, CASE WHEN count(*) FILTER (lost) > 0 THEN 'failed' ELSE 'completed' END AS status, "
    "count(*) AS total_articles, count(*) FILTER (ok) AS crawled_articles, count(*) FILTER (NOT ok) AS failed_articles, min(ts) AS start_time, max(ts) AS end_time, "
    "arg_min('lost ' || host, (ts, seq)) FILTER (lost) AS error_message, min(ts) AS created_at, max(ts) AS updated_at "
    "FROM (SELECT *, event_type = 'error' AND seq % 97 = 0 AS lost FROM attempts) GROUP BY host"))
register("q13_jobs_by_status", lambda s, d: jobs.jobs_by_status(_batches(s, d), "completed", 50, "batch"),
         with_attempts("SELECT * FROM batches WHERE status = 'completed' ORDER BY batch DESC LIMIT 50", BATCHES))
register("q12_detail", lambda s, d: browse.detail(articles(s, d)).select("id", "content_length", "cleaned_length", "preview"),
         with_articles("SELECT id, length(content) AS content_length, length(c) AS cleaned_length, left(c, 1000) AS preview FROM "
                       f"(SELECT *, {clean_sql('content')} AS c FROM articles)"))
PICTURES = "CASE WHEN id % 7 = 0 THEN NULL ELSE list_transform(range(0, id % 5), lambda k: url || '/' || k::VARCHAR) END"
register("q12_images",
         lambda s, d: browse.detail(articles(s, d).withColumn("images", F.when(F.col("id") % 7 != 0, F.transform(
             F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k < F.col("id") % 5),
             lambda k: F.concat("url", F.lit("/"), k.cast("string")))))).select("id", "image_count", F.array_join("first_images", "|").alias("first_images")),
         with_articles(f"SELECT id, coalesce(len(images), 0)::INT AS image_count, coalesce(array_to_string(images[1:3], '|'), '') AS first_images FROM (SELECT id, {PICTURES} AS images FROM articles)"))
register("j2_reliability", lambda s, d: jobs.endpoint_reliability(attempts(s, d)),
         with_attempts("SELECT host, port, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS failure_count, max(ts) AS last_used, "
                       "count(*) FILTER (ok) / count(*)::DOUBLE AS reliability FROM attempts GROUP BY 1, 2"))
# The failure counter is the steepest climb that ends at the last attempt: the greatest
# sum of steps over all endings, or zero.
STATE = ("steps AS (SELECT *, sum(CASE WHEN ok THEN -1 ELSE 1 END) OVER (PARTITION BY host, port ORDER BY ts DESC, seq DESC) AS ending FROM attempts), "
         "state AS (SELECT host, port, count(*) FILTER (ok) AS success_count, greatest(max(ending), 0)::BIGINT AS failure_count, max(ts) AS last_used FROM steps GROUP BY 1, 2), "
         "health AS (SELECT *, failure_count < 5 AS is_alive, CASE WHEN success_count + failure_count = 0 THEN 0.5e0 ELSE success_count / (success_count + failure_count)::DOUBLE END AS reliability FROM state)")


def _state(s, d):
    return jobs.endpoint_state(attempts(s, d))


register("j2_endpoint_state", _state, with_attempts("SELECT * FROM health", STATE))
register("j3_health_summary", lambda s, d: jobs.health_summary(_state(s, d)).withColumn("average_reliability", F.round("average_reliability", 6)),
         with_attempts("SELECT count(*) AS total, count(*) FILTER (is_alive) AS alive, count(*) FILTER (NOT is_alive) AS dead, "
                       "round(coalesce(avg(reliability) FILTER (is_alive), 0), 6) AS average_reliability FROM health", STATE))
register("j4_ranked_endpoints", lambda s, d: jobs.rank_endpoints(_state(s, d), 50),
         with_attempts("SELECT * FROM health WHERE is_alive ORDER BY reliability DESC, last_used DESC, host, port LIMIT 50", STATE))
register("j5_parse_endpoints",
         lambda s, d: jobs.parse_endpoints(attempts(s, d).select(F.when(F.col("ok"), F.concat(
             F.lit("socks5://u:p@"), "host", F.lit(":"), F.col("port").cast("string"))).otherwise(
             F.concat("host", F.lit(":"), F.col("port").cast("string"))).alias("value"))),
         with_attempts("SELECT CASE WHEN ok THEN 'socks5' ELSE 'http' END AS protocol, CASE WHEN ok THEN 'u' END AS username, CASE WHEN ok THEN 'p' END AS password, host, port FROM attempts"))

# ------------------------------------------------------------------ streams


# Articles arrive in three waves by crawl time, the earliest last.
WAVE = ("CASE WHEN crawl_time >= TIMESTAMP '2024-01-20 00:00:00' THEN 0 WHEN crawl_time >= TIMESTAMP '2024-01-10 00:00:00' THEN 1 "
        "ELSE 2 END")


def _waves(s, d, base):
    """Land the articles wave by wave; yields after each landing."""
    rows = articles(s, d).select("id", "url", "title", "content", "author", "publish_time", "crawl_time")
    wave = F.expr(WAVE.replace("TIMESTAMP '", "TIMESTAMP_NTZ'"))
    for number in range(3):
        rows.filter(wave == number).write.mode("append").parquet(f"{base}/landed")
        yield s.readStream.schema(rows.schema).parquet(f"{base}/landed")


def _ingested(s, d):
    """Stream articles into a new store, one run per wave, and read the store back."""
    base = new_shared_path(s, "ingest")
    for stream in _waves(s, d, base):
        ingest.ingest_stream(stream, f"{base}/store", f"{base}/checkpoint", lambda rows: ["id"]).awaitTermination()
    return s.read.parquet(f"{base}/store")


register("str1_stream_ingest", _ingested,
         with_articles("SELECT id, url, title, content, author, publish_time, crawl_time FROM (SELECT *, "
                       f"row_number() OVER (PARTITION BY url ORDER BY {WAVE}, id) AS rn FROM articles) WHERE rn = 1"))


def _ingested_by_keys(s, d):
    """The same, with a table of keys instead of the whole store."""
    base = new_shared_path(s, "ingest-keys")
    for stream in _waves(s, d, base):
        ingest.ingest_by_keys(stream, f"{base}/store", f"{base}/checkpoint", lambda rows: ["id"], merge_every=2).awaitTermination()
    return ingest.read_rows(s, f"{base}/store", stream.schema)


register("str1_stream_ingest_keys", _ingested_by_keys, ORACLES["str1_stream_ingest"])


def _daily(s, d):
    """Count events per day and type as a stream and add the batches up."""
    base = new_shared_path(s, "daily")
    schema = s.read.parquet(f"{d}/events.parquet").schema
    events = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    ingest.keep_counts(events, lambda rows: ingest.daily_counts(rows, "ts", "event_type"),
                       f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    return ingest.read_counts(s, f"{base}/counts", "event_type")


register("str2_stream_daily_counts", _daily,
         "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS cnt FROM events GROUP BY 1, 2")


def _daily_keywords(s, d):
    """Count keywords per publication day as articles arrive in waves."""
    base = new_shared_path(s, "daily-keywords")
    for stream in _waves(s, d, base):
        ingest.keep_counts(stream, lambda rows: trends.daily_keywords(rows, AS_OF, lexicon=PROBE_WORDS),
                           f"{base}/counts", f"{base}/checkpoint", merge_every=2).awaitTermination()
    return ingest.read_counts(s, f"{base}/counts", "keyword")


register("str2_stream_daily_keywords", _daily_keywords,
         with_articles("SELECT strftime(publish_time, '%Y-%m-%d') AS day, keyword, count(*) AS cnt FROM "
                       "(SELECT publish_time, unnest(keywords) AS keyword FROM found) WHERE publish_time IS NOT NULL GROUP BY 1, 2",
                       keywords_cte(PROBE_WORDS, IN_WINDOW.format(days=30))))
