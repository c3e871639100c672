"""The ``articles`` table: a stored table, or a view over a documents table."""

from pyspark.sql import functions as F

from pressmill.functions.dates import days_before


READ_PARTITIONS = "pressmill.read.partitions"


def dealt(df, key):
    """The input as it is, or dealt into as many partitions as the caller has set.

    A file of one row group is one split.  Who reads such files (tests, a laptop) sets
    ``pressmill.read.partitions``; tables of many splits need nothing.
    """
    wanted = df.sparkSession.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(wanted), key) if wanted else df


def articles_from_documents(spark, sf_dir, for_text=True):
    """Articles derived from ``documents``: title is the first line, dates follow the id.

    ``for_text`` says that whole texts are going to be analysed (see ``dealt``).
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if for_text:
        docs = dealt(docs, "doc_id")
    return docs.selectExpr(
        "doc_id AS id",
        "concat('https://example.com/a/', CAST((doc_id * 9) DIV 10 AS STRING)) AS url",
        "substr(split_part(text, '\\n', 1), 1, 100) AS title",
        "text AS content",
        "CASE WHEN doc_id % 23 = 0 THEN NULL ELSE source END AS author",
        "lang AS account_name",
        "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE timestampadd(MINUTE, "
        "CAST((doc_id * 7919) % 43200 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') END AS publish_time",
        "timestampadd(MINUTE, CAST((doc_id * 104729) % 43200 AS INT), "
        "TIMESTAMP_NTZ'2024-01-02 00:00:00') AS crawl_time",
    )


def crawled_within(df, as_of, days):
    """Articles crawled in the last days before ``as_of`` (S3)."""
    return df.filter(F.col("crawl_time") >= days_before(as_of, days))


def scan(df, limit=None):
    """All articles, or the first ones by id."""
    return df if limit is None else df.orderBy("id").limit(limit)
