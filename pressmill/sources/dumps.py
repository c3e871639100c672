"""JSON dumps of articles and landed API pages.

A dump is one JSON document per file and is read by one task here; many files run in
parallel.  ``large_dumps`` reads one large file in many tasks; JSON Lines are split by Spark.
"""

from pyspark.sql import functions as F

from pressmill import schema
from pressmill.functions.text import clean_field


def read_dump_files(spark, path, pattern="*.json"):
    """One row per dump file: ``export_info``, ``articles``, ``file``."""
    return (spark.read.schema(schema.DUMP)
            .json(path, multiLine=True, pathGlobFilter=pattern)
            .withColumn("file", F.col("_metadata.file_name")))


def read_json_lines(spark, path, pattern="*.json"):
    """One article per line, in either layout; splittable."""
    return (spark.read.schema(schema.DUMP_ARTICLE).json(path, pathGlobFilter=pattern)
            .withColumn("file", F.col("_metadata.file_name")))


def parse_dumps(df, column="value", file="file"):
    """Dump rows from a text column that holds whole dumps (for dumps kept in a table)."""
    return df.select(F.col(file).alias("file"), F.from_json(column, schema.DUMP).alias("d")).select(
        "file", "d.export_info", "d.articles")


def dump_articles(dumps):
    """Articles of dump rows with their position in the file."""
    return (dumps.selectExpr("file", "export_info", "posexplode(articles) AS (pos, article)")
            .selectExpr("file", "export_info.source AS source", "pos", "article.*"))


def dump_headers(dumps):
    """Header of every dump: source, time and number of articles."""
    unknown = F.lit("Unknown")
    return dumps.select(
        "file",
        F.coalesce("export_info.source", unknown).alias("source"),
        F.coalesce("export_info.export_time", "export_info.merge_time", unknown).alias("export_time"),
        F.coalesce(F.size("articles"), F.lit(0)).alias("article_count"),
    )


def normalise(df):
    """One flat layout from nested or flat articles, null-safe and stripped.

    A nested article is taken from ``attributes`` alone; a flat one may carry its text
    as ``content`` and its time as ``publish_time``.
    """
    nested = F.col("attributes").isNotNull()

    def pick(name, *others):
        flat = F.coalesce(F.col(name), *[F.col(o) for o in others]) if others else F.col(name)
        return clean_field(F.when(nested, F.col(f"attributes.{name}")).otherwise(flat)).alias(name)

    keep = [c for c in ("file", "source", "file_no", "pos") if c in df.columns]
    return df.select(
        *keep, "id", pick("title"), pick("url"), pick("author"),
        pick("introduce", "content"), pick("full_content"), pick("episode"),
        pick("time", "publish_time"))


def api_items(pages):
    """Items of landed API pages with defaults.

    ``pages`` has ``data`` and ``page_no``, and ``file`` where pages were read from files.  A missing id
    becomes the running position over all pages, counted by ranges (see ``number_rows``); pages
    without a number come last, in the order of their files.  Items that are null give no row.
    """
    from pressmill.operators.numbering import number_rows

    file = F.col("file") if "file" in pages.columns else F.lit(None).cast("string").alias("file")
    items = pages.select("page_no", file, F.posexplode("data").alias("pos", "item")).filter("item IS NOT NULL")
    items = number_rows(items, [F.col("page_no").asc_nulls_last(), F.col("file").asc_nulls_first(), F.col("pos")], out="_no")
    blank = F.lit("")
    return items.select(
        F.coalesce("item.id", "_no").alias("id"),
        *[F.coalesce(f"item.attributes.{n}", blank).alias(n)
          for n in ("episode", "title", "author", "url", "time", "introduce")])


def read_api_pages(spark, path):
    """Landed API pages, one JSON document per file.

    The answers of the API need not name their page: then ``page_no`` is the last number in the name
    of the file (``page-0012.json``), and null where there is none; ``file`` orders those.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    number = F.regexp_extract(name, r"([0-9]{1,18})[^0-9]*$", 1)
    return (spark.read.schema(schema.API_PAGE).json(path, multiLine=True)
            .select("*", F.col("_metadata.file_path").alias("file"),
                    F.coalesce("meta.pagination.page", F.nullif(number, F.lit("")).cast("long")).alias("page_no")))
