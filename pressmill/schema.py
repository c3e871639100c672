"""Schemas of the tables and of the JSON files that operators read."""

from pyspark.sql import types as T

ARTICLES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("publish_time", T.TimestampNTZType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("cover_image", T.StringType()),
    T.StructField("read_count", T.IntegerType()),
    T.StructField("like_count", T.IntegerType()),
    T.StructField("comment_count", T.IntegerType()),
    T.StructField("raw_html", T.StringType()),
    T.StructField("crawl_time", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

CRAWL_JOBS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_articles", T.LongType()),
    T.StructField("crawled_articles", T.LongType()),
    T.StructField("failed_articles", T.LongType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

ATTRIBUTE_FIELDS = ["title", "url", "author", "introduce", "full_content", "episode", "time"]
ATTRIBUTES = T.StructType([T.StructField(n, T.StringType()) for n in ATTRIBUTE_FIELDS])

# One article of a dump in either layout: nested under ``attributes`` or flat.
DUMP_ARTICLE = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("attributes", ATTRIBUTES)]
    + [T.StructField(n, T.StringType()) for n in ATTRIBUTE_FIELDS + ["content", "publish_time"]]
)
DUMP = T.StructType([
    T.StructField("export_info", T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("total", T.LongType()),
        T.StructField("export_time", T.StringType()),
        T.StructField("merge_time", T.StringType()),
    ])),
    T.StructField("articles", T.ArrayType(DUMP_ARTICLE)),
])
API_PAGE = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("attributes", ATTRIBUTES)]))),
    T.StructField("meta", T.StructType([T.StructField("pagination", T.StructType([
        T.StructField("page", T.LongType()),
        T.StructField("pageCount", T.LongType()), T.StructField("total", T.LongType())]))])),
])
