"""Browse, search, count and list articles."""

from pyspark.sql import functions as F

from pressmill.functions.matching import string_array, words
from pressmill.functions.text import clean_content, contains_any_case, text_of

LIST_COLUMNS = ["id", "title", "author", "account_name", "url", "publish_time"]


def newest_first():
    """Dated articles by publication, then the others by crawl time, ids last."""
    return [F.col("publish_time").desc_nulls_last(), F.col("crawl_time").desc_nulls_last(), F.col("id").desc()]


def by_account(df, account=None):
    """Articles of one account, or all (Q2)."""
    return df.filter(F.col("account_name") == account) if account else df


def preview(df, length=200):
    """List columns with the beginning and length of the body (Q6)."""
    body = F.coalesce(F.col("content"), F.lit(""))
    return df.select(*LIST_COLUMNS, "crawl_time", F.left(body, F.lit(length)).alias("content_preview"),
                     F.length(body).alias("content_length"))


def page(df, account=None, limit=20, offset=0, after=None):
    """One page of the article list (Q1); limit is kept within 1..100.

    The page is found on ids and dates, then bodies are read for its ids only.  A deep
    page is better named by the last row before it: ``after`` is (publish_time,
    crawl_time, id), and no rows are sorted to be skipped.
    """
    limit = max(1, min(limit, 100))
    keys = by_account(df, account).select("id", "publish_time", "crawl_time")
    if after is not None:
        keys = keys.filter(_behind(*after))
    keys = keys.orderBy(*newest_first()).offset(offset).limit(limit)
    ids = [r["id"] for r in keys.collect()]   # at most 100
    return preview(df.filter(F.col("id").isin(ids))).orderBy(*newest_first())


def _behind(publish_time, crawl_time, article_id):
    """Rows that come after a given one in the order of ``newest_first``."""
    def later(column, value):
        c = F.col(column)
        if value is None:
            return F.lit(False), c.isNull()
        return c.isNull() | (c < F.lit(value)), c == F.lit(value)
    first, same = later("publish_time", publish_time)
    second, same_second = later("crawl_time", crawl_time)
    return F.coalesce(first | (same & (second | (same_second & (F.col("id") < article_id)))), F.lit(False))


def search_matches(df, query):
    """Articles with the text in title or body, in the manner of LIKE (Q3)."""
    return df.filter(contains_any_case("title", query) | contains_any_case("content", query))


def search(df, query, limit=20):
    return preview(search_matches(df, query), 300).orderBy(*newest_first()).limit(limit)


def fulltext_matches(df, query):
    """Articles that hold any word of the query."""
    wanted = string_array(sorted({w for w in query.lower().split() if w}))
    return df.filter(F.arrays_overlap(words(F.lower(text_of())), wanted))


def inverted_index(df):
    """One row per word and article; write it partitioned by word for repeated search."""
    return df.select("id", F.explode(F.array_distinct(words(F.lower(text_of())))).alias("word")).filter("word <> ''")


def index_lookup(index, query):
    """Ids that an inverted index lists for any word of the query."""
    wanted = sorted({w for w in query.lower().split() if w})
    return index.filter(F.col("word").isin(wanted)).select("id").distinct()


def by_id(df, article_id):
    return df.filter(F.col("id") == article_id)


def by_url(df, url):
    return df.filter(F.col("url") == url)


def count_articles(df, account=None):
    """Number of articles, of one account or all (Q5)."""
    return by_account(df, account).agg(F.count("*").alias("total"))


def page_info(df, account=None, limit=20, offset=0):
    """Pagination data of a page (Q7)."""
    return count_articles(df, account).select(
        "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"),
        (F.lit(offset + limit) < F.col("total")).alias("has_more"))


def overview(df):
    """Articles, accounts and authors; a missing name counts as one more name (Q8).

    Counts per pair come first, so the distinct counts run on few rows.
    """
    pairs = df.groupBy("account_name", "author").agg(F.count("*").alias("n"))
    def names(c):
        return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_articles"),
                     F.coalesce(names("account_name"), F.lit(0)).alias("total_accounts"),
                     F.coalesce(names("author"), F.lit(0)).alias("total_authors"))


def top_names(df, column, limit=10):
    """Names with most articles (Q9)."""
    return (df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("cnt"))
            .orderBy(F.desc("cnt"), F.col("name").asc_nulls_last()).limit(limit))


def most_recent(df, limit=10):
    """Newest articles (Q10)."""
    return df.select(*LIST_COLUMNS, "crawl_time").orderBy(*newest_first()).limit(limit).select(*LIST_COLUMNS)


def account_authors(df):
    """Authors of every account with their number of articles: the long form of Q11's list."""
    return df.groupBy("account_name", "author").agg(F.count("*").alias("cnt"))


def accounts(df):
    """Accounts with article and author counts and their newest article (Q11)."""
    rank = F.struct(F.col("publish_time").isNotNull(), F.col("publish_time"), F.col("crawl_time"), F.col("id"))
    newest = F.max(F.struct(rank.alias("rank"), F.struct("title", "publish_time", "url").alias("a")))
    per_author = df.groupBy("account_name", "author").agg(F.count("*").alias("n"), newest.alias("newest"))
    return (per_author.groupBy("account_name").agg(
        F.sum("n").alias("article_count"), F.count("*").alias("author_count"), F.max("newest").alias("newest"))
        .select("account_name", "article_count", "author_count",
                F.col("newest.a.title").alias("latest_title"),
                F.col("newest.a.publish_time").alias("latest_publish_time"),
                F.col("newest.a.url").alias("latest_url")))


def detail(df, images="images"):
    """Detail view: cleaned body against the original, three images, 1000 characters (Q12)."""
    body = F.coalesce(F.col("content"), F.lit(""))
    df = df.withColumn("_clean", clean_content(body))
    extra = []
    if images in df.columns:
        pics = F.coalesce(F.col(images), F.array().cast("array<string>"))
        extra = [F.size(pics).alias("image_count"), F.slice(pics, 1, 3).alias("first_images")]
    return df.select(*LIST_COLUMNS, "crawl_time", F.length(body).alias("content_length"),
                     F.length("_clean").alias("cleaned_length"),
                     F.left("_clean", F.lit(1000)).alias("preview"), *extra)


def sorted_for_list(df, by="date"):
    """Order of the list export: newest, by title or by author (Q14)."""
    keys = {"date": F.col("publish_time").desc_nulls_last(), "title": F.col("title").asc_nulls_first(),
            "author": F.col("author").asc_nulls_first()}
    return df.orderBy(keys[by], F.col("id"))
