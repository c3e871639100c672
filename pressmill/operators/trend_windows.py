"""Trends over several windows from one pass over the texts.

Texts are analysed once, when their articles arrive, and become additive facts: one row per day of crawl, day of
publication, author and keyword, and one with a null keyword for the articles themselves.  Windows of any
length are sums of days, so 7, 30 and 90 days are read off one table, and none of them reads a text.

An article that arrives late adds to the days it belongs to.  A batch is a folder of its own: sent again, it replaces
itself.  Facts know days, so ``as_of`` is the beginning of a day; the reports of ``trends`` take any time.

Articles without a crawl time are in no window; null texts count as empty, null and unknown authors
only for keywords; an empty table gives no rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.functions import dates
from pressmill.operators.trends import influence, with_keywords

SCHEMA = "published string, author string, keyword string, cnt long, length long, batch string, day date"


def facts(df, lexicon=None, shapes=True):
    """Additive facts of articles: ``cnt`` articles and the ``length`` of their bodies."""
    dated = df.filter("crawl_time IS NOT NULL")
    found = with_keywords(dated, lexicon, shapes, out="_keywords").select(
        F.to_date("crawl_time").alias("day"), dates.day("publish_time").alias("published"), "author",
        F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("length"), F.explode(F.array_append("_keywords", F.lit(None).cast("string"))).alias("keyword"))
    own = F.when(F.col("keyword").isNull(), F.col("length"))
    return found.groupBy("day", "published", "author", "keyword").agg(F.count("*").alias("cnt"), F.sum(own).alias("length"))


def write_facts(df, path, batch, lexicon=None, shapes=True):
    """Commit the facts of a batch of new articles; the same batch again replaces itself."""
    rows = facts(df, lexicon, shapes).repartition("day", F.pmod(F.xxhash64("author", "keyword"), F.lit(8)))
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")


def read_facts(spark, path):
    """Facts of all batches, partitioned by day: a window lists and reads its own days only."""
    return spark.read.schema(SCHEMA).option("basePath", path).parquet(path)


def _since(as_of, days):
    return F.to_date(dates.days_before(as_of, days))


def summed(rows, as_of, windows, *keys):
    """Sums per window and key: days are added up before windows are told apart, so a fact is shuffled once for all.

    ``cnt_N`` and ``length_N`` belong to the window of N days.
    """
    longest = rows.filter(F.col("day") >= _since(as_of, max(windows)))
    sums = []
    for n in windows:
        inside = F.col("day") >= _since(as_of, n)
        sums += [F.sum(F.when(inside, F.col(c))).alias(f"{c}_{n}") for c in ("cnt", "length")]
    return longest.groupBy(*keys).agg(*sums)


def _long(wide, windows):
    """One row per window, in which the key occurs."""
    each = F.array(*[F.struct(F.lit(n).alias("days"), F.col(f"cnt_{n}").alias("cnt"), F.col(f"length_{n}").alias("length")) for n in windows])
    kept = [c for c in wide.columns if not c.startswith(("cnt_", "length_"))]
    return wide.select(*kept, F.explode(each).alias("w")).select(*kept, "w.*").filter("cnt IS NOT NULL")


def top_keywords(rows, as_of, windows=(7, 30, 90), limit=20):
    """Leading keywords of every window with their share of its articles."""
    counts = _long(summed(rows, as_of, windows, "keyword"), windows)
    # The rank is filtered, so every task keeps the first rows of a window only; the null keyword counts articles and comes first.
    order = Window.partitionBy("days").orderBy(F.col("keyword").isNull().desc(), F.desc("cnt"), "keyword")
    kept = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit + 1)
    total = F.max(F.when(F.col("keyword").isNull(), F.col("cnt"))).over(Window.partitionBy("days"))
    return (kept.withColumn("_total", total).filter("keyword IS NOT NULL")
            .select("days", "keyword", "cnt", (F.col("cnt") / F.col("_total") * 100).alias("percentage"), (F.col("place") - 1).alias("rank")))


def daily_keywords(rows, as_of, windows=(7, 30, 90)):
    """Articles per publication day and keyword in every window (T4)."""
    named = rows.filter("keyword IS NOT NULL AND published IS NOT NULL")
    return _long(summed(named, as_of, windows, F.col("published").alias("day"), "keyword"), windows).drop("length")


def author_stats(rows, as_of, windows=(7, 30, 90)):
    """Articles, length, number of keywords and influence of every author in every window."""
    known = rows.filter(F.col("author").isNotNull() & ~F.col("author").isin("", "Unknown"))
    # By author and keyword first, which spreads an author who wrote a third of all articles.
    pairs = _long(summed(known, as_of, windows, "author", "keyword"), windows)
    own = F.col("keyword").isNull()
    stats = pairs.groupBy("days", "author").agg(
        F.max(F.when(own, F.col("cnt"))).alias("article_count"), F.max(F.when(own, F.col("length"))).alias("total_words"),
        F.count("keyword").alias("keyword_diversity"))
    length = F.col("total_words") / F.col("article_count")
    return (stats.withColumn("avg_article_length", length)
            .withColumn("influence_score", influence(F.col("article_count"), F.col("avg_article_length"), F.col("keyword_diversity")))
            .withColumn("productivity", F.col("article_count") / F.col("days")))
