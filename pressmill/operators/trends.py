"""Trend analytics: keywords, authors, publication times."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions import dates
from pressmill.functions.matching import code_shapes, exploded, with_whole_words
from pressmill.functions.text import contains_any_case, text_of
from pressmill.session import once
from pressmill.sources.articles import crawled_within


def with_keywords(df, lexicon=None, shapes=True, out="keywords"):
    """Add the distinct keywords of every article.

    Lexicon words are matched without case as whole words; identifiers that look like
    code are taken from the original text.
    """
    lexicon = fv.TREND_KEYWORDS if lexicon is None else lexicon
    df = df.withColumn("_text", text_of()).withColumn("_lower", F.lower("_text"))
    df = with_whole_words(df, "_lower", lexicon, out)
    if shapes:
        df = df.withColumn(out, F.array_distinct(F.concat(F.col(out), *code_shapes(F.col("_text")))))
    return df.drop("_text", "_lower")


def _window_articles(df, as_of, days):
    return crawled_within(df, as_of, days)


def top_keywords(df, as_of, days=30, limit=20, lexicon=None, shapes=True):
    """Keywords by number of articles, with their share of all articles.

    Every article also emits one null keyword, so its count is the number of articles
    and one pass gives both.  The share is computed on the few rows kept.
    """
    found = with_keywords(_window_articles(df, as_of, days), lexicon, shapes)
    counts = (found.select(F.explode(F.array_append("keywords", F.lit(None).cast("string"))).alias("keyword"))
              .groupBy("keyword").agg(F.count("*").alias("cnt")))
    kept = counts.orderBy(F.col("keyword").isNull().desc(), F.desc("cnt"), "keyword").limit(limit + 1)
    total = F.max(F.when(F.col("keyword").isNull(), F.col("cnt"))).over(Window.partitionBy(F.lit(0)))
    return (kept.withColumn("total_articles", total).filter("keyword IS NOT NULL")
            .select("keyword", "cnt", (F.col("cnt") / F.col("total_articles") * 100).alias("percentage"),
                    F.concat_ws("/", F.col("cnt").cast("string"),
                                F.col("total_articles").cast("string")).alias("articles_ratio")))


def distinct_keywords(df, as_of, days=30, lexicon=None, shapes=True):
    """Number of different keywords."""
    found = with_keywords(_window_articles(df, as_of, days), lexicon, shapes)
    return (exploded(found, [], "keywords", "keyword").groupBy("keyword").count()
            .agg(F.count("*").alias("total_keywords")))


def daily_keywords(df, as_of, days=30, lexicon=None, shapes=True):
    """Articles per publication day and keyword; undated articles are left out (T4)."""
    found = with_keywords(
        _window_articles(df, as_of, days).filter("publish_time IS NOT NULL"), lexicon, shapes)
    return (exploded(found, [dates.day("publish_time").alias("day")], "keywords", "keyword")
            .groupBy("day", "keyword").agg(F.count("*").alias("cnt")))


def _known_author(df):
    return df.filter(F.col("author").isNotNull() & ~F.col("author").isin("", "Unknown"))


def author_keyword_counts(df, as_of, days=30, lexicon=None, shapes=True):
    """Rows per author and keyword, plus one per author with a null keyword.

    The null row carries the author's own figures.  Who reads the rows more than once keeps
    them (``once``), so that texts are analysed once.
    Grouping by both columns spreads a prolific author over many tasks.
    """
    return _pairs(_known_author(_window_articles(df, as_of, days)), lexicon, shapes)


def _pairs(base, lexicon, shapes):
    found = with_keywords(base, lexicon, shapes).select(
        "author", "id", F.length("content").alias("_len"), "keywords")
    rows = found.select("author", "id", "_len", F.explode(
        F.array_append("keywords", F.lit(None).cast("string"))).alias("keyword"))
    own = F.col("keyword").isNull()
    return rows.groupBy("author", "keyword").agg(
        F.count("*").alias("cnt"),
        F.sum(F.when(own, F.col("_len"))).alias("total_words"),
        F.min(F.when(own, F.col("id"))).alias("first_id"))


def influence(articles, avg_length, diversity):
    """0.4 per article, 0.3 per 100 characters of mean length up to 10, 0.3 per keyword."""
    return (articles * F.lit(0.4) + F.least(avg_length / 100, F.lit(10.0)) * F.lit(0.3)
            + diversity * F.lit(0.3))


def author_stats(pairs, days=30):
    """Article count, text length, keyword diversity and influence per author."""
    own = F.col("keyword").isNull()
    per_author = pairs.groupBy("author").agg(
        F.max(F.when(own, F.col("cnt"))).alias("article_count"),
        F.max("total_words").alias("total_words"),
        F.min("first_id").alias("first_id"),
        F.count("keyword").alias("keyword_diversity"))
    avg_length = F.col("total_words") / F.col("article_count")
    return (per_author.withColumn("avg_article_length", avg_length)
            .withColumn("influence_score", influence(
                F.col("article_count"), F.col("avg_article_length"), F.col("keyword_diversity")))
            .withColumn("productivity", F.col("article_count") / days))


def author_active_month(df, as_of, days=30):
    """Month with most articles of each author; the earliest seen wins a tie."""
    base = _known_author(_window_articles(df, as_of, days))
    months = (base.groupBy("author", dates.month("publish_time").alias("month"))
              .agg(F.count("*").alias("cnt"), F.min("id").alias("first_id")))
    dated = F.col("month").isNotNull()
    best = F.max_by(F.when(dated, F.col("month")),
                    F.when(dated, F.struct("cnt", (-F.col("first_id")).alias("earlier"))))
    return months.groupBy("author").agg(
        F.coalesce(best, F.lit(fv.MONTH_MISSING)).alias("most_active_period"))


def author_top_keywords(pairs, n=5):
    """The n most frequent keywords of each author, ranked.

    The rank filter lets Spark cut each map task to n rows per author before the shuffle.
    """
    w = Window.partitionBy("author").orderBy(F.desc("cnt"), "keyword")
    return (pairs.filter("keyword IS NOT NULL").select("author", "keyword", "cnt")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n))


def author_report(df, as_of, days=30, limit=15, lexicon=None, shapes=True):
    """Authors by influence with active month and three leading keywords."""
    pairs = once(author_keyword_counts(df, as_of, days, lexicon, shapes))
    top = author_stats(pairs, days).orderBy(F.desc("influence_score"), "first_id").limit(limit)
    leading = (author_top_keywords(pairs, 3).groupBy("author").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))),
                                 lambda s: s["keyword"]), ", ").alias("top_keywords")))
    return (top.join(author_active_month(df, as_of, days), "author")
            .join(leading, "author", "left")
            .select("author", "article_count", "avg_article_length", "influence_score",
                    "most_active_period", F.coalesce("top_keywords", F.lit("")).alias("top_keywords"),
                    "productivity"))


def activity_tiers(df, as_of, days=30):
    """How many authors wrote five and more, two to four, or one article."""
    per_author = (_known_author(_window_articles(df, as_of, days))
                  .groupBy("author").agg(F.count("*").alias("n")))
    return per_author.agg(
        F.count_if(F.col("n") >= 5).alias("highly_active"),
        F.count_if(F.col("n").between(2, 4)).alias("moderately_active"),
        F.count_if(F.col("n") == 1).alias("occasionally_active"))


def hourly_counts(df, as_of, days=90, time="publish_time", seen="id"):
    """Dated articles per hour: the small table behind all publication patterns.

    ``first_id`` is the earliest article of the hour and decides ties.
    """
    return (_window_articles(df, as_of, days).filter(F.col(time).isNotNull())
            .groupBy(F.date_trunc("hour", time).alias("hour_start"))
            .agg(F.count("*").alias("cnt"), F.min(seen).alias("first_id")))


_PERIODS = {
    "day": lambda: dates.day("hour_start"),
    "week": lambda: dates.sunday_week("hour_start"),
    "month": lambda: dates.month("hour_start"),
    "hour": lambda: F.hour("hour_start").cast("string"),
}


def period_counts(hourly):
    """Articles per day, Sunday week, month and hour of day."""
    periods = F.array(*[F.struct(F.lit(name).alias("unit"), make().alias("period"))
                        for name, make in _PERIODS.items()])
    return (hourly.select(F.explode(periods).alias("p"), "cnt", "first_id")
            .groupBy("p.unit", "p.period")
            .agg(F.sum("cnt").alias("cnt"), F.min("first_id").alias("first_id")))


def daily_statistics(counts):
    """Mean, maximum and minimum over the days that have articles."""
    return counts.filter("unit = 'day'").agg(
        F.coalesce(F.avg("cnt"), F.lit(0.0)).alias("average"),
        F.coalesce(F.max("cnt"), F.lit(0)).alias("maximum"),
        F.coalesce(F.min("cnt"), F.lit(0)).alias("minimum"))


def most_active(counts):
    """Busiest day, hour and month; the earliest seen wins a tie."""
    best = F.max_by(F.struct("period", "cnt"), F.struct("cnt", (-F.col("first_id")).alias("earlier")))
    return (counts.filter("unit <> 'week'").groupBy("unit").agg(best.alias("best"))
            .select("unit", "best.period", "best.cnt"))


def cumulative_series(counts, last=30):
    """Daily counts with running total, the last days only.

    Runs on one row per calendar day.
    """
    running = Window.partitionBy("unit").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return (counts.filter("unit = 'day'")
            .withColumn("cumulative", F.sum("cnt").over(running))
            .orderBy(F.desc("period")).limit(last)
            .select(F.col("period").alias("day"), "cnt", "cumulative"))


def coverage(counts, days=90):
    """Days, weeks and months with articles, and days with articles in percent."""
    return counts.agg(
        F.count_if(F.col("unit") == "day").alias("days_with_articles"),
        F.count_if(F.col("unit") == "week").alias("active_weeks"),
        F.count_if(F.col("unit") == "month").alias("active_months"),
    ).withColumn("coverage_rate", F.col("days_with_articles") / days * 100)


def trend_summary(df, as_of, days=30, lexicon=None, shapes=True):
    """Headline of the combined report: one row.

    Each part is one row, read as a scalar subquery.
    """
    window = _window_articles(df, as_of, days)
    pairs = once(_pairs(window, lexicon, shapes))   # of all authors, unknown ones too
    lead_keyword = (pairs.filter("keyword IS NOT NULL").groupBy("keyword").agg(F.sum("cnt").alias("cnt"))
                    .orderBy(F.desc("cnt"), "keyword").limit(1).agg(F.max("keyword").alias("v")))
    stats = author_stats(_known_author(pairs), days)
    lead_author = (stats.orderBy(F.desc("influence_score"), "first_id").limit(1)
                   .agg(F.max("author").alias("v")))
    daily = daily_statistics(period_counts(hourly_counts(df, as_of, days)))
    tiers = _known_author(window).agg(F.count_distinct("author").alias("v"))
    na = F.lit("N/A")
    return window.agg(F.count("*").alias("total_articles_analyzed")).select(
        "total_articles_analyzed",
        tiers.scalar().alias("total_authors"),
        F.coalesce(lead_keyword.scalar(), na).alias("most_discussed_tech"),
        F.coalesce(lead_author.scalar(), na).alias("most_productive_author"),
        F.round(daily.select("average").scalar(), 6).alias("daily_average"))


def keyword_daily_mentions(df, keyword, as_of, days=60):
    """Published articles per day that mention a keyword anywhere (T16, data)."""
    hit = contains_any_case("title", keyword) | contains_any_case("content", keyword)
    return (df.filter(F.col("publish_time") >= dates.days_before(as_of, days)).filter(hit)
            .groupBy(dates.day("publish_time").alias("day")).agg(F.count("*").alias("cnt")))


def keyword_growth(df, keyword, as_of, days=60):
    """Mean daily mentions of the later half of days against the earlier half.

    Works on one row per calendar day.
    """
    daily = keyword_daily_mentions(df, keyword, as_of, days)
    everything = Window.partitionBy(F.lit(0))
    halves = (daily.withColumn("_rn", F.row_number().over(everything.orderBy("day")))
              .withColumn("_days", F.count("*").over(everything)))
    early = F.col("_rn") <= F.floor(F.col("_days") / 2)
    means = halves.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_mentions"),
        F.avg(F.when(early, F.col("cnt"))).alias("_early"),
        F.avg(F.when(~early, F.col("cnt"))).alias("_late"))
    growth = F.when(F.col("_early") > 0, (F.col("_late") - F.col("_early")) / F.col("_early") * 100)
    return means.select(F.lit(keyword).alias("keyword"), "total_mentions",
                        F.coalesce(growth, F.lit(0.0)).alias("growth_rate"))
