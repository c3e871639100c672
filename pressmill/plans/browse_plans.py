"""Registered queries: browsing, search and trends."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.operators import browse, page_map, substring_index, trend_windows, trends
from pressmill.plans.common import (
    AS_OF, IN_WINDOW, PROBE_WORDS, articles, day_sql, keywords_cte, plain_articles,
    with_articles)
from pressmill.session import new_shared_path
from pressmill.sources.articles import crawled_within, scan

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


LIST = "id, title, author, account_name, url, publish_time"
NEWEST = "publish_time IS NOT NULL DESC, publish_time DESC, crawl_time DESC, id DESC"
PREVIEW = f"SELECT {LIST}, crawl_time, left(content, {{n}}) AS content_preview, length(content) AS content_length FROM articles"

# ------------------------------------------------------------------ sources and browsing

register("s3_crawled_within",
         lambda s, d: crawled_within(plain_articles(s, d), AS_OF, 14).select("id", "url", "crawl_time"),
         with_articles(f"SELECT id, url, crawl_time FROM articles WHERE {IN_WINDOW.format(days=14)}"))
register("s5_scan_limit",
         lambda s, d: scan(articles(s, d), 100).select("id", "url", "title", "content"),
         with_articles("SELECT id, url, title, content FROM articles ORDER BY id LIMIT 100"))
register("q1_list_page",
         lambda s, d: browse.page(articles(s, d), limit=20, offset=40),
         with_articles(PREVIEW.format(n=200) + f" ORDER BY {NEWEST} LIMIT 20 OFFSET 40"))
register("q2_by_account",
         lambda s, d: browse.page(articles(s, d), account="en", limit=100),
         with_articles(PREVIEW.format(n=200) + f" WHERE account_name = 'en' ORDER BY {NEWEST} LIMIT 100"))
def _deep_page(s, d, account=None, limit=50, offset=500):
    rows = articles(s, d)
    return page_map.page(rows, page_map.build(plain_articles(s, d), every=100, accounts=account is not None), account, limit, offset)


register("q1_deep_page", _deep_page, with_articles(PREVIEW.format(n=200) + f" ORDER BY {NEWEST} LIMIT 50 OFFSET 500"))
register("q2_deep_page", lambda s, d: _deep_page(s, d, "en", 100, 130),
         with_articles(PREVIEW.format(n=200) + f" WHERE account_name = 'en' ORDER BY {NEWEST} LIMIT 100 OFFSET 130"))
register("q3_search",
         lambda s, d: browse.search(articles(s, d), "License", 50),
         with_articles(PREVIEW.format(n=300) + " WHERE title ILIKE '%License%' OR content ILIKE '%License%'"
                       f" ORDER BY {NEWEST} LIMIT 50"))
register("q3_search_wildcard",
         lambda s, d: browse.search_matches(articles(s, d), "lic_nse%ap").select("id"),
         with_articles("SELECT id FROM articles WHERE title ILIKE '%lic_nse%ap%' OR content ILIKE '%lic_nse%ap%'"))
register("q3_search_index",
         lambda s, d: substring_index.build(articles(s, d), new_shared_path(s, "substrings")).search("License", 50), ORACLES["q3_search"])
register("q3_search_index_wildcard",
         lambda s, d: substring_index.build(articles(s, d), new_shared_path(s, "substrings")).matches("lic_nse%ap").select("id"),
         ORACLES["q3_search_wildcard"])
register("q3b_fulltext",
         lambda s, d: browse.fulltext_matches(articles(s, d), "apache worthless avec").select("id"),
         with_articles("SELECT id FROM articles WHERE list_has_any(string_split_regex(lower(title || ' ' || content), "
                       "'[^\\p{L}\\p{N}_]+'), ['apache', 'worthless', 'avec'])"))
register("q3b_inverted_index",
         lambda s, d: browse.inverted_index(articles(s, d)).groupBy("word").agg(F.count("*").alias("articles")),
         with_articles("SELECT word, count(*) AS articles FROM (SELECT id, unnest(list_distinct(string_split_regex("
                       "lower(title || ' ' || content), '[^\\p{L}\\p{N}_]+'))) AS word FROM articles) "
                       "WHERE word <> '' GROUP BY word"))
register("q3b_index_lookup",
         lambda s, d: browse.index_lookup(browse.inverted_index(articles(s, d)), "Apache worthless avec"), ORACLES["q3b_fulltext"])
register("q4_by_url",
         lambda s, d: browse.by_url(plain_articles(s, d), "https://example.com/a/90").select("id", "url", "title"),
         with_articles("SELECT id, url, title FROM articles WHERE url = 'https://example.com/a/90'"))
register("q4_by_id",
         lambda s, d: browse.by_id(plain_articles(s, d), 42).select("id", "url", "title"),
         with_articles("SELECT id, url, title FROM articles WHERE id = 42"))
register("q5_count",
         lambda s, d: browse.count_articles(plain_articles(s, d), "en"),
         with_articles("SELECT count(*) AS total FROM articles WHERE account_name = 'en'"))
register("q6_preview",
         lambda s, d: browse.preview(articles(s, d)), with_articles(PREVIEW.format(n=200)))
register("q7_page_info",
         lambda s, d: browse.page_info(plain_articles(s, d), "en", 20, 100),
         with_articles("SELECT count(*) AS total, 20 AS \"limit\", 100 AS \"offset\", 120 < count(*) AS has_more "
                       "FROM articles WHERE account_name = 'en'"))
register("q8_overview",
         lambda s, d: browse.overview(plain_articles(s, d)),
         with_articles("SELECT count(*) AS total_articles, count(DISTINCT coalesce(account_name, '<none>')) AS total_accounts, "
                       "count(DISTINCT coalesce(author, '<none>')) AS total_authors FROM articles"))
for column in ("account_name", "author"):
    register(f"q9_top_{column}",
             lambda s, d, c=column: browse.top_names(plain_articles(s, d), c),
             with_articles(f"SELECT {column} AS name, count(*) AS cnt FROM articles GROUP BY 1 "
                           "ORDER BY cnt DESC, name ASC NULLS LAST LIMIT 10"))
register("q10_recent",
         lambda s, d: browse.most_recent(plain_articles(s, d)),
         with_articles(f"SELECT {LIST} FROM articles ORDER BY {NEWEST} LIMIT 10"))
register("q11_accounts",
         lambda s, d: browse.accounts(plain_articles(s, d)),
         with_articles(
             "SELECT account_name, article_count, author_count, title AS latest_title, publish_time AS latest_publish_time, "
             f"url AS latest_url FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY {NEWEST}) AS rn, "
             "count(*) OVER (PARTITION BY account_name) AS article_count FROM articles) "
             "JOIN (SELECT account_name AS n, count(DISTINCT coalesce(author, '<none>')) AS author_count FROM articles GROUP BY 1) "
             "ON n = account_name WHERE rn = 1"))
register("q11_account_authors",
         lambda s, d: browse.account_authors(plain_articles(s, d)),
         with_articles("SELECT account_name, author, count(*) AS cnt FROM articles GROUP BY 1, 2"))
register("q14_sorted_by_title",
         lambda s, d: browse.sorted_for_list(articles(s, d), "title").select("id", "title", "author"),
         with_articles("SELECT id, title, author FROM articles ORDER BY title, id"))
register("q14_sorted_by_author",
         lambda s, d: browse.sorted_for_list(plain_articles(s, d), "author").select("id", "author"),
         with_articles("SELECT id, author FROM articles ORDER BY author NULLS FIRST, id"))
register("q14_sorted_by_date",
         lambda s, d: browse.sorted_for_list(plain_articles(s, d), "date").select("id", "publish_time"),
         with_articles("SELECT id, publish_time FROM articles ORDER BY publish_time DESC NULLS LAST, id"))

# ------------------------------------------------------------------ trends

WHERE30 = IN_WINDOW.format(days=30)
KNOWN = "author IS NOT NULL AND author NOT IN ('', 'Unknown')"


def top_sql(lexicon, limit=20):
    return with_articles(
        "SELECT keyword, count(*) AS cnt, count(*) / (SELECT count(*) FROM found)::DOUBLE * 100 AS percentage, "
        "count(*)::VARCHAR || '/' || (SELECT count(*) FROM found)::VARCHAR AS articles_ratio "
        f"FROM (SELECT unnest(keywords) AS keyword FROM found) GROUP BY keyword ORDER BY cnt DESC, keyword LIMIT {limit}",
        keywords_cte(lexicon, WHERE30))


register("t1_keywords",
         lambda s, d: trends.with_keywords(articles(s, d), fv.TREND_KEYWORDS + PROBE_WORDS).select(
             "id", F.array_join(F.array_sort("keywords"), "|").alias("keywords")),
         with_articles("SELECT id, array_to_string(list_sort(keywords), '|') AS keywords FROM found",
                       keywords_cte(fv.TREND_KEYWORDS + PROBE_WORDS)))
register("t2_top_keywords", lambda s, d: trends.top_keywords(articles(s, d), AS_OF), top_sql(fv.TREND_KEYWORDS))
register("t2_top_keywords_probe",
         lambda s, d: trends.top_keywords(articles(s, d), AS_OF, lexicon=PROBE_WORDS), top_sql(PROBE_WORDS))
register("t3_distinct_keywords",
         lambda s, d: trends.distinct_keywords(articles(s, d), AS_OF, lexicon=PROBE_WORDS),
         with_articles("SELECT count(DISTINCT k) AS total_keywords FROM (SELECT unnest(keywords) AS k FROM found)",
                       keywords_cte(PROBE_WORDS, WHERE30)))
register("t4_daily_keywords",
         lambda s, d: trends.daily_keywords(articles(s, d), AS_OF, lexicon=PROBE_WORDS),
         with_articles(f"SELECT {day_sql('publish_time')} AS day, keyword, count(*) AS cnt FROM "
                       "(SELECT publish_time, unnest(keywords) AS keyword FROM found) WHERE publish_time IS NOT NULL GROUP BY 1, 2",
                       keywords_cte(PROBE_WORDS, WHERE30)))

# Three windows from one pass over the texts; articles that came early but arrive late are a batch of their own.
WINDOWS = (7, 30, 90)


def _facts(s, d):
    path = new_shared_path(s, "trend-facts")
    rows = articles(s, d)
    late = F.col("crawl_time") < F.expr("timestamp_ntz'2024-01-12 00:00:00'")
    for name, batch in (("first", rows.filter(~late)), ("late", rows.filter(late)), ("late", rows.filter(late))):
        trend_windows.write_facts(batch, path, name, lexicon=PROBE_WORDS)
    return trend_windows.read_facts(s, path)


def windows_sql(select):
    """One SELECT per window; ``{days}`` is its length and ``{found}`` its articles with keywords."""
    return with_articles(" UNION ALL ".join(
        f"(SELECT {n} AS days, * FROM ({select.replace('{days}', str(n)).replace('{found}', f'(SELECT * FROM found WHERE {IN_WINDOW.format(days=n)})')}))"
        for n in WINDOWS), keywords_cte(PROBE_WORDS))


register("t2_keyword_windows",
         lambda s, d: trend_windows.top_keywords(_facts(s, d), AS_OF, WINDOWS),
         windows_sql("SELECT keyword, cnt, cnt / n::DOUBLE * 100 AS percentage, row_number() OVER (ORDER BY cnt DESC, keyword) AS rank FROM "
                     "(SELECT keyword, count(*) AS cnt FROM (SELECT unnest(keywords) AS keyword FROM {found}) GROUP BY 1), "
                     "(SELECT count(*) AS n FROM {found}) QUALIFY rank <= 20"))
register("t4_daily_windows",
         lambda s, d: trend_windows.daily_keywords(_facts(s, d), AS_OF, WINDOWS),
         windows_sql(f"SELECT {day_sql('publish_time')} AS day, keyword, count(*) AS cnt FROM "
                     "(SELECT publish_time, unnest(keywords) AS keyword FROM {found}) WHERE publish_time IS NOT NULL GROUP BY 1, 2"))
register("t5_author_windows",
         lambda s, d: trend_windows.author_stats(_facts(s, d), AS_OF, WINDOWS),
         windows_sql("SELECT *, article_count * 0.4e0 + least(avg_article_length / 100, 10e0) * 0.3e0 + keyword_diversity * 0.3e0 AS influence_score, "
                     "article_count / {days}::DOUBLE AS productivity FROM (SELECT author, count(*) AS article_count, sum(length(content))::BIGINT AS total_words, "
                     "len(list_distinct(flatten(list(keywords)))) AS keyword_diversity, sum(length(content)) / count(*)::DOUBLE AS avg_article_length "
                     f"FROM {{found}} WHERE {KNOWN} GROUP BY author)"))

AUTHOR_CTES = [
    keywords_cte(PROBE_WORDS, f"{WHERE30} AND {KNOWN}"),
    "stats AS (SELECT author, count(*) AS article_count, sum(length(content))::BIGINT AS total_words, min(id) AS first_id, "
    "sum(length(content)) / count(*)::DOUBLE AS avg_article_length FROM found GROUP BY author)",
    "pairs AS (SELECT author, keyword, count(*) AS cnt FROM (SELECT author, unnest(keywords) AS keyword FROM found) GROUP BY 1, 2)",
    "diversity AS (SELECT author, count(*) AS keyword_diversity FROM pairs GROUP BY 1)",
    "scored AS (SELECT s.*, coalesce(d.keyword_diversity, 0) AS keyword_diversity, s.article_count * 0.4e0 "
    "+ least(s.avg_article_length / 100, 10.0e0) * 0.3e0 + coalesce(d.keyword_diversity, 0) * 0.3e0 AS influence_score, "
    "s.article_count / 30.0e0 AS productivity FROM stats s LEFT JOIN diversity d USING (author))",
    "months AS (SELECT author, strftime(publish_time, '%Y-%m') AS month, row_number() OVER (PARTITION BY author "
    "ORDER BY count(*) DESC, min(id)) AS rn FROM found WHERE publish_time IS NOT NULL GROUP BY 1, 2)",
    "lead_words AS (SELECT author, string_agg(keyword, ', ' ORDER BY rn) AS top_keywords FROM (SELECT *, row_number() OVER "
    "(PARTITION BY author ORDER BY cnt DESC, keyword) AS rn FROM pairs) WHERE rn <= 3 GROUP BY 1)",
]


def _pairs(s, d):
    return trends.author_keyword_counts(articles(s, d), AS_OF, 30, PROBE_WORDS)


register("t5_author_stats",
         lambda s, d: trends.author_stats(_pairs(s, d)).drop("first_id"),
         with_articles("SELECT author, article_count, total_words, keyword_diversity, avg_article_length, influence_score, "
                       "productivity FROM scored", *AUTHOR_CTES))
register("t6_author_report",
         lambda s, d: trends.author_report(articles(s, d), AS_OF, lexicon=PROBE_WORDS),
         with_articles("SELECT author, article_count, avg_article_length, influence_score, coalesce(month, '未知') AS most_active_period, "
                       "coalesce(top_keywords, '') AS top_keywords, productivity FROM scored LEFT JOIN "
                       "(SELECT author, month FROM months WHERE rn = 1) USING (author) LEFT JOIN lead_words USING (author) "
                       "ORDER BY influence_score DESC, first_id LIMIT 15", *AUTHOR_CTES))
register("t7_author_active_month",
         lambda s, d: trends.author_active_month(plain_articles(s, d), AS_OF),
         with_articles("SELECT author, coalesce(month, '未知') AS most_active_period FROM (SELECT DISTINCT author FROM found) "
                       "LEFT JOIN (SELECT author, month FROM months WHERE rn = 1) USING (author)",
                       *(AUTHOR_CTES[:1] + AUTHOR_CTES[5:6])))
register("t8_author_top_keywords",
         lambda s, d: trends.author_top_keywords(_pairs(s, d)),
         with_articles("SELECT * FROM (SELECT author, keyword, cnt, row_number() OVER (PARTITION BY author ORDER BY cnt DESC, keyword) "
                       "AS rank FROM pairs) WHERE rank <= 5", AUTHOR_CTES[0], AUTHOR_CTES[2]))
register("t9_activity_tiers",
         lambda s, d: trends.activity_tiers(plain_articles(s, d), AS_OF),
         with_articles("SELECT count(*) FILTER (n >= 5) AS highly_active, count(*) FILTER (n BETWEEN 2 AND 4) AS moderately_active, "
                       "count(*) FILTER (n = 1) AS occasionally_active FROM (SELECT author, count(*) AS n FROM articles "
                       f"WHERE {WHERE30} AND {KNOWN} GROUP BY 1)"))

PERIODS = ("periods AS (SELECT unit, period, count(*) AS cnt, min(id) AS first_id FROM (SELECT id, unnest(["
           "{'u': 'day', 'p': strftime(publish_time, '%Y-%m-%d')}, {'u': 'week', 'p': strftime(publish_time, '%Y-W%U')}, "
           "{'u': 'month', 'p': strftime(publish_time, '%Y-%m')}, {'u': 'hour', 'p': hour(publish_time)::VARCHAR}]) AS x "
           "FROM articles WHERE publish_time IS NOT NULL AND " + IN_WINDOW.format(days=90) + ") "
           "SELECT_X GROUP BY 1, 2)").replace("unit, period, count", "x.u AS unit, x.p AS period, count").replace(" SELECT_X", "")


def _periods(s, d):
    return trends.period_counts(trends.hourly_counts(plain_articles(s, d), AS_OF))


register("t10_period_counts",
         lambda s, d: _periods(s, d).select("unit", "period", "cnt"),
         with_articles("SELECT unit, period, cnt FROM periods", PERIODS))
register("t11_daily_statistics",
         lambda s, d: trends.daily_statistics(_periods(s, d)),
         with_articles("SELECT avg(cnt) AS average, max(cnt) AS maximum, min(cnt) AS minimum FROM periods WHERE unit = 'day'", PERIODS))
register("t12_most_active",
         lambda s, d: trends.most_active(_periods(s, d)),
         with_articles("SELECT unit, period, cnt FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY cnt DESC, first_id) AS rn "
                       "FROM periods WHERE unit <> 'week') WHERE rn = 1", PERIODS))
register("t13_cumulative",
         lambda s, d: trends.cumulative_series(_periods(s, d)),
         with_articles("SELECT period AS day, cnt, (SELECT sum(b.cnt) FROM periods b WHERE b.unit = 'day' AND b.period <= a.period)::BIGINT "
                       "AS cumulative FROM periods a WHERE unit = 'day' ORDER BY day DESC LIMIT 30", PERIODS))
register("t14_coverage",
         lambda s, d: trends.coverage(_periods(s, d)),
         with_articles("SELECT count(*) FILTER (unit = 'day') AS days_with_articles, count(*) FILTER (unit = 'week') AS active_weeks, "
                       "count(*) FILTER (unit = 'month') AS active_months, count(*) FILTER (unit = 'day') / 90.0e0 * 100 AS coverage_rate "
                       "FROM periods", PERIODS))
register("t15_trend_summary",
         lambda s, d: trends.trend_summary(articles(s, d), AS_OF, lexicon=PROBE_WORDS),
         with_articles(
             f"SELECT (SELECT count(*) FROM articles WHERE {WHERE30}) AS total_articles_analyzed, "
             f"(SELECT count(DISTINCT author) FROM articles WHERE {WHERE30} AND {KNOWN}) AS total_authors, "
             "(SELECT k FROM (SELECT unnest(keywords) AS k FROM every) GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) AS most_discussed_tech, "
             "(SELECT author FROM scored ORDER BY influence_score DESC, first_id LIMIT 1) AS most_productive_author, "
             "(SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM articles WHERE publish_time IS NOT NULL AND "
             f"{WHERE30} GROUP BY publish_time::DATE)) AS daily_average",
             keywords_cte(PROBE_WORDS, WHERE30).replace("found AS", "every AS", 1), *AUTHOR_CTES[:5]))
MENTIONS = ("daily AS (SELECT strftime(publish_time, '%Y-%m-%d') AS day, count(*) AS cnt FROM articles "
            "WHERE (title ILIKE '%license%' OR content ILIKE '%license%') AND "
            "publish_time >= TIMESTAMP '2024-02-01' - INTERVAL 60 DAY GROUP BY 1)")
register("t16_daily_mentions",
         lambda s, d: trends.keyword_daily_mentions(articles(s, d), "license", AS_OF),
         with_articles("SELECT day, cnt FROM daily", MENTIONS))
register("t16_keyword_growth",
         lambda s, d: trends.keyword_growth(articles(s, d), "license", AS_OF),
         with_articles("SELECT 'license' AS keyword, sum(cnt)::BIGINT AS total_mentions, coalesce((avg(cnt) FILTER (rn > n // 2) - "
                       "avg(cnt) FILTER (rn <= n // 2)) / avg(cnt) FILTER (rn <= n // 2) * 100, 0) AS growth_rate "
                       "FROM (SELECT *, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS n FROM daily)", MENTIONS))
