"""Registered queries on the full lexicons: trends, tags, quality and vault tags of ``article_view``."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.operators import export, quality, tags, trends
from pressmill.plans import analysis_plans, browse_plans, export_plans
from pressmill.plans.analysis_plans import TEXT, WHERE30, rounded, tagging_ctes
from pressmill.plans.article_view import RICH_ARTICLES_SQL
from pressmill.plans.article_view import rich_articles as articles
from pressmill.plans.common import ARTICLES_SQL, AS_OF, PROBE_LEXICON, PROBE_WORDS, hits_sql
from pressmill.sources.articles import crawled_within

QUERIES, ORACLES = {}, {}
OLD = {**browse_plans.ORACLES, **analysis_plans.ORACLES, **export_plans.ORACLES}


def register(name, query, like):
    """A query whose SQL is that of ``like`` over the full view and lexicons."""
    sql = OLD[like].replace(ARTICLES_SQL, RICH_ARTICLES_SQL)
    sql = sql.replace(hits_sql(TEXT, PROBE_WORDS), hits_sql(TEXT, fv.TREND_KEYWORDS))
    for where in ("TRUE", WHERE30):
        for probe, full in zip(tagging_ctes(PROBE_LEXICON, where), tagging_ctes(fv.TAG_LEXICON, where)):
            sql = sql.replace(probe, full)
    recommended = [[c.replace("tg0 AS (SELECT *,", "tg0 AS (SELECT * REPLACE (left(content, 100) AS title),", 1).replace(
        TEXT, "lower(left(content, 100) || ' ' || content)") for c in tagging_ctes(x)] for x in (PROBE_LEXICON, fv.TAG_LEXICON)]
    for probe, full in zip(*recommended):
        sql = sql.replace(probe, full)
    QUERIES[name], ORACLES[name] = query, sql


def _pairs(s, d):
    return trends.author_keyword_counts(articles(s, d), AS_OF, 30)


register("t1_keywords_lexicon",
         lambda s, d: trends.with_keywords(articles(s, d), fv.TREND_KEYWORDS + PROBE_WORDS).select(
             "id", F.array_join(F.array_sort("keywords"), "|").alias("keywords")), "t1_keywords")
register("t2_top_keywords_lexicon", lambda s, d: trends.top_keywords(articles(s, d), AS_OF), "t2_top_keywords")
register("t3_distinct_keywords_lexicon", lambda s, d: trends.distinct_keywords(articles(s, d), AS_OF), "t3_distinct_keywords")
register("t4_daily_keywords_lexicon", lambda s, d: trends.daily_keywords(articles(s, d), AS_OF), "t4_daily_keywords")
register("t5_author_stats_lexicon", lambda s, d: trends.author_stats(_pairs(s, d)).drop("first_id"), "t5_author_stats")
register("t6_author_report_lexicon", lambda s, d: trends.author_report(articles(s, d), AS_OF), "t6_author_report")
register("t8_author_top_keywords_lexicon", lambda s, d: trends.author_top_keywords(_pairs(s, d)), "t8_author_top_keywords")
register("t15_trend_summary_lexicon", lambda s, d: trends.trend_summary(articles(s, d), AS_OF), "t15_trend_summary")


def _tagged(s, d):
    return tags.with_tags(articles(s, d))


def _recent(s, d):
    return tags.with_tags(crawled_within(articles(s, d), AS_OF, 30))


register("g1_category_hits_lexicon",
         lambda s, d: _tagged(s, d).select("id", *[F.array_join(f"hits_{c}", "|").alias(f"hits_{c}") for c in fv.TAG_LEXICON]), "g1_category_hits")
register("g3_difficulty_lexicon", lambda s, d: _tagged(s, d).select("id", "difficulty", "difficulty_confidence"), "g3_difficulty")
register("g4_content_type_lexicon", lambda s, d: _tagged(s, d).select("id", "content_type", "type_confidence"), "g4_content_type")
register("g5_main_category_lexicon",
         lambda s, d: _tagged(s, d).select("id", "main_category", F.array_join("tech_stack", "|").alias("tech_stack"),
                                           F.round("tag_confidence", 9).alias("tag_confidence")), "g5_main_category")
register("g8_tag_list_lexicon", lambda s, d: tags.tag_rows(_tagged(s, d)).select("id", "name", "category", "confidence", "frequency"), "g8_tag_list")
register("g9_tag_statistics_lexicon", lambda s, d: tags.tag_statistics(_tagged(s, d)), "g9_tag_statistics")
register("g10_recommendations_lexicon", lambda s, d: tags.recommend(articles(s, d)), "g10_recommendations")
register("g11_tag_trends_lexicon", lambda s, d: tags.tag_trends(_recent(s, d)), "g11_tag_trends")
register("g12_daily_tags_lexicon", lambda s, d: tags.daily_tags(_recent(s, d)), "g12_daily_tags")
register("g13_tag_summary_lexicon", lambda s, d: tags.tag_trend_summary(_recent(s, d)), "g13_tag_summary")


def _scored(s, d):
    return quality.with_quality(articles(s, d))


for name in [n for n in analysis_plans.ORACLES if n[:3] in ("c1_", "c2_", "c3_", "c4_", "c5_", "c6_")]:
    register(f"{name}_lexicon",
             lambda s, d, m=name[3:]: quality.with_metrics(articles(s, d), [m]).select("id", F.round(m, 9).alias(m)), name)
register("c7_overall_lexicon",
         lambda s, d: _scored(s, d).select("id", F.round("overall", 9).alias("overall"), "grade", "word_count", "reading_time"), "c7_overall")
register("c10_key_points_lexicon",
         lambda s, d: quality.with_key_points(articles(s, d)).select("id", F.array_join("key_points", "\n").alias("key_points")), "c10_key_points")
register("c11_suggestions_lexicon",
         lambda s, d: quality.with_suggestions(_scored(s, d)).select("id", F.array_join("suggestions", "|").alias("suggestions")), "c11_suggestions")
register("c12_quality_summary_lexicon", lambda s, d: rounded(quality.quality_summary(_scored(s, d))), "c12_quality_summary")
register("x2_tag_line_lexicon",
         lambda s, d: quality.with_quality(_tagged(s, d)).select("id", F.array_join(export.tag_line(), " ").alias("tags")), "x2_tag_line")
for name in ("x10_vault_tags", "x11_front_matter"):
    # The lexicons have phrases and signs, which tags of the stack leave out.
    OLD[name] = OLD[name].replace(
        "list_transform(tech_stack, lambda t: 'tech/' || t)",
        "list_transform(list_filter(list_transform(tech_stack, lambda t: lower(regexp_replace(t, '[^a-zA-Z0-9一-鿿]', '', 'g'))), lambda t: t <> ''), lambda t: 'tech/' || t)")
register("x11_front_matter_lexicon",
         lambda s, d: export.vault_tags(quality.with_quality(_tagged(s, d))).select("id", export.front_matter().alias("m")).select("id", "m.*").select(
             "id", "title", "url", "author", "account", F.array_join("tags", "|").alias("tags"), "published", "date", "quality.*"), "x11_front_matter")
register("x10_vault_tags_lexicon",
         lambda s, d: export.vault_tags(quality.with_quality(_tagged(s, d))).select("id", F.array_join("vault_tags", "|").alias("vault_tags")), "x10_vault_tags")
