"""Registered queries: raw pages, links and series."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions import urls
from pressmill.functions.text import SPACE
from pressmill.operators import html, links
from pressmill.plans import dump_view as dv
from pressmill.plans.common import quote, strip_sql
from pressmill.sources.articles import dealt
from pressmill.sources.pages import read_pages

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def pages(s, d):
    return dealt(read_pages(s, d), "page_id")


# Pages of the given table dressed as article pages: named elements, a nested container,
# images and script variables around the page's own text.  One SQL text for both engines.
P = "CAST(page_id AS STRING)"
DRESSED = f"""page_id, url, replace(replace(replace(html,
 '<article>', '<span id="js_author_name">作者： Ann ' || {P} || '</span><span class="big profile_nickname">Daily <b>' || {P} || '</b></span><em id="publish_time">2024-01-'
   || CAST(page_id % 28 + 1 AS STRING) || '</em><div id="js_content"><div><img data-src="/img/' || {P} || '.png" src="x.gif"></div>'),
 '</article>', '<img src="https://cdn.example.com/b.png"><img src="/img/' || {P} || '.png"></div>'),
 '<h1>', CASE WHEN page_id % 5 = 0 THEN '<h1>' ELSE '<h1 id="activity-name">' END)
 || CASE WHEN page_id % 4 = 0 THEN '<script>var msg_title = "Script ' || {P} || '"; var publish_time = "1704103200"; var msg_cdn_url = "https://cdn/c.png";</script>' ELSE '' END AS html"""
DRESSED_SQL = f"dressed AS (SELECT {DRESSED} FROM pages)"


def dressed(s, d):
    return pages(s, d).selectExpr(*_split_columns(DRESSED))


def _split_columns(text):
    head, rest = text.split(", url, ", 1)
    return [head, "url", rest]


def unescape_sql(c):
    return f"replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"


H1 = "regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)"
PLAIN_H1 = strip_sql(unescape_sql(f"regexp_replace({H1}, '[{SPACE}]*<[^>]*>[{SPACE}]*', '', 'g')"))
ARTICLE_TEXT = ("array_to_string(list_filter(list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>'), "
                f"lambda x: {strip_sql(unescape_sql('x'))}), lambda x: x <> ''), chr(10))")

register("s6_pages", lambda s, d: read_pages(s, d), "SELECT page_id, url, html FROM pages")
register("h1_title",
         lambda s, d: html.with_script_fields(pages(s, d)).select("page_id", html.page_title(fv.TITLE_SELECTORS + ["h1"]).alias("title")),
         f"SELECT page_id, {PLAIN_H1} AS title FROM pages")
register("h2_text",
         lambda s, d: html.with_container(pages(s, d), fv.CONTENT_SELECTORS + ["article"]).select("page_id", "text"),
         f"SELECT page_id, {ARTICLE_TEXT} AS text FROM pages")


def _parsed(s, d):
    return html.extract_articles(dressed(s, d))


KEPT = "page_id % 4 = 0 OR page_id % 5 <> 0"
register("h3_author", lambda s, d: _parsed(s, d).select("page_id", "author"),
         f"SELECT page_id, 'Ann ' || page_id::VARCHAR AS author FROM pages WHERE {KEPT}")
register("h4_account", lambda s, d: _parsed(s, d).select("page_id", "account_name"),
         f"SELECT page_id, 'Daily' || page_id::VARCHAR AS account_name FROM pages WHERE {KEPT}")
register("h5_publish_time", lambda s, d: _parsed(s, d).select("page_id", "publish_time"),
         "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN TIMESTAMP '2024-01-01 10:00:00' ELSE TIMESTAMP '2024-01-01' + to_days((page_id % 28)::INT) END "
         f"AS publish_time FROM pages WHERE {KEPT}")
SITE = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
register("h6_images", lambda s, d: _parsed(s, d).select("page_id", F.array_join("images", "|").alias("images")),
         f"SELECT page_id, {SITE} || '/img/' || page_id::VARCHAR || '.png|https://cdn.example.com/b.png' AS images FROM pages WHERE {KEPT}")
register("h7_cover", lambda s, d: _parsed(s, d).select("page_id", "cover_image"),
         f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://cdn/c.png' ELSE {SITE} || '/img/' || page_id::VARCHAR || '.png' END AS cover_image FROM pages WHERE {KEPT}")
register("h8_kept_pages", lambda s, d: _parsed(s, d).select("page_id", "title", F.length("content").alias("content_length")),
         f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Script ' || page_id::VARCHAR ELSE {PLAIN_H1} END AS title, length({ARTICLE_TEXT}) AS content_length FROM pages WHERE {KEPT}")
register("h9_blocked", lambda s, d: pages(s, d).select("page_id", html.is_blocked().alias("blocked")),
         "SELECT page_id, NOT regexp_matches(html, 'id=\"js_content\"|rich_media_content|data-role=\"content\"|class=\"content\"') AND "
         "regexp_matches(lower(html), '验证码|captcha|blocked|forbidden') AS blocked FROM pages")
register("h10_script_fields",
         lambda s, d: html.with_script_fields(dressed(s, d)).select("page_id", "js.title", "js.publish_time", "js.cdn_url", "js.nickname"),
         "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Script ' || page_id::VARCHAR END AS title, CASE WHEN page_id % 4 = 0 THEN '1704103200' END AS publish_time, "
         "CASE WHEN page_id % 4 = 0 THEN 'https://cdn/c.png' END AS cdn_url, NULL::VARCHAR AS nickname FROM pages")

# ------------------------------------------------------------------ links

A = quote('(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["\'][^"\']*["\'][^>]*>.*?</a>')
LINKS = (f"links AS (SELECT page_id, pos, {unescape_sql(f'regexp_extract(a, {quote(chr(104) + 'ref=' + chr(34) + '([^' + chr(34) + ']*)')}, 1)')} AS url, "
         f"{unescape_sql(f'regexp_replace(a, {quote('<[^>]*>')}, {quote('')}, {quote('g')})')} AS title FROM (SELECT page_id, generate_subscripts(xs, 1) - 1 AS pos, unnest(xs) AS a "
         f"FROM (SELECT page_id, regexp_extract_all(html, {A}) AS xs FROM pages)))")
register("l1_anchors", lambda s, d: links.content_links(pages(s, d), keep=None).drop("list"),
         f"WITH {LINKS} SELECT page_id, pos, url, title, 'content_link' AS source FROM links")
# Every third page's anchors lead to articles; some of these the rule refuses.
LINKED = """replace(html, '<a href="/', CASE page_id % 3 WHEN 0 THEN '<a href="https://mp.weixin.qq.com/s/' WHEN 1 THEN '<a href="https://mp.weixin.qq.com/s?scene=1&amp;x=' ELSE '<a href="/' END)"""
KEPT_LINKS = (f"kept_links AS (SELECT page_id, pos, url, title FROM ({LINKS.split(' AS ', 1)[1].replace('FROM pages)', f'FROM (SELECT page_id, {LINKED} AS html FROM pages))')[1:-1]}) "
              "WHERE contains(url, 'mp.weixin.qq.com') AND (contains(url, '/s/') OR contains(url, '/s?')) AND NOT regexp_matches(url, 'action=profile|action=follow|scene=|__biz=|tempkey='))")


def _linked(s, d):
    return pages(s, d).select("page_id", F.expr(LINKED).alias("html"))


register("l1_content_links", lambda s, d: links.content_links(_linked(s, d)).drop("list"),
         f"WITH {KEPT_LINKS} SELECT page_id, pos, url, title, 'content_link' AS source FROM kept_links")

# Pages whose scripts list the page's own URL, under a title that looks like the list's
# end, and whose last element recommends an article.
LISTED = """html || '<script>var related_article_list = [{url: "' || url || '", title: "see [' || CAST(page_id AS STRING) || ']; more"}, {"url": "' || url || '?x"}]; var x = [1];</script>'
 || '<script>var author_articles = [{url: "' || url || '?y", title: "Y"}];</script>'
 || '<p data-role="recommend"><a href="https://example.org/">no</a><a href="https://mp.weixin.qq.com/s/' || CAST(page_id AS STRING) || '">Go <b>on</b></a></p>'"""
LISTS = ("lists AS (SELECT page_id, 0 AS list, 0 AS pos, url, 'see [' || page_id::VARCHAR || ']; more' AS title, 'js_related_articles' AS source FROM pages UNION ALL "
         "SELECT page_id, 0, 1, url || '?x', '', 'js_related_articles' FROM pages UNION ALL SELECT page_id, 1, 0, url || '?y', 'Y', 'js_author_articles' FROM pages UNION ALL "
         "SELECT page_id, 3, 0, 'https://mp.weixin.qq.com/s/' || page_id::VARCHAR, 'Go on', 'js_recommendations' FROM pages)")


def _with_lists(s, d):
    return pages(s, d).select("page_id", "url", F.expr(LISTED).alias("html"))


register("l2_script_links", lambda s, d: links.script_links(_with_lists(s, d)), f"WITH {LISTS} SELECT * FROM lists")
# The page's URL as an article link in several shapes.
SHAPED = ("page_id, CASE page_id % 6 WHEN 0 THEN 'https://mp.weixin.qq.com/s/' || substr(url, 10) WHEN 1 THEN 'https://mp.weixin.qq.com/s?x=' || url "
          "WHEN 2 THEN 'https://mp.weixin.qq.com/s/a?scene=' || CAST(page_id AS STRING) WHEN 3 THEN 'https://mp.weixin.qq.com/s/b?__biz=' || url "
          "WHEN 4 THEN 'https://mp.weixin.qq.com/x?u=/s?' || CAST(page_id AS STRING) ELSE url END AS url")
HOST = "contains(url, 'mp.weixin.qq.com')"


def _shaped(s, d):
    return pages(s, d).selectExpr("page_id", SHAPED.split("page_id, ", 1)[1])


register("l3_history_links", lambda s, d: _shaped(s, d).select("page_id", urls.is_history_link(F.col("url")).alias("ok")),
         f"SELECT page_id, {HOST} AND (contains(url, '/s/') OR contains(url, '/s?')) AND NOT regexp_matches(url, 'action=profile|action=follow|scene=|__biz=|tempkey=') AS ok "
         f"FROM (SELECT {SHAPED} FROM pages)")
register("l4_discovery_links", lambda s, d: _shaped(s, d).select("page_id", urls.is_discovery_link(F.col("url")).alias("ok")),
         f"SELECT page_id, {HOST} AND (contains(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/s/') OR contains(regexp_extract(url, '[?]([^#]*)', 1), '/s?')) "
         f"AND NOT regexp_matches(url, 'action=profile|action=follow|__biz=') AS ok FROM (SELECT {SHAPED} FROM pages)")
register("l5_first_per_url",
         lambda s, d: links.first_per_url(links.script_links(_with_lists(s, d)), links.content_links(_linked(s, d))).select("url", "title", "source", "page_id"),
         f"WITH {KEPT_LINKS}, {LISTS}, every_link AS (SELECT 0 AS rk, * FROM lists UNION ALL SELECT 1, page_id, 0, pos, url, title, 'content_link' FROM kept_links) "
         "SELECT url, title, source, page_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rk, page_id, list, pos) AS rn FROM every_link) WHERE rn = 1")
SERIES = ("series AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN head || ' #' || n WHEN 1 THEN head || ' (' || n || ')' WHEN 2 THEN head || '第' || n || '期' "
          "WHEN 3 THEN head || ' vol.' || n WHEN 4 THEN 'No ' || n ELSE head END AS title FROM (SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 40) AS head, CAST(doc_id AS STRING) AS n FROM documents))")


def _series(s, d):
    docs = dv.documents(s, d)
    docs.createOrReplaceTempView("_series_source")
    return s.sql("WITH " + SERIES.replace("FROM documents", "FROM _series_source") + " SELECT id, title FROM series")


register("l6_series",
         lambda s, d: links.with_series(_series(s, d)).select("id", "series_type", "series_name", "series_number"),
         f"WITH {SERIES}, m AS (SELECT id, title, CASE WHEN regexp_matches(title, '^.+?[{SPACE}]*#[0-9]+$') THEN 'hash_number' WHEN regexp_matches(title, '^.+?[{SPACE}]*\\([0-9]+\\)$') THEN 'parentheses_number' "
         f"WHEN regexp_matches(title, '^.+?[{SPACE}]*第[0-9]+期$') THEN 'episode_number' WHEN regexp_matches(title, '(?i)^.+?[{SPACE}]*Vol\\.?[0-9]+$') THEN 'volume_number' END AS series_type FROM series) "
         f"SELECT id, series_type, CASE WHEN series_type IS NOT NULL THEN {strip_sql('regexp_extract(title, ' + quote('(?i)^(.+?)[' + SPACE + ']*(#|[(]|第|vol[.]?)[0-9]+[)期]?$') + ', 1)')} END AS series_name, "
         "CASE WHEN series_type IS NOT NULL THEN id END AS series_number FROM m")
register("l7_series_order",
         lambda s, d: links.series_order(_series(s, d), pos="id", limit=200).select("id", "series_no"),
         f"WITH {SERIES} SELECT id, CASE WHEN id % 6 < 4 THEN id ELSE 0 END AS series_no FROM series ORDER BY series_no, id LIMIT 200")
register("l8_error_pages",
         lambda s, d: pages(s, d).select("page_id", urls.is_error_url(F.concat("url", F.lower("html"))).alias("error_url"), urls.is_error_title(F.col("html")).alias("error_title")),
         "SELECT page_id, regexp_matches(lower(url || html), 'wappoc_appmsgcaptcha|mp_profile_redirect|error|blocked|forbidden') AS error_url, "
         "html = '' OR regexp_matches(html, '环境异常|系统错误|页面不存在|网络错误|验证码|Error|Not Found') AS error_title FROM pages")
