"""Registered queries: exports and the queries of vault notes."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.operators import export, notes, quality, tags
from pressmill.operators.etl import structured
from pressmill.plans.analysis_plans import ADVICE, POINTS, QUALITY_CTES, QUALITY_SUMMARY_SQL, rounded, tagging_ctes
from pressmill.plans.common import AS_OF, PROBE_LEXICON, articles, day_sql, plain_articles, quote, strip_sql, with_articles
from pressmill.plans.etl_plans import SUMMARY, bare_title_sql, clean_sql, episode_sql
from pressmill.functions.text import SPACE
from pressmill.session import new_shared_path
from pressmill.sources import files

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def mapped_sql(text, mapping):
    return ("list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains({text}, {quote(k)}) THEN {quote(v)} END" for k, v in mapping.items())
            + "], lambda x: x IS NOT NULL))")


CATS = (f"cats AS (SELECT *, CASE WHEN len(cs) = 0 THEN [{quote(fv.EXPORT_DEFAULT_CATEGORY)}] ELSE cs END AS categories FROM "
        f"(SELECT *, {mapped_sql(chr(108) + chr(116), fv.EXPORT_CATEGORIES)} AS cs FROM (SELECT *, lower(title || ' ' || content) AS lt FROM articles)))")
register("x1_categories",
         lambda s, d: export.with_categories(articles(s, d)).select("id", F.array_join(F.array_sort("categories"), "|").alias("categories")),
         with_articles("SELECT id, array_to_string(list_sort(categories), '|') AS categories FROM cats", CATS))
register("x4_category_counts",
         lambda s, d: export.category_counts(export.with_categories(articles(s, d))),
         with_articles("SELECT category, count(*) AS cnt FROM (SELECT unnest(categories) AS category FROM cats) GROUP BY 1", CATS))


def _written(s, df, column):
    path = new_shared_path(s, f"by-{column}")
    export.write_partitioned(df, path, column)
    return s.read.parquet(path)


register("x7_index",
         lambda s, d: export.index_tables(articles(s, d)),
         with_articles("SELECT 'category' AS part, category AS name, count(*) AS cnt FROM (SELECT unnest(categories) AS category FROM cats) GROUP BY 2 UNION ALL "
                       "(SELECT 'author', coalesce(author, '未知作者') AS n, count(*) AS c FROM articles GROUP BY 2 ORDER BY c DESC, n LIMIT 20) UNION ALL "
                       "(SELECT 'month', coalesce(strftime(publish_time, '%Y-%m'), 'unknown') AS n, count(*) FROM articles GROUP BY 2 ORDER BY n DESC LIMIT 12)", CATS))


def list_text_sql(c):
    return strip_sql(f"regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '[{SPACE}]+', ' ', 'g')")


ENTRIES = (f"listed AS (SELECT *, {list_text_sql('content')} AS f FROM articles), entries AS (SELECT *, '[' || {list_text_sql('title')} || '](' || url || ') -- ' || "
           f"concat_ws(' | ', CASE WHEN author <> '' THEN 'by ' || author END, {day_sql('publish_time')}, nullif(CASE WHEN length(f) <= 80 THEN f "
           "WHEN length(regexp_extract(left(f, 80), '^(.*) ', 1)) > 64 THEN regexp_extract(left(f, 80), '^(.*) ', 1) || '...' ELSE left(f, 80) || '...' END, '')) AS entry FROM listed)")
register("x8_list_entries", lambda s, d: export.list_entries(articles(s, d)).select("id", "entry"),
         with_articles("SELECT id, entry FROM entries", ENTRIES))
for by, key in (("author", "coalesce(author, 'Unknown')"), ("date", "coalesce(strftime(publish_time, '%Y-%m'), 'Unknown')"), ("account", "account_name")):
    register(f"x9_grouped_by_{by}",
             lambda s, d, b=by: export.grouped_entries(articles(s, d), b),
             with_articles(f"SELECT \"group\", no, no::VARCHAR || '. ' || entry AS line FROM (SELECT *, {key} AS \"group\", "
                           f"row_number() OVER (PARTITION BY {key} ORDER BY publish_time DESC NULLS LAST, id) AS no FROM entries)", ENTRIES))


# ------------------------------------------------------------------ analysed articles

def analysed(s, d):
    return export.analysed(articles(s, d))


def noted_rows(rows):
    """Articles with tagging, quality and vault tags."""
    return export.vault_tags(quality.with_quality(tags.with_tags(rows, PROBE_LEXICON)))


def noted(s, d):
    return noted_rows(articles(s, d))


JOINED = "noted AS (SELECT t.*, s.overall, s.grade, s.word_count, s.reading_time FROM tagged t JOIN scored s USING (id))"
NOTE_CTES = [
    *tagging_ctes(PROBE_LEXICON), *QUALITY_CTES, JOINED,
    f"tagsets AS (SELECT *, list_sort(list_distinct(list_filter(list_concat(list_concat({mapped_sql('lt', fv.VAULT_TAGS)}, ["
    "CASE WHEN author <> '' THEN 'author/' || author END, CASE WHEN account_name <> '' THEN 'account/' || account_name END, strftime(publish_time, 'year/%Y'), "
    "strftime(publish_time, 'month/%Y-%m'), 'difficulty/' || difficulty, 'category/' || main_category, 'quality/' || grade, "
    "CASE WHEN word_count < 500 THEN 'length/short' WHEN word_count < 1500 THEN 'length/medium' ELSE 'length/long' END]), "
    "list_transform(tech_stack, lambda t: 'tech/' || t)), lambda x: x IS NOT NULL))) AS vault_tags FROM noted)",
]
register("x2_tag_line",
         lambda s, d: quality.with_quality(tags.with_tags(articles(s, d), PROBE_LEXICON)).select("id", F.array_join(export.tag_line(), " ").alias("tags")),
         with_articles("SELECT id, array_to_string(list_concat(list_transform(tech_stack, lambda t: '#' || t), ['#难度_' || difficulty, '#' || content_type, '#质量等级_' || grade, "
                       "CASE WHEN word_count < 500 THEN '#短文' WHEN word_count < 1500 THEN '#中文' ELSE '#长文' END]), ' ') AS tags FROM noted", *NOTE_CTES[:-1]))
NL = "chr(10)"


def _score(c):
    return f"printf('%.2f', {c})"


def _bullets(heading, items):
    return f"CASE WHEN len({items}) > 0 THEN '#### {heading}' || {NL} || {NL} || '- ' || array_to_string({items}, {NL} || '- ') || {NL} || {NL} ELSE '' END"


TAG_LINE = ("array_to_string(list_concat(list_transform(tech_stack, lambda t: '#' || t), ['#难度_' || difficulty, '#' || content_type, '#质量等级_' || grade, "
            "CASE WHEN word_count < 500 THEN '#短文' WHEN word_count < 1500 THEN '#中文' ELSE '#长文' END]), ' ')")
DOCUMENT_SQL = " || ".join([
    f"'# ' || title || {NL} || {NL} || '## 元信息' || {NL} || {NL} || '- **作者**: ' || coalesce(author, '未知作者') || {NL} || '- **发布账号**: ' || account_name || {NL}",
    f"'- **发布时间**: ' || coalesce(strftime(publish_time, '%Y-%m-%d %H:%M:%S'), '') || {NL} || '- **原文链接**: [' || url || '](' || url || ')' || {NL}",
    f"'- **标签**: ' || {TAG_LINE} || {NL} || {NL} || '---' || {NL} || {NL} || '## 正文' || {NL} || {NL} || content || {NL} || {NL} || '---' || {NL} || {NL}",
    f"'## 文章分析' || {NL} || {NL} || '### 质量评估' || {NL} || {NL} || '- **总体评分**: ' || {_score('overall')} || '/1.00' || {NL} || '- **质量等级**: ' || grade || {NL}",
    f"'- **字数**: ' || word_count::VARCHAR || {NL} || '- **预计阅读时间**: ' || reading_time::VARCHAR || ' 分钟' || {NL} || {NL} || '#### 详细指标' || {NL} || {NL}",
    f"'| 指标 | 分数 |' || {NL} || '|------|------|' || {NL}",
    *[f"'| {label} | ' || {_score(c)} || ' |' || {NL}" for label, c in [
        ("原创性", "originality"), ("技术深度", "technical_depth"), ("可读性", "readability"), ("结构化", "structure"), ("参与度", "engagement"), ("完整性", "completeness")]],
    NL, _bullets("文章要点", "points"), _bullets("改进建议", "advice")])
DOCUMENT_CTES = [
    *tagging_ctes(fv.TAG_LEXICON), *QUALITY_CTES,
    "noted AS (SELECT t.*, s.* EXCLUDE (id, url, title, content, author, account_name, publish_time, crawl_time, lt) FROM tagged t JOIN scored s USING (id))",
    f"documented AS (SELECT *, {POINTS} AS points, {ADVICE} AS advice, row_number() OVER (ORDER BY publish_time DESC NULLS LAST, id) AS no FROM noted)",
]
PLAIN_NAME = "coalesce(nullif(left(" + strip_sql("regexp_replace(title, " + quote('[<>:"/\\\\|?*]') + ", '', 'g')") + ", 100), ''), 'untitled')"
register("x3_documents",
         lambda s, d: export.with_documents(export.with_row_numbers(articles(s, d)).transform(export.analysed)).select("no", "file_name", "markdown"),
         with_articles(f"SELECT no, printf('%04d_%s.md', no, {PLAIN_NAME}) AS file_name, {DOCUMENT_SQL} AS markdown FROM documented", *DOCUMENT_CTES))


def _documents(s, d):
    return export.with_documents(export.with_row_numbers(articles(s, d)).transform(export.analysed))


def _folders(s, rows, column):
    """Write documents into folders by a column and measure each folder."""
    return (_written(s, rows.select("file_name", "markdown", column), column)
            .groupBy(F.col(column).cast("string").alias(column))
            .agg(F.count("*").alias("cnt"), F.sum(F.length("markdown")).alias("chars"), F.min("file_name").alias("first_file")))


def folder_sql(key, source):
    return with_articles(
        f"SELECT {key}, count(*) AS cnt, sum(length(markdown))::BIGINT AS chars, min(file_name) AS first_file FROM (SELECT {source}, "
        f"printf('%04d_%s.md', no, {PLAIN_NAME}) AS file_name, {DOCUMENT_SQL} AS markdown FROM documented) GROUP BY 1", *DOCUMENT_CTES)


register("x4_write_by_category",
         lambda s, d: _folders(s, export.by_category(export.with_categories(_documents(s, d)).select("file_name", "markdown", "categories")), "category"),
         folder_sql("replace(category, '/', '_') AS category",
                                     f"unnest(CASE WHEN len({mapped_sql('lt', fv.EXPORT_CATEGORIES)}) = 0 THEN [{quote(fv.EXPORT_DEFAULT_CATEGORY)}] "
                                     f"ELSE {mapped_sql('lt', fv.EXPORT_CATEGORIES)} END) AS category"))
register("x5_write_by_month",
         lambda s, d: _folders(s, _documents(s, d).withColumn("bucket", export.month_bucket()), "bucket"),
         folder_sql("coalesce(strftime(publish_time, '%Y-%m'), 'unknown') AS bucket", "publish_time"))
register("x6_write_by_author",
         lambda s, d: _folders(s, _documents(s, d).withColumn("folder", export.author_folder()), "folder"),
         folder_sql("coalesce(author, '未知作者') AS folder", "author"))


def _files(s, rows, text, folder=None):
    """Write one file per row and read the files back."""
    path = new_shared_path(s, "files")
    files.write_files(rows, path, text, folder=folder)
    return files.read_files(s, path)


register("x4_category_files",
         lambda s, d: _files(s, export.by_category(export.with_categories(_documents(s, d)).select("file_name", "markdown", "categories")), "markdown", "category")
         .select(F.col("folder").alias("category"), "file_name", F.col("text").alias("markdown")),
         with_articles(f"SELECT replace(unnest(CASE WHEN len({mapped_sql('lt', fv.EXPORT_CATEGORIES)}) = 0 THEN [{quote(fv.EXPORT_DEFAULT_CATEGORY)}] "
                       f"ELSE {mapped_sql('lt', fv.EXPORT_CATEGORIES)} END), '/', '_') AS category, printf('%04d_%s.md', no, {PLAIN_NAME}) AS file_name, {DOCUMENT_SQL} AS markdown FROM documented", *DOCUMENT_CTES))
register("x10_vault_tags",
         lambda s, d: noted(s, d).select("id", F.array_join("vault_tags", "|").alias("vault_tags")),
         with_articles("SELECT id, array_to_string(vault_tags, '|') AS vault_tags FROM tagsets", *NOTE_CTES))
register("x11_front_matter",
         lambda s, d: noted(s, d).select("id", export.front_matter().alias("m")).select("id", "m.*").select(
             "id", "title", "url", "author", "account", F.array_join("tags", "|").alias("tags"), "published", "date", "quality.*"),
         with_articles("SELECT id, title, url, author, account_name AS account, array_to_string(vault_tags, '|') AS tags, strftime(publish_time, '%Y-%m-%dT%H:%M:%S') AS published, "
                       "strftime(publish_time, '%Y-%m-%d') AS date, grade, printf('%.2f', overall)::DOUBLE AS score, word_count, reading_time FROM tagsets", *NOTE_CTES))
register("x12_wikilinks", lambda s, d: export.wikilink_edges(noted(s, d)),
         with_articles("SELECT id AS src, 'Authors/' || author AS dst, 'Authors' AS kind FROM tagsets WHERE author <> '' UNION ALL "
                       "SELECT id, 'Accounts/' || account_name, 'Accounts' FROM tagsets WHERE account_name <> '' UNION ALL "
                       "SELECT id, 'Tags/' || replace(unnest(vault_tags[1:10]), '/', '-'), 'Tags' FROM tagsets", *NOTE_CTES))
VAULT_NAME = "coalesce(nullif(left(" + strip_sql("regexp_replace(title, " + quote('[<>:"/\\\\|?*\\[\\]]') + ", '', 'g')") + ", 100), ''), 'untitled')"
NOTE_SQL = " || ".join([
    f"'---' || {NL} || 'title: ' || title || {NL} || 'url: ' || url || {NL}", f"coalesce('author: ' || author || {NL}, '')",
    f"'account: ' || account_name || {NL} || 'tags:' || {NL}", f"array_to_string(list_transform(vault_tags, lambda t: '  - ' || t || {NL}), '')",
    f"coalesce('published: ' || strftime(publish_time, '%Y-%m-%dT%H:%M:%S') || {NL} || 'date: ' || strftime(publish_time, '%Y-%m-%d') || {NL}, '')",
    f"'quality:' || {NL} || '  grade: ' || grade || {NL} || '  score: ' || printf('%.2f', overall)::DOUBLE::VARCHAR || {NL}",
    f"'  word_count: ' || word_count::VARCHAR || {NL} || '  reading_time: ' || reading_time::VARCHAR || {NL} || '---' || {NL} || {NL}",
    f"'# ' || title || {NL} || {NL} || '## 📝 摘要' || {NL} || {NL} || left(content, 200) || '...' || {NL} || {NL} || '## 🔗 链接' || {NL} || {NL}",
    f"'- **原文**: [' || url || '](' || url || ')' || {NL} || '- **作者**: [[Authors/' || coalesce(author, 'untitled') || ']]' || {NL}",
    f"'- **来源**: [[Accounts/' || account_name || ']]' || {NL} || {NL} || '## 🏷️ 标签' || {NL} || {NL}",
    f"array_to_string(list_transform(vault_tags, lambda t: '#' || t), ' ') || {NL}"])
register("x13_vault_notes", lambda s, d: export.vault_notes(
    noted_rows(export.with_row_numbers(articles(s, d)))),
    with_articles(f"SELECT id, printf('%04d_%s.md', row_number() OVER (ORDER BY publish_time DESC NULLS LAST, id), {VAULT_NAME}) AS file_name, {NOTE_SQL} AS note FROM tagsets", *NOTE_CTES))
register("x14_author_grades", lambda s, d: export.author_grades(quality.with_quality(articles(s, d))),
         with_articles("SELECT author, count(*) AS total_articles, " + ", ".join(f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in "ABCD")
                       + " FROM scored WHERE author IS NOT NULL AND author NOT IN ('', 'Unknown') GROUP BY 1", *QUALITY_CTES))


DUMP_CTES = [
    f"cleaned AS (SELECT *, strftime(publish_time, '%Y-%m-%d') AS day, {clean_sql('content')} AS full_content FROM articles)", SUMMARY]
DUMP_FIELDS = f"id, {episode_sql('title')} AS episode, {bare_title_sql('title')} AS title, author, url, coalesce(day, '') AS time, introduce"


def _dump_roundtrip(s, d, fmt, simplified=False):
    """Write structured articles and read every field back."""
    path = new_shared_path(s, f"dump-{fmt}")
    export.write_dump(structured(articles(s, d)), path, fmt, simplified)
    fields = ["episode", "title", "author", "url", "time", "introduce", "full_content"]
    if fmt == "csv":
        flat = s.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option(
            "emptyValue", "").csv(path, schema="id long, " + ", ".join(f"{f} string" for f in fields))
        # A null and an empty field look alike in CSV.
        return flat.select("id", *[F.coalesce(f, F.lit("")).alias(f) for f in fields])
    nested = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
    return s.read.json(path, schema=f"id long, attributes {nested}").select("id", "attributes.*")


register("x15_json_dump", lambda s, d: _dump_roundtrip(s, d, "json", True),
         with_articles(f"SELECT {DUMP_FIELDS}, NULL::VARCHAR AS full_content FROM summed", *DUMP_CTES))
register("x15_json_full", lambda s, d: _dump_roundtrip(s, d, "json"),
         with_articles(f"SELECT {DUMP_FIELDS}, full_content FROM summed", *DUMP_CTES))
register("x15_csv_dump", lambda s, d: _dump_roundtrip(s, d, "csv"),
         with_articles(f"SELECT {DUMP_FIELDS.replace('author, url', 'coalesce(author, chr(0)[1:0]) AS author, url')}, full_content FROM summed", *DUMP_CTES))
register("x15_export_info", lambda s, d: export.export_info(plain_articles(s, d), AS_OF),
         f"SELECT count(*) AS total, {quote(AS_OF)} AS export_time, 'all' AS account FROM documents")
register("x15_text_blocks", lambda s, d: export.text_blocks(export.with_row_numbers(articles(s, d))),
         with_articles(
             f"SELECT no, 'Article ' || no::VARCHAR || {NL} || 'Title: ' || title || {NL} || 'Author: ' || coalesce(author, 'Unknown') || {NL} || 'Account: ' || account_name || {NL} || "
             f"'Published: ' || coalesce(strftime(publish_time, '%Y-%m-%d %H:%M:%S'), 'Unknown') || {NL} || 'URL: ' || url || {NL} || repeat('-', 40) || {NL} || full_content || {NL} || {NL} || "
             f"repeat('=', 80) || {NL} AS value FROM (SELECT *, row_number() OVER (ORDER BY publish_time DESC NULLS LAST, id) AS no FROM cleaned)", *DUMP_CTES[:1]))


def _report(s, d):
    """Save the quality summary as JSON and read it back."""
    path = new_shared_path(s, "report")
    summary = rounded(quality.quality_summary(quality.with_quality(articles(s, d))))
    export.write_report(summary, path)
    return s.read.schema(summary.schema).json(path)


register("x16_report", _report, QUALITY_SUMMARY_SQL)

# ------------------------------------------------------------------ note queries

NEWEST = "publish_time DESC NULLS LAST, id DESC"


def light(s, d):
    return plain_articles(s, d)


register("d1_related_author", lambda s, d: notes.related_by_author(light(s, d)),
         with_articles(f"SELECT id, rank, related_id FROM (SELECT a.id, b.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY b.publish_time DESC NULLS LAST, b.id DESC) AS rank "
                       "FROM articles a JOIN articles b ON a.author = b.author AND a.id <> b.id) WHERE rank <= 5"))
register("d2_related_tag", lambda s, d: notes.related_by_first_tag(noted(s, d).select("id", "publish_time", "vault_tags")),
         with_articles("SELECT id, rank, related_id FROM (SELECT a.id, b.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY b.publish_time DESC NULLS LAST, b.id DESC) AS rank "
                       "FROM tagsets a JOIN tagsets b ON len(list_filter(b.vault_tags, lambda t: contains(t, coalesce(a.vault_tags[1], 'none')))) > 0 AND a.id <> b.id) WHERE rank <= 5", *NOTE_CTES))
register("d3_author_rows", lambda s, d: notes.author_rows(light(s, d)),
         with_articles("SELECT author, count(*) AS cnt FROM articles GROUP BY 1 ORDER BY cnt DESC, author NULLS LAST LIMIT 10"))
register("d4_list_by_author", lambda s, d: notes.list_by_author(articles(s, d)), with_articles("SELECT author, id, title FROM articles"))
register("d5_tag_counts", lambda s, d: notes.tag_counts(noted(s, d)),
         with_articles("SELECT tag, count(*) AS cnt FROM (SELECT unnest(vault_tags) AS tag FROM tagsets) GROUP BY 1", *NOTE_CTES))
register("d6_calendar", lambda s, d: notes.calendar(light(s, d)),
         with_articles(f"SELECT {day_sql('publish_time')} AS day, count(*) AS cnt FROM articles WHERE publish_time IS NOT NULL GROUP BY 1"))
register("d6_last_30_days", lambda s, d: notes.calendar(light(s, d), AS_OF, 30),
         with_articles(f"SELECT {day_sql('publish_time')} AS day, count(*) AS cnt FROM articles WHERE publish_time >= TIMESTAMP '2024-01-02' GROUP BY 1"))
register("d7_latest", lambda s, d: notes.latest(articles(s, d), score=quality.with_quality),
         with_articles(f"SELECT id, title, author, publish_time, grade FROM scored ORDER BY {NEWEST} LIMIT 20", *QUALITY_CTES))
register("d8_best", lambda s, d: notes.best(quality.with_quality(articles(s, d)), "C").select("id", "title", "author", "publish_time", F.round("overall", 9).alias("overall"), "grade"),
         with_articles("SELECT id, title, author, publish_time, round(overall, 9) AS overall, grade FROM scored WHERE grade = 'C' ORDER BY scored.overall DESC, id DESC LIMIT 10", *QUALITY_CTES))
register("d9_tech_tags", lambda s, d: notes.tag_counts(noted(s, d), containing="tech/"),
         with_articles("SELECT tag, count(*) AS cnt FROM (SELECT unnest(vault_tags) AS tag FROM tagsets) WHERE contains(tag, 'tech/') GROUP BY 1", *NOTE_CTES))
register("d9_with_language_tag", lambda s, d: notes.with_tag(noted(s, d), "lang/"),
         with_articles("SELECT id, unnest(vault_tags) AS tag FROM tagsets WHERE len(list_filter(vault_tags, lambda t: contains(t, 'lang/'))) > 0", *NOTE_CTES))
register("d10_of_author", lambda s, d: notes.of_author(quality.with_quality(articles(s, d)), "src3").withColumn("overall", F.round("overall", 9)),
         with_articles(f"SELECT id, {day_sql('publish_time')} AS day, grade, round(overall, 9) AS overall FROM scored WHERE author = 'src3'", *QUALITY_CTES))
register("d10_author_tags", lambda s, d: notes.author_tags(noted(s, d)),
         with_articles("SELECT author, tag, cnt, rank FROM (SELECT author, tag, count(*) AS cnt, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, tag) AS rank "
                       "FROM (SELECT author, unnest(vault_tags) AS tag FROM tagsets) GROUP BY 1, 2) WHERE rank <= 10", *NOTE_CTES))
