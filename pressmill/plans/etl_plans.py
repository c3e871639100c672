"""Registered queries: dumps, cleaning, merging and importing."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill import schema
from pressmill.functions import text as tx
from pressmill.functions import urls
from pressmill.operators import etl
from pressmill.plans import dump_view as dv
from pressmill.plans.common import (
    AS_OF, articles, plain_articles, quote, strip_sql, with_articles)
from pressmill.session import new_shared_path
from pressmill.sources import dumps, large_dumps

QUERIES, ORACLES = {}, {}
SP = tx.SPACE


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def with_dump(body, *ctes):
    return "WITH " + ",\n".join([dv.DUMP_SQL, *ctes]) + "\n" + body


# ------------------------------------------------------------------ two dumps in two layouts

def _nested(s, d):
    """The derived dump in the nested layout, as text rows of at most 100 articles."""
    raw = dv.raw_dump(s, d)
    item = F.struct("id", F.struct(
        "title", "url", "author", F.left("content", F.lit(50)).alias("introduce"),
        F.col("content").alias("full_content"), "episode", "time").alias("attributes"))
    return (raw.groupBy(F.floor(F.col("id") / 100).alias("chunk"))
            .agg(F.sort_array(F.collect_list(item)).alias("articles"))
            .select(F.format_string("dump-%d.json", "chunk").alias("file"),
                    F.to_json(F.struct(F.struct(F.lit("API").alias("source")).alias("export_info"), "articles")).alias("value")))


def _flat(s, d):
    return dv.raw_dump(s, d).select(
        "id", F.lit(None).cast(schema.ATTRIBUTES).alias("attributes"), "title", "url", "author",
        F.lit(None).cast("string").alias("introduce"), F.lit(None).cast("string").alias("full_content"), "episode",
        F.lit(None).cast("string").alias("time"), "content", F.col("time").alias("publish_time"))


def _normalised(s, d):
    return dumps.normalise(_flat(s, d))


NORMALISED = ("normalised AS (SELECT id, " + ", ".join(
    f"{strip_sql(f'coalesce({c}, {chr(39) * 2})')} AS {name}" for name, c in
    [("title", "title"), ("url", "url"), ("author", "author"), ("introduce", "content"), ("episode", "episode"), ("time", "time")])
    + ", '' AS full_content FROM raw_dump)")


def _fields(df):
    return df.select("id", "title", "url", "author", "introduce", "full_content", "episode", "time")


register("s1_read_dumps",
         lambda s, d: _fields(dumps.normalise(dumps.dump_articles(dumps.parse_dumps(_nested(s, d))))),
         with_dump(f"SELECT id, title, url, author, {strip_sql('left(content, 50)')} AS introduce, introduce AS full_content, episode, time "
                   "FROM normalised JOIN raw_dump r USING (id)".replace("SELECT id, title, url, author", "SELECT id, normalised.title, normalised.url, normalised.author")
                   .replace("introduce AS full_content, episode, time", "introduce AS full_content, normalised.episode, normalised.time"), NORMALISED))
register("s1_dump_headers",
         lambda s, d: dumps.dump_headers(dumps.parse_dumps(_nested(s, d))),
         "SELECT 'dump-' || (doc_id // 100)::VARCHAR || '.json' AS file, 'API' AS source, 'Unknown' AS export_time, count(*)::INT AS article_count FROM documents GROUP BY 1")


def _dump_files(s, d):
    """Write whole dumps, one file each, and read them by pattern."""
    path = new_shared_path(s, "dump-files")
    _nested(s, d).write.partitionBy("file").text(path)
    return dumps.dump_articles(dumps.read_dump_files(s, f"{path}/*", "part-*"))


register("s1_read_dump_files", lambda s, d: _fields(dumps.normalise(_dump_files(s, d))), ORACLES["s1_read_dumps"])


def _ranged_dump_files(s, d):
    """The same files, each read by several tasks: ranges are small here, so that files of any size are cut."""
    path = new_shared_path(s, "dump-files")
    _nested(s, d).write.partitionBy("file").text(path)
    return large_dumps.read_large_dumps(s, f"{path}/*", "part-*", part_bytes=64 << 10)


register("s1_read_large_dumps", lambda s, d: _fields(dumps.normalise(_ranged_dump_files(s, d))), ORACLES["s1_read_dumps"])


def _json_lines(s, d):
    """Write the flat dump as JSON Lines to the shared folder and read it back."""
    path = new_shared_path(s, "dump")
    _flat(s, d).drop("attributes").write.json(path)
    return _fields(dumps.normalise(dumps.read_json_lines(s, path)))


register("s2_read_json_lines", _json_lines,
         with_dump("SELECT id, title, url, author, introduce, full_content, episode, time FROM normalised", NORMALISED))


def _api_pages(s, d):
    """Landed API pages of 100 items; every third item has lost its id."""
    item = F.struct(F.when(F.col("id") % 3 != 0, F.col("id")).alias("id"), F.struct(
        "title", "url", "author", F.col("content").alias("introduce"), "episode", "time").alias("attributes"))
    pages = (dv.raw_dump(s, d).groupBy(F.floor(F.col("id") / 100).alias("page_no"))
             .agg(F.sort_array(F.collect_list(F.struct("id", item.alias("item")))).alias("rows")))
    text = pages.select("page_no", F.to_json(F.struct(F.transform("rows", lambda r: r["item"]).alias("data"))).alias("value"))
    return text.select("page_no", F.from_json("value", schema.API_PAGE).getField("data").alias("data"))


register("s4_api_items",
         lambda s, d: dumps.api_items(_api_pages(s, d)).select("id", "episode", "title", "author", "url", "time", "introduce"),
         with_dump("SELECT CASE WHEN id % 3 <> 0 THEN id ELSE row_number() OVER (ORDER BY id) END AS id, episode, title, coalesce(author, '') AS author, url, time, "
                   "content AS introduce FROM raw_dump"))


def _page_files(s, d):
    """Write landed API pages as files and read them back."""
    path = new_shared_path(s, "api-pages")
    page = F.struct(F.col("data"), F.struct(F.struct(F.col("page_no").alias("page")).alias("pagination")).alias("meta"))
    _api_pages(s, d).select("page_no", F.to_json(page).alias("value")).withColumn("number", F.col("page_no")).select(
        "number", "value").write.partitionBy("number").text(path)
    return dumps.read_api_pages(s, f"{path}/*")


register("s4_read_api_pages",
         lambda s, d: dumps.api_items(_page_files(s, d)).select("id", "episode", "title", "author", "url", "time", "introduce"),
         ORACLES["s4_api_items"])
register("e8_normalise", lambda s, d: _fields(_normalised(s, d)),
         with_dump("SELECT id, title, url, author, introduce, full_content, episode, time FROM normalised", NORMALISED))

# ------------------------------------------------------------------ text


def clean_sql(c):
    phrases, layout = fv.BOILERPLATE[:-2], fv.BOILERPLATE[-2:]
    out = c
    for p in phrases + layout:
        out = f"regexp_replace({out}, {quote('(?is)' + tx.unicode_spaces(p))}, '', 'g')"
    blank_lines = quote(tx.unicode_spaces(r"\n\s*\n\s*\n"))
    return strip_sql(f"regexp_replace({out}, {blank_lines}, chr(10) || chr(10), 'g')")


def marker_sql(number):
    return ["(?i)" + tx.unicode_spaces(m.replace("{n}", number)) for m in fv.EPISODE_MARKERS]


def episode_sql(c):
    tests = " ".join(f"WHEN regexp_matches({c}, {quote(p)}) THEN '#' || regexp_extract({c}, {quote(p)}, 1)" for p in marker_sql("([0-9]+)"))
    return f"CASE {tests} ELSE '' END"


def bare_title_sql(c):
    out = c
    for p in marker_sql("[0-9]+"):
        out = strip_sql(f"regexp_replace({out}, {quote(p + f'[{SP}]*')}, '', 'g')")
    return f"CASE WHEN {episode_sql(c)} <> '' THEN {out} ELSE {c} END"


CLEANED = f"cleaned AS (SELECT *, {clean_sql('content')} AS full_content FROM raw_dump)"
SUMMARY = (f"flat AS (SELECT *, {strip_sql(f'regexp_replace(full_content, {quote(f'[{SP}]+')}, {quote(' ')}, {quote('g')})')} AS f FROM cleaned),\n"
           "cut AS (SELECT *, list_max(list_filter(range(1, 201), lambda i: contains('。！？.!?', f[i]) AND f[i] <> '')) AS last_mark FROM flat),\n"
           "summed AS (SELECT *, CASE WHEN length(f) <= 200 THEN f WHEN last_mark > 141 THEN f[1:last_mark] ELSE f[1:200] || '...' END AS introduce FROM cut)")

register("e1_clean_content",
         lambda s, d: dv.raw_dump(s, d).select("id", tx.clean_content("content").alias("full_content")),
         with_dump("SELECT id, full_content FROM cleaned", CLEANED))
register("e2_episode",
         lambda s, d: dv.raw_dump(s, d).select("id", tx.episode("title").alias("episode")),
         with_dump(f"SELECT id, {episode_sql('title')} AS episode FROM raw_dump"))
register("e3_bare_title",
         lambda s, d: dv.raw_dump(s, d).select("id", tx.title_without_episode("title").alias("title")),
         with_dump(f"SELECT id, {bare_title_sql('title')} AS title FROM raw_dump"))
register("e4_summary",
         lambda s, d: tx.with_summary(dv.raw_dump(s, d).withColumn("cleaned", tx.clean_content("content"))).select("id", "introduce"),
         with_dump("SELECT id, introduce FROM summed", CLEANED, SUMMARY))


def _structured(s, d):
    return etl.structured(dv.raw_dump(s, d).withColumn("publish_time", F.col("time")))


DATE_ONLY = ("CASE WHEN regexp_matches(split_part(time, ' ', 1), '^[0-9]{4}-[0-9]+-[0-9]+$') OR split_part(time, ' ', 1) LIKE '%年%' "
             "THEN strftime(try_strptime(split_part(time, ' ', 1), ['%Y-%m-%d', '%Y年%m月%d日']), '%Y-%m-%d') ELSE time END")
register("e5_structured",
         lambda s, d: _structured(s, d).select("id", "attributes.*"),
         with_dump(f"SELECT id, {episode_sql('title')} AS episode, {bare_title_sql('title')} AS title, author, url, {DATE_ONLY} AS time, introduce, full_content FROM summed",
                   CLEANED, SUMMARY))
register("e22_without_fields",
         lambda s, d: etl.without_fields(_structured(s, d), ["full_content", "introduce", "time"]).select("id", "attributes.*"),
         with_dump(f"SELECT id, {episode_sql('title')} AS episode, {bare_title_sql('title')} AS title, author, url FROM raw_dump"))

# ------------------------------------------------------------------ items and collections

ITEM_CTES = [
    dv.DIGEST_SQL,
    f"cleaned AS (SELECT *, {clean_sql('content')} AS full_content FROM digests)",
    f"lines AS (SELECT id, unnest(list_transform(string_split(full_content, chr(10)), lambda x: {strip_sql('x')})) AS line, "
    "generate_subscripts(string_split(full_content, chr(10)), 1) AS pos FROM cleaned)",
    f"numbered AS (SELECT *, sum(regexp_matches(line, '^[0-9]+[.、][{SP}]*[^{SP}]')::INT) OVER (PARTITION BY id ORDER BY pos) AS item_no FROM lines WHERE line <> '')",
    f"heads AS (SELECT id, item_no, min(pos) AS head_pos, regexp_replace(arg_min(line, pos), '^[0-9]+[.、][{SP}]*', '') AS head FROM numbered WHERE item_no > 0 GROUP BY 1, 2)",
    "rest AS (SELECT id, item_no, max(CASE WHEN regexp_matches(line, '^https?://') THEN pos END) AS url_pos, "
    "string_agg(line, ' ' ORDER BY pos) FILTER (NOT regexp_matches(line, '^https?://')) AS intro FROM numbered JOIN heads USING (id, item_no) WHERE pos > head_pos GROUP BY 1, 2)",
    f"""items AS (SELECT h.id, h.item_no, CASE WHEN regexp_matches(head, '(?i)^(.+?)[{SP}]+by[{SP}]+[\\p{{L}}\\p{{N}}_]+') THEN regexp_extract(head, '(?i)^(.+?)[{SP}]+by[{SP}]+([\\p{{L}}\\p{{N}}_]+)', ['t', 'a'])
 WHEN regexp_matches(head, '^(.+?)[{SP}]*[（(][\\p{{L}}\\p{{N}}_]+[）)]') THEN regexp_extract(head, '^(.+?)[{SP}]*[（(]([\\p{{L}}\\p{{N}}_]+)[）)]', ['t', 'a'])
 ELSE {{'t': head, 'a': ''}} END AS ta, coalesce((SELECT line FROM lines l WHERE l.id = h.id AND l.pos = r.url_pos), '') AS item_url, coalesce(intro, '') AS item_introduce
 FROM heads h LEFT JOIN rest r ON h.id = r.id AND h.item_no = r.item_no)""",
]
register("e6_numbered_items",
         lambda s, d: etl.numbered_items(dv.digests(s, d).withColumn("cleaned", tx.clean_content("content")))
         .filter("item_no IS NOT NULL").select("id", "item_no", "item_title", "item_author", "item_url", "item_introduce"),
         "WITH " + ",\n".join(ITEM_CTES) + f"\nSELECT id, item_no::BIGINT AS item_no, {strip_sql('ta.t')} AS item_title, ta.a AS item_author, item_url, item_introduce FROM items")
DIGEST_SUMMARY = SUMMARY.replace("FROM cleaned)", "FROM cleaned WHERE id NOT IN (SELECT id FROM items))", 1)
register("e6_digest_export",
         lambda s, d: etl.digest_export(dv.digests(s, d).withColumn("publish_time", F.col("time"))).select(
             "id", "item_no", "episode", "title", "author", "url", "time", "introduce", "full_content"),
         "WITH " + ",\n".join([*ITEM_CTES, DIGEST_SUMMARY]) +
         f"\nSELECT i.id, i.item_no::BIGINT AS item_no, {episode_sql('d.title')} AS episode, {strip_sql('ta.t')} AS title, ta.a AS author, item_url AS url, {DATE_ONLY} AS time, item_introduce AS introduce, NULL AS full_content "
         f"FROM items i JOIN digests d ON i.id = d.id UNION ALL SELECT id, 0, {episode_sql('title')}, {bare_title_sql('title')}, author, url, {DATE_ONLY}, introduce, full_content FROM summed")

URL = quote(f"https?://[^{SP}]+")


def lines_sql(x):
    return f"list_transform(string_split({x}, chr(10)), lambda l: {strip_sql('l')})"


NAMED = f"contains(l, ':') AND length({strip_sql('split_part(l, chr(58), 1)')}) < 20"
COLLECTION_CTES = [
    dv.COLLECTION_SQL,
    f"parts AS (SELECT id, title, author, url, content, regexp_extract_all(content, {URL}) AS us, string_split_regex(content, {URL}) AS gs FROM collections "
    f"WHERE contains(title, {quote(fv.COLLECTION_MARKER)}))",
    "blocks AS (SELECT id, author, generate_subscripts(us, 1) AS i, unnest(us) AS u, gs FROM parts)",
    f"ab AS (SELECT id, author, i, u, {lines_sql('gs[i]')} AS above, list_filter(({lines_sql('gs[i + 1]')})[2:], lambda l: l <> '') AS below FROM blocks)",
    f"named AS (SELECT *, CASE WHEN above[-1] <> '' THEN above[-1] ELSE coalesce(list_filter(above[:-2], lambda l: l <> '' AND length(l) < 200)[-1], '') END AS t0, "
    f"coalesce({strip_sql(f'split_part(list_filter(below, lambda l: {NAMED})[-1], chr(58), 1)')}, '') AS a, "
    f"list_filter(list_transform(below, lambda l: CASE WHEN {NAMED} THEN {strip_sql('substr(l, position(chr(58) IN l) + 1)')} ELSE l END), lambda l: l <> '') AS body FROM ab)",
    "subs AS (SELECT *, CASE WHEN t0 = '' AND len(body) > 0 AND length(body[1]) < 150 THEN body[1] ELSE t0 END AS t, "
    "array_to_string(CASE WHEN t0 = '' AND len(body) > 0 AND length(body[1]) < 150 THEN body[2:] ELSE body END, chr(10)) AS c FROM named)",
]
register("e7_split_collections",
         lambda s, d: etl.split_collections(dv.collections(s, d), "content").select("id", "split", "sub_title", "sub_url", "sub_content", "sub_author"),
         "WITH " + ",\n".join(COLLECTION_CTES) +
         f"\nSELECT id, true AS split, t AS sub_title, u AS sub_url, {strip_sql('c')} AS sub_content, CASE WHEN a = '' THEN author ELSE a END AS sub_author FROM subs WHERE t <> '' "
         f"UNION ALL SELECT id, false, {strip_sql('title')}, {strip_sql('url')}, {strip_sql('content')}, CASE WHEN {strip_sql('author')} = '' THEN author ELSE {strip_sql('author')} END "
         "FROM collections WHERE id NOT IN (SELECT id FROM subs WHERE t <> '')")

# ------------------------------------------------------------------ urls, validity, times


def fixed_url_ctes(source, c="url", out="fixed"):
    """Repair in seven steps, each a CTE over the one before."""
    scheme = "(u LIKE 'http://%' OR u LIKE 'https://%')"
    return [
        f"fu1 AS (SELECT *, {strip_sql(f'coalesce({c}, {chr(39) * 2})')} AS u FROM {source})",
        f"fu2 AS (SELECT * REPLACE (CASE WHEN contains(u, ' ') THEN coalesce(list_filter(string_split_regex(u, '[{SP}]+'), lambda x: x LIKE 'http://%' OR x LIKE 'https://%')[1], u) ELSE u END AS u) FROM fu1)",
        "fu3 AS (SELECT * REPLACE (CASE WHEN contains(u, '：http') THEN 'http' || string_split(u, '：http')[2] WHEN contains(u, ':http') THEN 'http' || string_split(u, ':http')[2] ELSE u END AS u) FROM fu2)",
        "fu4 AS (SELECT * REPLACE (replace(replace(replace(u, 'hu.baittps://', 'https://'), 'htps://', 'https://'), 'htp://', 'http://') AS u) FROM fu3)",
        f"fu5 AS (SELECT * REPLACE (CASE WHEN NOT {scheme} AND u NOT LIKE 'ftp://%' AND contains(u, '.') AND u NOT LIKE '/%' THEN 'https://' || u ELSE u END AS u) FROM fu4)",
        f"fu6 AS (SELECT * REPLACE (regexp_replace(u, '[{SP}]+$', '') AS u) FROM fu5)",
        f"fixed_urls AS (SELECT * EXCLUDE (u), CASE WHEN {scheme} AND regexp_matches(u, '[{SP}一-鿿]') THEN regexp_extract(u, 'https?://[^{SP}一-鿿]+') ELSE u END AS {out} FROM fu6)",
    ]


register("e9_fix_url",
         lambda s, d: dv.raw_dump(s, d).select("id", urls.fixed_url(F.col("url")).alias("url")),
         with_dump("SELECT id, fixed AS url FROM fixed_urls", *fixed_url_ctes("raw_dump")))


def _processed(s, d):
    both = etl.union_dumps(_normalised(s, d), _normalised(s, d).withColumn("url", F.replace("url", F.lit("example.com/a"), F.lit("example.com"))))
    return etl.process_dump(both, AS_OF, smart_split=False)


PROCESSED = [
    NORMALISED,
    "both_dumps AS (SELECT *, 0 AS file_no FROM normalised UNION ALL SELECT * REPLACE (replace(url, 'example.com/a', 'example.com') AS url), 1 FROM normalised)",
    *fixed_url_ctes("both_dumps", out="sub_url"),
    "processed AS (SELECT *, NOT (length(title) >= 2 AND (sub_url LIKE 'http://%' OR sub_url LIKE 'https://%')) AS bad, time = '' AS time_filled FROM fixed_urls)",
    f"usable AS (SELECT id, file_no, title, sub_url AS url, author, episode, introduce AS full_content, CASE WHEN time = '' THEN {quote(AS_OF)} ELSE time END AS time FROM processed WHERE NOT bad)",
]
register("e10_usable_rows",
         lambda s, d: etl.merged_layout(_processed(s, d)).select("id", "file_no", "title", "url", "author", "episode", "full_content", "time"),
         with_dump("SELECT id, file_no, title, url, author, episode, full_content, time FROM usable", *PROCESSED))
register("e12_parse_date",
         lambda s, d: dv.raw_dump(s, d).select("id", etl.parsed_time(F.col("time"), AS_OF).alias("publish_time")),
         with_dump("SELECT id, coalesce(try_strptime(time, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%Y年%m月%d日']), "
                   f"TIMESTAMP {quote(AS_OF)}) AS publish_time FROM raw_dump"))

# ------------------------------------------------------------------ dedup, numbering, statistics

ORDER = ["file_no", "id"]
KEY_SQL = {
    "url": "nullif(url, '')", "title": "nullif(title, '')", "episode": "nullif(episode, '')",
    "title_author": "CASE WHEN title <> '' AND author <> '' THEN title || '_' || author END",
    "url_title": "CASE WHEN url <> '' AND title <> '' THEN url || '_' || title END",
}


def deduped_cte(strategy):
    return ("deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce("
            f"{KEY_SQL[strategy]}, nullif(url, ''), nullif(title, '')) ORDER BY file_no, id) AS rn FROM usable) WHERE rn = 1)")


for strategy in etl.STRATEGIES:
    register(f"e13_dedup_{strategy}",
             lambda s, d, x=strategy: etl.dedup(etl.merged_layout(_processed(s, d)), x, ORDER).select("id", "file_no", "url", "title"),
             with_dump("SELECT id, file_no, url, title FROM deduped", *PROCESSED, deduped_cte(strategy)))
register("e14_renumber",
         lambda s, d: etl.renumber(etl.dedup(etl.merged_layout(_processed(s, d)), "url", ORDER).select("id", "file_no", "url"), [F.col("file_no")])
         .select("new_id", "id", "file_no", "url"),
         with_dump("SELECT row_number() OVER (ORDER BY id DESC, file_no) AS new_id, id, file_no, url FROM deduped", *PROCESSED, deduped_cte("url")))
register("e15_merge_statistics",
         lambda s, d: etl.merge_statistics(_processed(s, d)),
         with_dump("SELECT (SELECT count(*) FROM usable) AS processed_total, count(*) AS merged_total, (SELECT count(*) FROM usable) - count(*) AS duplicates_removed, 0 AS articles_split, "
                   "(SELECT count(*) FROM processed WHERE bad) AS bad_data_filtered, (SELECT count(*) FROM processed WHERE NOT bad AND time_filled) AS time_fields_filled FROM deduped",
                   *PROCESSED, deduped_cte("url")))


def _split_processed(s, d):
    """A dump of collections, merged with the default: splitting on."""
    rows = dv.collections(s, d)
    nothing = F.lit("")
    flat = rows.select(
        "id", F.lit(None).cast(schema.ATTRIBUTES).alias("attributes"), "title", "url", "author", F.col("content").alias("introduce"),
        nothing.alias("full_content"), nothing.alias("episode"), F.when(F.col("id") % 5 == 0, "").otherwise("2024-01-05").alias("time"),
        F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("publish_time"))
    return etl.process_dump(etl.union_dumps(dumps.normalise(flat)), AS_OF)


SPLIT_CTES = [
    *COLLECTION_CTES,
    f"split_rows AS (SELECT id, i AS sub_pos, true AS split, t AS title, u AS url FROM subs WHERE t <> '' UNION ALL "
    f"SELECT id, 0, false, {strip_sql('title')}, {strip_sql('url')} FROM collections WHERE id NOT IN (SELECT id FROM subs WHERE t <> ''))",
    "split_usable AS (SELECT *, id % 5 = 0 AS filled FROM split_rows WHERE length(title) >= 2)",
]
register("e10_usable_rows_split",
         lambda s, d: etl.merged_layout(_split_processed(s, d)).select("id", "title", "url", "time"),
         "WITH " + ",\n".join(SPLIT_CTES) + f"\nSELECT id, title, url, CASE WHEN filled THEN {quote(AS_OF)} ELSE '2024-01-05' END AS time FROM split_usable")
register("e13_dedup_url_split",
         lambda s, d: etl.dedup(etl.merged_layout(_split_processed(s, d)), "url", ["file_no", "id", "sub_pos"]).select("id", "url", "title"),
         "WITH " + ",\n".join(SPLIT_CTES) + "\nSELECT id, url, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id, sub_pos) AS rn FROM split_usable) WHERE rn = 1")
register("e15_merge_statistics_split", lambda s, d: etl.merge_statistics(_split_processed(s, d)),
         "WITH " + ",\n".join(SPLIT_CTES) + "\nSELECT count(*) AS processed_total, count(DISTINCT url) AS merged_total, count(*) - count(DISTINCT url) AS duplicates_removed, "
         "(SELECT count(*) FILTER (split) FROM split_rows) AS articles_split, (SELECT count(*) FROM split_rows) - count(*) AS bad_data_filtered, count(*) FILTER (filled) AS time_fields_filled FROM split_usable")
register("e16_top_authors", lambda s, d: etl.top_authors(_normalised(s, d)),
         with_dump("SELECT author, count(*) AS cnt FROM normalised GROUP BY 1 ORDER BY cnt DESC, author LIMIT 5", NORMALISED))
register("e16_years", lambda s, d: etl.years(_normalised(s, d)),
         with_dump("SELECT split_part(time, '-', 1) AS year, count(*) AS cnt FROM normalised WHERE time <> '' GROUP BY 1 ORDER BY year DESC LIMIT 5", NORMALISED))
register("e16_episodes", lambda s, d: etl.episodes(_normalised(s, d)),
         with_dump("SELECT count(DISTINCT episode) AS episodes, max(episode) AS latest_episode FROM normalised WHERE episode <> ''", NORMALISED))
register("e17_field_presence", lambda s, d: etl.field_presence(_normalised(s, d)),
         with_dump("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({f} <> '') AS has_{f}, count(*) FILTER ({f} <> '') / count(*)::DOUBLE * 100 AS pct_{f}"
                                                           for f in ("url", "title", "episode")) + " FROM normalised", NORMALISED))
register("e18_structure", lambda s, d: etl.structure_profile(_normalised(s, d)),
         with_dump("SELECT count(*) AS total, min(id) AS min_id, max(id) AS max_id, 'title,url,author,introduce,full_content,episode,time' AS fields FROM normalised", NORMALISED))
register("e18_preview", lambda s, d: etl.structure_preview(_normalised(s, d), ["id"]),
         with_dump("SELECT episode, left(title, 40) || '...' AS title, author, time FROM normalised ORDER BY id LIMIT 3", NORMALISED))

# ------------------------------------------------------------------ clean

VALID = quote(r"(?i)^https?://(([A-Z0-9]([A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(:[0-9]+)?(/?|[/?][^" + SP + "]+)$")
FLAGGED = ("flagged AS (SELECT *, CASE WHEN coalesce(author, '') = '' THEN 'empty_author' WHEN coalesce(url, '') = '' THEN 'empty_url' WHEN title = '' THEN 'empty_title' "
           f"WHEN length(title) = 1 THEN 'empty_values' WHEN NOT regexp_matches(url, {VALID}) THEN 'invalid_urls' END AS reason FROM normalised)")


def _flagged(s, d):
    return etl.with_removal_reason(dv.raw_dump(s, d), check_urls=True)


register("e19_removal_reasons", lambda s, d: etl.removal_reasons(_flagged(s, d)),
         with_dump("SELECT reason, count(*) AS cnt FROM flagged WHERE reason IS NOT NULL GROUP BY 1", NORMALISED, FLAGGED))
register("e20_retained", lambda s, d: etl.retained(etl.with_removal_reason(dv.raw_dump(s, d), required=(), check_urls=False)).select("id"),
         with_dump("SELECT id FROM normalised WHERE length(title) <> 1", NORMALISED))
register("e21_url_valid", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", urls.is_valid_url(F.col("url")).alias("valid")),
         f"SELECT page_id, regexp_matches(url, {VALID}) AS valid FROM pages")
register("e21_url_valid_dump", lambda s, d: dv.raw_dump(s, d).select("id", urls.is_valid_url(F.col("url")).alias("valid")),
         with_dump(f"SELECT id, regexp_matches(url, {VALID}) AS valid FROM raw_dump"))
register("e23_retention", lambda s, d: etl.retention(_flagged(s, d)),
         with_dump("SELECT count(*) AS original, count(*) FILTER (reason IS NULL) AS cleaned, count(reason) AS removed, "
                   "count(*) FILTER (reason IS NULL) / count(*)::DOUBLE * 100 AS retention_rate FROM flagged", NORMALISED, FLAGGED))
register("e24_completeness", lambda s, d: etl.completeness(etl.retained(_flagged(s, d)).withColumn("introduce", F.col("content"))),
         with_dump("SELECT " + ", ".join(f"count(*) FILTER ({f} <> '') / count(*)::DOUBLE * 100 AS {f}" for f in etl.COMPLETENESS_FIELDS)
                   + " FROM flagged WHERE reason IS NULL", NORMALISED, FLAGGED))
register("e25_retention_per_file",
         lambda s, d: etl.retention(_flagged(s, d).withColumn("file", F.concat(F.lit("dump-"), F.floor(F.col("id") / 100).cast("string"))), ["file"]),
         with_dump("SELECT 'dump-' || (id // 100)::VARCHAR AS file, count(*) AS original, count(*) FILTER (reason IS NULL) AS cleaned, count(reason) AS removed, "
                   "count(*) FILTER (reason IS NULL) / count(*)::DOUBLE * 100 AS retention_rate FROM flagged GROUP BY 1", NORMALISED, FLAGGED))

# ------------------------------------------------------------------ import

HALF = "2024-01-16 00:00:00"


def _store_and_batch(s, d):
    a = plain_articles(s, d)
    early = F.col("crawl_time") < F.expr(f"timestamp_ntz'{HALF}'")
    return a.filter(early), a.filter(~early)


register("e26_insert_absent",
         lambda s, d: etl.insert_if_absent(*_store_and_batch(s, d), ["id"]).select("id", "url", "title"),
         with_articles("SELECT id, url, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM articles "
                       f"WHERE crawl_time >= TIMESTAMP '{HALF}') WHERE rn = 1 AND url NOT IN (SELECT url FROM articles WHERE crawl_time < TIMESTAMP '{HALF}')"))


def _import(s, d):
    return etl.import_rows(_normalised(s, d), AS_OF)


IMPORT = [
    NORMALISED, *fixed_url_ctes("normalised", out="sub_url"),
    f"import_rows AS (SELECT id, sub_url AS url, title, coalesce(nullif({clean_sql('introduce')}, ''), {quote(fv.CONTENT_MISSING)}) AS content, coalesce(nullif(author, ''), 'Unknown') AS author, "
    "coalesce(nullif(author, ''), 'Imported') AS account_name, coalesce(try_strptime(time, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%Y年%m月%d日']), "
    f"TIMESTAMP {quote(AS_OF)}) AS publish_time, title = '' OR NOT (sub_url LIKE 'http://%' OR sub_url LIKE 'https://%') AS error FROM fixed_urls)",
]
register("e27_import_rows",
         lambda s, d: _import(s, d).select("id", "url", "title", "content", "author", "account_name", "publish_time", "error"),
         with_dump("SELECT id, url, title, content, author, account_name, publish_time, error FROM import_rows", *IMPORT))


def _collection_import(s, d):
    rows = dv.collections(s, d)
    nothing = F.lit("")
    flat = rows.select("id", "title", "url", "author", F.col("content").alias("introduce"), nothing.alias("full_content"),
                       nothing.alias("episode"), F.lit("2024-01-05").alias("time"))
    return etl.import_rows(flat, AS_OF)


register("e28_import_times",
         lambda s, d: _collection_import(s, d).select("id", "url", "title", "publish_time"),
         "WITH " + ",\n".join(COLLECTION_CTES) +
         "\nSELECT id, u AS url, t AS title, TIMESTAMP '2024-01-05' + to_minutes(row_number() OVER (PARTITION BY id ORDER BY i)) AS publish_time FROM subs WHERE t <> '' "
         f"UNION ALL SELECT id, url, {strip_sql('title')}, TIMESTAMP '2024-01-05' FROM collections WHERE id NOT IN (SELECT id FROM subs WHERE t <> '')")
register("e29_import_counters",
         lambda s, d: etl.import_counters(plain_articles(s, d), _import(s, d), ["id"]),
         with_dump("SELECT count(DISTINCT url) FILTER (NOT error AND url NOT IN (SELECT url FROM articles)) AS imported, count(*) FILTER (NOT error) - "
                   "count(DISTINCT url) FILTER (NOT error AND url NOT IN (SELECT url FROM articles)) AS skipped, count(*) FILTER (error) AS errors FROM import_rows",
                   *IMPORT, with_articles("").replace("WITH ", "", 1).strip()))
register("e30_delete",
         lambda s, d: etl.delete_matching(articles(s, d), title="the", account="en", url="/a/1").select("id"),
         with_articles("SELECT id FROM articles WHERE NOT (title ILIKE '%the%' AND account_name = 'en' AND url ILIKE '%/a/1%')"))
register("e31_list_text",
         lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", tx.list_text("html").alias("text")),
         f"SELECT page_id, {strip_sql(f'regexp_replace(regexp_replace(html, {quote('<[^>]+>')}, {quote('')}, {quote('g')}), {quote(f'[{SP}]+')}, {quote(' ')}, {quote('g')})')} AS text FROM pages")
register("e32_truncate",
         lambda s, d: articles(s, d).select("id", tx.truncate_words(tx.list_text("content"), 80).alias("text")),
         with_articles("SELECT id, CASE WHEN length(f) <= 80 THEN f WHEN length(regexp_extract(left(f, 80), '^(.*) ', 1)) > 64 THEN regexp_extract(left(f, 80), '^(.*) ', 1) || '...' "
                       "ELSE left(f, 80) || '...' END AS text FROM (SELECT id, "
                       + strip_sql(f"regexp_replace(regexp_replace(content, '<[^>]+>', '', 'g'), '[{SP}]+', ' ', 'g')") + " AS f FROM articles)"))
for label, brackets in (("", False), ("_vault", True)):
    refused = quote('[<>:"/\\\\|?*' + (r"\[\]" if brackets else "") + "]")
    register(f"e33_file_name{label}",
             lambda s, d, b=brackets: articles(s, d).select("id", tx.file_name("content", b).alias("name")),
             with_articles(f"SELECT id, coalesce(nullif(left({strip_sql(f'regexp_replace(content, {refused}, {quote('')}, {quote('g')})')}, 100), ''), 'untitled') AS name FROM articles"))
