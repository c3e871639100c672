"""Cleaning, splitting, merging and importing article dumps."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions import dates
from pressmill.functions.text import (
    SPACE, SPACE_IN_LINE, clean_content, clean_field, contains_any_case, episode, is_blank,
    nonempty, strip, title_without_episode, with_summary)
from pressmill.functions.urls import fixed_url, has_web_scheme, is_valid_url
from pressmill.operators.numbering import number_rows

ALL = 1_000_000_000  # length that means "to the end" in slice()
STRATEGIES = ("url", "title", "episode", "title_author", "url_title")
COMPLETENESS_FIELDS = ["author", "url", "title", "episode", "time", "introduce"]


# ---------------------------------------------------------------- structured form

def structured(df):
    """Articles in the structured layout ``id, attributes{...}`` (E5).

    The time is cut to its date where it begins with one.
    """
    df = df.withColumn("cleaned", clean_content(F.coalesce(F.col("content"), F.lit(""))))
    df = with_summary(df)
    return df.select(
        "id",
        F.struct(
            episode(F.coalesce(F.col("title"), F.lit(""))).alias("episode"),
            title_without_episode(F.coalesce(F.col("title"), F.lit(""))).alias("title"),
            F.col("author").alias("author"),
            F.coalesce(F.col("url"), F.lit("")).alias("url"),
            _date_of(F.col("publish_time")).alias("time"),
            F.col("introduce").alias("introduce"),
            F.col("cleaned").alias("full_content"),
        ).alias("attributes"))


def _date_of(time):
    """A time cut to its date where it begins with one, else as it is; empty for null."""
    time = F.coalesce(time.cast("string"), F.lit(""))
    day = dates.parse_date(F.split_part(time, F.lit(" "), F.lit(1)), ["day", "chinese"])
    return F.coalesce(dates.day(day), time)


def without_fields(structured_df, fields):
    """Leave fields out of ``attributes`` (E22, and the simplified dump of X15)."""
    return structured_df.withColumn("attributes", F.col("attributes").dropFields(*fields)) if fields else structured_df


# ---------------------------------------------------------------- numbered items

def numbered_items(df, text="cleaned"):
    """Items of a digest: every line ``1. title`` starts one.

    The text is cut at the item lines, so a row becomes its items without a shuffle.
    ``title by author`` and ``title (author)`` name the author; a line that is a URL is
    the item's link (the last one counts); the other lines form the introduction.
    """
    start = rf"(?dm)^[{SPACE_IN_LINE}]*\p{{Nd}}+[.、][{SPACE_IN_LINE}]*(?=[^{SPACE}])"
    # Cut in front of every start; what stands before the first one is no item.
    pieces = F.transform(F.slice(F.split(F.col(text), f"(?={start})"), 1, ALL), lambda p: F.when(
        p.rlike(f"^(?:{start})"), F.regexp_replace(p, f"^(?:{start})", "")))
    pieces = F.filter(pieces, lambda p: p.isNotNull())
    rows = df.select("*", F.posexplode_outer(pieces).alias("_no", "_item"))
    head = strip(F.split_part("_item", F.lit("\n"), F.lit(1)))
    by = rf"(?iu)^(.+?)[{SPACE}]+by[{SPACE}]+([\p{{L}}\p{{N}}_]+)"
    paren = rf"^(.+?)[{SPACE}]*[（(]([\p{{L}}\p{{N}}_]+)[）)]"
    rows = rows.withColumns({
        "_head": head,
        "_lines": F.filter(
            F.transform(F.slice(F.split("_item", "\n"), 2, ALL), strip), lambda s: s != "")})
    is_by, is_paren = F.col("_head").rlike(by), F.col("_head").rlike(paren)

    def part(i, default):
        return (F.when(is_by, strip(F.regexp_extract("_head", by, i)))
                .when(is_paren, strip(F.regexp_extract("_head", paren, i))).otherwise(default))

    def is_url(s):
        return s.rlike("^https?://")
    return rows.withColumns({
        "item_no": F.col("_no") + 1,
        "item_title": part(1, F.col("_head")),
        "item_author": part(2, F.lit("")),
        "item_url": F.coalesce(F.try_element_at(F.filter("_lines", is_url), F.lit(-1)), F.lit("")),
        "item_introduce": F.array_join(F.filter("_lines", lambda s: ~is_url(s)), " "),
    }).drop("_no", "_item", "_head", "_lines")


def digest_export(df):
    """Structured export of digests (E6): items where an article has any, else the article.

    Items are looked for in every article as soon as one title holds the digest marker.
    """
    marker = F.contains(F.coalesce(F.col("title"), F.lit("")), F.lit(fv.COLLECTION_MARKER))
    any_digest = df.agg(F.max(marker)).scalar()
    # Summaries are made before the split, once per article.
    cleaned = with_summary(df.withColumn("cleaned", clean_content(F.coalesce(F.col("content"), F.lit("")))))
    items = cleaned.withColumn("_searched", F.when(any_digest, F.col("cleaned"))).drop("content")
    whole = numbered_items(items, "_searched")
    is_item = F.col("item_no").isNotNull()
    title = F.coalesce(F.col("title"), F.lit(""))
    return whole.select(
        "id", F.coalesce("item_no", F.lit(0)).alias("item_no"), episode(title).alias("episode"),
        F.when(is_item, F.col("item_title")).otherwise(title_without_episode(title)).alias("title"),
        F.when(is_item, F.col("item_author")).otherwise(F.col("author")).alias("author"),
        F.when(is_item, F.col("item_url")).otherwise(F.coalesce("url", F.lit(""))).alias("url"),
        _date_of(F.col("publish_time")).alias("time"),
        F.when(is_item, F.col("item_introduce")).otherwise(F.col("introduce")).alias("introduce"),
        F.when(~is_item, F.col("cleaned")).alias("full_content"))


# ---------------------------------------------------------------- collections

def split_collections(df, text, title="title", always=False, repair=None):
    """One row per article linked in a collection.

    A block runs from the end of the URL before to the start of the URL after.  Title:
    the text in front of the URL on its line, else the nearest line above that is
    shorter than 200, else the first line below when shorter than 150.  Author: the last
    line below that begins with a name of less than 20 characters and a colon.
    Articles that are no collections, or hold no usable link, keep one row of their own.
    Needs ``id, url, author`` beside title and text; adds ``sub_*`` and ``split``.
    ``repair`` is applied to every URL before the rows are dealt out, so that filters on
    the URL do not repair it again.
    """
    url = rf"https?://[^{SPACE}]+"
    is_collection = F.lit(True) if always else F.contains(F.col(title), F.lit(fv.COLLECTION_MARKER))
    # The lines of a gap serve the URL behind it and the one in front.
    df = df.withColumns({
        "_urls": F.when(is_collection, F.regexp_extract_all(F.col(text), F.lit(url), F.lit(0))),
        "_gaps": F.when(is_collection, F.transform(
            F.split(F.col(text), url), lambda gap: F.transform(F.split(gap, "\n"), strip)))})
    blocks = F.transform("_urls", lambda u, i: F.struct(
        u.alias("url"), F.get("_gaps", i).alias("above"),
        F.filter(F.slice(F.get("_gaps", i + 1), 2, ALL), lambda s: s != "").alias("below")))
    df = df.withColumn("_blocks", blocks).drop("_urls", "_gaps")
    # In a lambda every use of a value evaluates it anew, so each step makes what the next one uses more than once.
    items = F.transform(F.transform("_blocks", _block_parts), _collection_item)
    df = df.withColumn("_items", F.filter(items, lambda x: x["title"] != "")).drop("_blocks")
    own = F.struct(F.col(title).alias("title"), F.col("url").alias("url"),
                   F.col(text).alias("content"), F.col("author").alias("author"))
    found = F.coalesce(F.size("_items") > 0, F.lit(False))
    df = df.withColumns({"split": found, "_all": F.when(found, F.col("_items")).otherwise(F.array(own))})
    stripped = F.transform("_all", lambda x: F.struct(
        strip(x["title"]).alias("title"), (repair or (lambda c: c))(strip(x["url"])).alias("url"),
        x["content"].alias("content"), x["author"].alias("author")))
    rows = df.select(*[c for c in df.columns if c not in ("_items", "_all")],
                     F.posexplode_outer(stripped).alias("sub_pos", "_sub"))
    return rows.withColumns({
        "sub_title": F.col("_sub.title"), "sub_url": F.col("_sub.url"),
        "sub_content": strip(F.col("_sub.content")),
        "sub_author": F.coalesce(nonempty(strip(F.col("_sub.author"))), F.col("author")),
    }).drop("_sub")


def _has_name(line):
    return F.contains(line, F.lit(":")) & (F.length(_name_of(line)) < 20)


def _name_of(line):
    return strip(F.substring_index(line, ":", 1))


def _block_parts(block):
    """URL, title above it, author, and body below it of one block."""
    def behind_colon(line):
        return strip(F.substr(line, F.locate(":", line) + 1))
    none = F.lit("")
    same_line = F.element_at(block["above"], -1)
    earlier = F.filter(F.slice(block["above"], 1, F.size(block["above"]) - 1), lambda s: (s != "") & (F.length(s) < 200))
    author = _name_of(F.try_element_at(F.filter(block["below"], _has_name), F.lit(-1)))
    body = F.filter(F.transform(block["below"], lambda s: F.when(_has_name(s), behind_colon(s)).otherwise(s)),
                    lambda s: s != "")
    return F.struct(
        block["url"].alias("url"),
        F.coalesce(nonempty(same_line), F.try_element_at(earlier, F.lit(-1)), none).alias("title"),
        F.coalesce(author, none).alias("author"), body.alias("body"))


def _collection_item(parts):
    """Title, url, content and author of one block."""
    first = F.try_element_at(parts["body"], F.lit(1))
    borrow = (parts["title"] == "") & first.isNotNull() & (F.length(first) < 150)
    return F.struct(
        F.when(borrow, first).otherwise(parts["title"]).alias("title"),
        parts["url"].alias("url"),
        F.array_join(F.when(borrow, F.slice(parts["body"], 2, ALL)).otherwise(parts["body"]), "\n").alias("content"),
        parts["author"].alias("author"))


# ---------------------------------------------------------------- merge

def process_dump(normalised, as_of, smart_split=True, filter_bad=True, fill_time=True):
    """Split collections, repair URLs, flag bad rows and fill times.

    ``normalised`` comes from ``sources.dumps.normalise``.  Rows are flagged, not
    dropped, so that ``merge_statistics`` can count them: ``bad`` and ``time_filled``.
    """
    df = normalised.withColumn("_text", F.coalesce(nonempty(F.col("full_content")), F.col("introduce")))
    if smart_split:
        df = split_collections(df, "_text", repair=fixed_url)
    else:
        df = df.withColumns({"split": F.lit(False), "sub_pos": F.lit(0), "sub_title": F.col("title"),
                             "sub_url": fixed_url(F.col("url")), "sub_content": F.col("_text"), "sub_author": F.col("author")})
    no_time = F.col("time") == ""
    return df.withColumns({
        "bad": ~is_usable(F.col("sub_title"), F.col("sub_url")) if filter_bad else F.lit(False),
        "time_filled": no_time if fill_time else F.lit(False),
        "time": F.when(no_time, F.lit(as_of)).otherwise(F.col("time")) if fill_time else F.col("time"),
    }).drop("_text")


def is_usable(title, url):
    """Title of at least two characters and a web URL."""
    return (F.length(strip(title)) >= 2) & has_web_scheme(url)


def merged_layout(processed):
    """Usable rows in the attribute layout, ready for ``dedup``."""
    body = F.col("sub_content")
    keep = [c for c in ("file_no", "pos") if c in processed.columns]
    return processed.filter(~F.col("bad")).select(
        "id", *keep, "sub_pos", F.col("sub_title").alias("title"), F.col("sub_url").alias("url"),
        F.col("sub_author").alias("author"),
        F.when(F.length(body) > 200, F.concat(F.left(body, F.lit(200)), F.lit("..."))).otherwise(body).alias("introduce"),
        body.alias("full_content"), "episode", "time")


def dedup_key(strategy):
    """Key of a deduplication strategy, falling back to the URL, then the title.

    Null where both are empty.
    """
    def field(name):
        return nonempty(clean_field(F.col(name)))
    keys = {
        "url": lambda: field("url"), "title": lambda: field("title"), "episode": lambda: field("episode"),
        "title_author": lambda: F.concat(field("title"), F.lit("_"), field("author")),
        "url_title": lambda: F.concat(field("url"), F.lit("_"), field("title")),
    }
    return F.coalesce(keys[strategy](), field("url"), field("title"))


def dedup(df, strategy, order):
    """Keep the first row of every key in the given order; rows without key go.

    The ``= 1`` filter makes Spark keep one row per key in every task before the shuffle,
    so many copies of one key do not travel.
    """
    w = Window.partitionBy("_key").orderBy(*order)
    return (df.withColumn("_key", dedup_key(strategy)).filter("_key IS NOT NULL")
            .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_key"))


def union_dumps(*dumps):
    """Several dumps one behind the other; ``file_no`` keeps their order."""
    out = None
    for i, d in enumerate(dumps):
        d = d.withColumn("file_no", F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def renumber(df, order):
    """Number rows 1..n by descending id, then by ``order``.

    Rows without id come last; rows that share an id, as the parts of a split collection do, each
    have a number of their own.
    """
    return number_rows(df, [F.col("id").desc_nulls_last(), *order], out="new_id")


def merge_statistics(processed, strategy="url"):
    """Counts of a merge (E15): one row.

    Duplicates are rows with a key minus different keys.
    """
    keyed = processed.withColumns({"title": F.col("sub_title"), "url": F.col("sub_url"),
                                   "author": F.col("sub_author")}).withColumn(
        "_key", F.when(~F.col("bad"), dedup_key(strategy)))
    # Counting per key first keeps the distinct count off the wide rows.
    per_key = keyed.groupBy("_key").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("bad"),
        F.count_if(F.col("split")).alias("split"),
        F.count_if(F.col("time_filled") & ~F.col("bad")).alias("filled"))
    has_key = F.col("_key").isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n") - F.sum("bad"), F.lit(0)).alias("processed_total"),
        F.count("_key").alias("merged_total"),
        F.coalesce(F.sum(F.when(has_key, F.col("n") - 1)), F.lit(0)).alias("duplicates_removed"),
        F.coalesce(F.sum("split"), F.lit(0)).alias("articles_split"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_data_filtered"),
        F.coalesce(F.sum("filled"), F.lit(0)).alias("time_fields_filled"))


# ---------------------------------------------------------------- profiles

def top_authors(df, limit=5):
    """Most frequent authors of a dump."""
    return (df.groupBy("author").agg(F.count("*").alias("cnt"))
            .orderBy(F.desc("cnt"), F.col("author").asc_nulls_last()).limit(limit))


def years(df, limit=5):
    """Articles per year, latest years first; the year is the time's text before a dash."""
    return (df.filter("time <> ''").groupBy(F.split_part("time", F.lit("-"), F.lit(1)).alias("year"))
            .agg(F.count("*").alias("cnt")).orderBy(F.desc("year")).limit(limit))


def episodes(df):
    """Number of different episodes and the greatest as text."""
    return (df.filter("episode <> ''").groupBy("episode").count()
            .agg(F.count("*").alias("episodes"), F.max("episode").alias("latest_episode")))


def field_presence(df, fields=("url", "title", "episode")):
    """How many articles have a field, and in percent."""
    has = {f: F.count_if(F.coalesce(F.col(f), F.lit("")) != "") for f in fields}
    return df.agg(F.count("*").alias("total"),
                  *[n.alias(f"has_{f}") for f, n in has.items()],
                  *[(n / F.count("*") * 100).alias(f"pct_{f}") for f, n in has.items()])


def structure_profile(df):
    """Id range, number of articles and fields."""
    return df.agg(F.count("*").alias("total"), F.min("id").alias("min_id"), F.max("id").alias("max_id")).withColumn(
        "fields", F.lit(",".join(c for c in df.columns if c not in ("id", "file", "source", "pos", "file_no"))))


def structure_preview(df, order, limit=3):
    """First rows of a dump as a preview."""
    return df.orderBy(*order).limit(limit).select(
        F.coalesce("episode", F.lit("N/A")).alias("episode"),
        F.concat(F.left(F.coalesce("title", F.lit("No Title")), F.lit(40)), F.lit("...")).alias("title"),
        F.coalesce("author", F.lit("Unknown")).alias("author"), F.coalesce("time", F.lit("N/A")).alias("time"))


# ---------------------------------------------------------------- clean

def with_removal_reason(df, required=("author", "url", "title"), short_titles=True, check_urls=False):
    """Add why a row is removed, null where it stays.

    The first required field that is blank decides, then one-character titles, then URLs
    that do not validate.
    """
    reasons = [F.when(is_blank(F.col(f)), F.lit(f"empty_{f}")) for f in required]
    if short_titles:
        reasons.append(F.when(F.length(strip(F.col("title"))) == 1, F.lit("empty_values")))
    if check_urls:
        url = strip(F.col("url"))
        reasons.append(F.when((url != "") & ~is_valid_url(url), F.lit("invalid_urls")))
    return df.withColumn("reason", F.coalesce(*reasons, F.lit(None).cast("string")))


def removal_reasons(flagged):
    """Removed rows per reason."""
    return flagged.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("cnt"))


def retained(flagged):
    return flagged.filter("reason IS NULL").drop("reason")


def retention(flagged, by=()):
    """Rows before and after, removed rows and retention in percent (E23, E25 per file)."""
    kept = F.count_if(F.col("reason").isNull())
    return flagged.groupBy(*by).agg(
        F.count("*").alias("original"), kept.alias("cleaned"),
        F.count("reason").alias("removed"), (kept / F.count("*") * 100).alias("retention_rate"))


def completeness(df, fields=tuple(COMPLETENESS_FIELDS)):
    """Percentage of rows in which a field holds text."""
    return df.agg(*[(F.count_if(~is_blank(F.col(f))) / F.count("*") * 100).alias(f) for f in fields])


# ---------------------------------------------------------------- import

def parsed_time(c, as_of):
    """Time in one of four formats, the import time when none reads it."""
    return F.coalesce(dates.parse_date(c, dates.IMPORT_FORMATS), dates.as_timestamp(as_of))


def import_rows(normalised, as_of, account=None, clean=True):
    """Rows to insert, made from a dump (E27, E28); ``error`` marks unusable ones.

    Articles of one collection are set apart by a minute each, in their order.
    """
    df = process_dump(normalised, as_of, filter_bad=False, fill_time=False)
    body = clean_content(F.col("sub_content")) if clean else F.col("sub_content")
    minutes = F.when(F.col("split"), F.col("sub_pos") + 1).otherwise(0)
    keep = [c for c in ("file_no", "pos") if c in df.columns]
    author = nonempty(F.col("sub_author"))
    return df.withColumn("_body", body).select(
        *keep, "id", "sub_pos", F.col("sub_url").alias("url"), F.col("sub_title").alias("title"),
        F.coalesce(nonempty(F.col("_body")), F.lit(fv.CONTENT_MISSING)).alias("content"),
        F.coalesce(author, F.lit(fv.AUTHOR_MISSING)).alias("author"),
        F.coalesce(F.lit(account).cast("string"), author, F.lit(fv.ACCOUNT_MISSING)).alias("account_name"),
        F.timestamp_add("MINUTE", minutes, parsed_time(F.col("time"), as_of)).alias("publish_time"),
        dates.as_timestamp(as_of).alias("crawl_time"),
        ((F.col("sub_title") == "") | ~has_web_scheme(F.col("sub_url"))).alias("error"))


def insert_if_absent(store, batch, order):
    """Rows of the batch whose URL is new, one per URL.

    Deduplication and anti join both work on the URL, so they share one shuffle.
    """
    w = Window.partitionBy("url").orderBy(*order)
    first = (batch.filter("url IS NOT NULL").withColumn("_rn", F.row_number().over(w))
             .filter("_rn = 1").drop("_rn"))
    return first.join(store.select("url"), "url", "left_anti")


def import_counters(store, batch, order):
    """Imported, skipped and unusable rows of an import (E29): one row.

    Per URL: how many rows came and whether the store has it.
    """
    usable = batch.filter(~F.col("error")).groupBy("url").agg(F.count("*").alias("n"))
    known = store.select("url").distinct().withColumn("known", F.lit(True))
    joined = usable.join(known, "url", "left")
    new = F.count_if(F.col("known").isNull())
    counts = joined.agg(new.alias("imported"), (F.coalesce(F.sum("n"), F.lit(0)) - new).alias("skipped"))
    return counts.withColumn("errors", batch.agg(F.count_if("error")).scalar())


def delete_matching(df, title=None, account=None, url=None):
    """The articles that remain when matching ones are deleted.

    Conditions are joined by AND; unknown counts as no match.  Without any condition
    nothing is deleted.
    """
    conditions = []
    if title:
        conditions.append(contains_any_case("title", title))
    if account:
        conditions.append(F.col("account_name") == account)
    if url:
        conditions.append(contains_any_case("url", url))
    if not conditions:
        return df
    hit = conditions[0]
    for c in conditions[1:]:
        hit = hit & c
    return df.filter(~F.coalesce(hit, F.lit(False)))
