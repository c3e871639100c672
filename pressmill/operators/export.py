"""Rendering and writing of article documents, lists and vault notes."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions import dates
from pressmill.functions.matching import exploded, mapped_values
from pressmill.functions.numbers import round_score
from pressmill.functions.text import clean_content, file_name, list_text, nonempty, text_of, truncate_words
from pressmill.operators.numbering import number_rows


def analysed(articles):
    """Articles with tagging and quality: computed once, used by every export.

    Write the result to storage before several exports read it.
    """
    from pressmill.operators.quality import with_key_points, with_quality, with_suggestions
    from pressmill.operators.tags import with_tags

    return with_suggestions(with_key_points(with_quality(with_tags(articles))))


def with_categories(df, mapping=None):
    """Add the export categories of every article.

    A keyword of the technology stack that a category key is part of stands in the text
    itself, so looking at the text finds the categories of the stack as well.
    """
    mapping = mapping or fv.EXPORT_CATEGORIES
    df = df.withColumn("_lower", F.lower(text_of()))
    df = df.withColumn("_cats", mapped_values("_lower", mapping))
    return df.withColumn("categories", F.when(F.size("_cats") > 0, F.col("_cats")).otherwise(
        F.array(F.lit(fv.EXPORT_DEFAULT_CATEGORY)))).drop("_lower", "_cats")


def length_band(n, names):
    """Below 500, below 1500, and longer."""
    return F.when(n < 500, names[0]).when(n < 1500, names[1]).otherwise(names[2])


def tag_line():
    """Tags of the document header: stack, difficulty, type, grade, length."""
    return F.concat(
        F.transform("tech_stack", lambda t: F.concat(F.lit("#"), t)),
        F.array(F.concat(F.lit("#难度_"), F.col("difficulty")), F.concat(F.lit("#"), F.col("content_type")),
                F.concat(F.lit("#质量等级_"), F.col("grade")),
                length_band(F.col("word_count"), ["#短文", "#中文", "#长文"])))


def _two_digits(c):
    return F.format_string("%.2f", round_score(c))


def markdown():
    """Article document in Markdown."""
    def bullets(heading, items):
        body = F.concat(F.lit(f"#### {heading}\n\n- "), F.array_join(items, "\n- "), F.lit("\n\n"))
        return F.when(F.size(items) > 0, body).otherwise("")
    def text(c, missing=""):
        return F.coalesce(F.col(c).cast("string"), F.lit(missing))
    when = F.coalesce(F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    rows = [("原创性", "originality"), ("技术深度", "technical_depth"), ("可读性", "readability"),
            ("结构化", "structure"), ("参与度", "engagement"), ("完整性", "completeness")]
    table = [p for label, c in rows for p in (F.lit(f"| {label} | "), _two_digits(F.col(c)), F.lit(" |\n"))]
    return F.concat(
        F.lit("# "), text("title", "无标题"), F.lit("\n\n## 元信息\n\n- **作者**: "), text("author", "未知作者"),
        F.lit("\n- **发布账号**: "), text("account_name", "未知账号"), F.lit("\n- **发布时间**: "), when,
        F.lit("\n- **原文链接**: ["), text("url"), F.lit("]("), text("url"), F.lit(")\n- **标签**: "),
        F.array_join(tag_line(), " "), F.lit("\n\n---\n\n## 正文\n\n"), text("content"),
        F.lit("\n\n---\n\n## 文章分析\n\n### 质量评估\n\n- **总体评分**: "), _two_digits(F.col("overall")),
        F.lit("/1.00\n- **质量等级**: "), F.col("grade"), F.lit("\n- **字数**: "), text("word_count"),
        F.lit("\n- **预计阅读时间**: "), text("reading_time"),
        F.lit(" 分钟\n\n#### 详细指标\n\n| 指标 | 分数 |\n|------|------|\n"), *table, F.lit("\n"),
        bullets("文章要点", F.col("key_points")), bullets("改进建议", F.col("suggestions")))


def with_documents(df, no="no"):
    """Add file name ``0001_title.md`` and the document; ``no`` numbers the articles."""
    return df.withColumns({
        "file_name": F.format_string("%04d_%s.md", F.col(no), file_name(F.col("title"))),
        "markdown": markdown()})


def by_category(df):
    """One row per article and category folder."""
    return exploded(df, [c for c in df.columns if c != "categories"], "categories", "category").withColumn(
        "category", F.replace("category", F.lit("/"), F.lit("_")))


def category_counts(with_cats):
    return exploded(with_cats, [], "categories", "category").groupBy("category").agg(F.count("*").alias("cnt"))


def month_bucket():
    """Month of publication, ``unknown`` without one."""
    return F.coalesce(dates.month("publish_time"), F.lit("unknown"))


def author_folder():
    """Folder of an author."""
    return file_name(F.coalesce(F.col("author"), F.lit("未知作者")))


def write_partitioned(df, path, column, fmt="parquet"):
    """Write one folder per value of a column (sink of X4, X5, X6).

    ``rebalance`` gathers small values into few files and lets Spark split a value that
    holds a large share of the rows.
    """
    df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).format(fmt).save(path)


def index_tables(df):
    """Tables of the index document: categories, 20 leading authors, 12 months."""
    cats = category_counts(with_categories(df)).select(F.lit("category").alias("part"), F.col("category").alias("name"), "cnt")
    authors = (df.groupBy(F.coalesce("author", F.lit("未知作者")).alias("name")).agg(F.count("*").alias("cnt"))
               .orderBy(F.desc("cnt"), "name").limit(20).select(F.lit("author").alias("part"), "name", "cnt"))
    months = (df.groupBy(month_bucket().alias("name")).agg(F.count("*").alias("cnt"))
              .orderBy(F.desc("name")).limit(12).select(F.lit("month").alias("part"), "name", "cnt"))
    return cats.unionByName(authors).unionByName(months)


def description():
    """``by author | date | summary`` with missing parts left out."""
    by = F.when(nonempty(F.col("author")).isNotNull(), F.concat(F.lit("by "), F.col("author")))
    summary = nonempty(truncate_words(F.col("_listed"), 80))
    joined = F.concat_ws(" | ", by, dates.day("publish_time"), summary)
    return F.coalesce(nonempty(joined), F.lit("No description"))


def list_entries(df):
    """One line per article: ``[title](url) -- description``."""
    df = df.withColumn("_listed", list_text(F.col("content")))
    return df.withColumn("entry", F.concat(
        F.lit("["), list_text(F.coalesce("title", F.lit("无标题"))), F.lit("]("),
        F.coalesce("url", F.lit("#")), F.lit(") -- "), description())).drop("_listed")


def group_key(by):
    """Group of a list entry: author, month or account."""
    unknown = F.lit("Unknown")
    return {"author": F.coalesce("author", unknown), "date": F.coalesce(dates.month("publish_time"), unknown),
            "account": F.coalesce("account_name", unknown)}.get(by, F.lit("All"))


def grouped_entries(df, by):
    """List entries numbered within their group, newest first.

    Numbers come from ranges (see ``number_rows``), so a group may be of any size; entries
    are rendered behind them.
    """
    keyed = df.withColumn("group", group_key(by))
    numbered = list_entries(number_rows(keyed, [F.col("publish_time").desc_nulls_last(), F.col("id")],
                                        out="no", group=["group"]))
    return numbered.select("group", "no", F.concat(F.col("no").cast("string"), F.lit(". "), F.col("entry")).alias("line"))


def vault_tags(df):
    """Add the sorted tags of a vault note (X10).  Needs tagging and quality columns."""
    lower = F.lower(text_of())
    df = df.withColumn("_lower", lower)
    mapped = mapped_values("_lower", fv.VAULT_TAGS)
    def label(prefix, c):
        return F.when(nonempty(F.col(c)).isNotNull(), F.concat(F.lit(prefix), file_name(F.col(c), brackets=True)))
    tech = F.transform("tech_stack", lambda t: F.lower(F.regexp_replace(t, r"[^a-zA-Z0-9一-鿿]", "")))
    single = F.array(
        label("author/", "author"), label("account/", "account_name"),
        F.date_format("publish_time", "'year/'yyyy"), F.date_format("publish_time", "'month/'yyyy-MM"),
        F.concat(F.lit("difficulty/"), F.col("difficulty")), F.concat(F.lit("category/"), F.col("main_category")),
        F.concat(F.lit("quality/"), F.col("grade")),
        F.concat(F.lit("length/"), length_band(F.col("word_count"), ["short", "medium", "long"])))
    stack = F.transform(F.filter(tech, lambda t: t != ""), lambda t: F.concat(F.lit("tech/"), t))
    every = F.array_compact(F.concat(mapped, single, stack))
    return df.withColumn("vault_tags", F.array_sort(F.array_distinct(every))).drop("_lower")


def front_matter():
    """Header of a vault note (X11); dates stay null without publication time."""
    return F.struct(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"),
        F.col("author"), F.col("account_name").alias("account"), F.col("vault_tags").alias("tags"),
        F.date_format("publish_time", "yyyy-MM-dd'T'HH:mm:ss").alias("published"),
        dates.day("publish_time").alias("date"),
        F.struct("grade", round_score(F.col("overall")).alias("score"), "word_count", "reading_time").alias("quality"))


def wikilink_edges(df, n=10):
    """Edges from an article to its author, account and first tags."""
    def edge(kind, c):
        return F.when(nonempty(F.col(c)).isNotNull(), F.struct(
            F.concat(F.lit(f"{kind}/"), file_name(F.col(c), brackets=True)).alias("dst"), F.lit(kind).alias("kind")))
    tags = F.transform(F.slice("vault_tags", 1, n), lambda t: F.struct(
        F.concat(F.lit("Tags/"), F.replace(t, F.lit("/"), F.lit("-"))).alias("dst"), F.lit("Tags").alias("kind")))
    every = F.concat(F.array(edge("Authors", "author"), edge("Accounts", "account_name")), tags)
    return exploded(df, [F.col("id").alias("src")], every, "_e").select("src", "_e.dst", "_e.kind")


def vault_notes(df, no="no"):
    """File name and text of every vault note."""
    def name(c):
        return file_name(F.coalesce(F.col(c), F.lit("")), brackets=True)
    def line(key, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit("\n")))
    head = F.concat_ws(
        "", F.lit("---\n"), line("title", F.coalesce("title", F.lit(""))), line("url", F.coalesce("url", F.lit(""))),
        line("author", F.col("author")), line("account", F.col("account_name")), F.lit("tags:\n"),
        F.array_join(F.transform("vault_tags", lambda t: F.concat(F.lit("  - "), t, F.lit("\n"))), ""),
        line("published", F.date_format("publish_time", "yyyy-MM-dd'T'HH:mm:ss")),
        line("date", dates.day("publish_time")), F.lit("quality:\n"), line("  grade", F.col("grade")),
        line("  score", round_score(F.col("overall"))), line("  word_count", F.col("word_count")),
        line("  reading_time", F.col("reading_time")), F.lit("---\n\n"))
    url = F.coalesce("url", F.lit("#"))
    body = F.concat(
        F.lit("# "), F.coalesce("title", F.lit("无标题")), F.lit("\n\n## 📝 摘要\n\n"),
        F.left(F.coalesce("content", F.lit("无内容")), F.lit(200)), F.lit("...\n\n## 🔗 链接\n\n- **原文**: ["), url,
        F.lit("]("), url, F.lit(")\n- **作者**: [[Authors/"), name("author"), F.lit("]]\n- **来源**: [[Accounts/"),
        name("account_name"), F.lit("]]\n\n## 🏷️ 标签\n\n"),
        F.array_join(F.transform("vault_tags", lambda t: F.concat(F.lit("#"), t)), " "), F.lit("\n"))
    return df.select(
        "id", F.format_string("%04d_%s.md", F.col(no), file_name(F.col("title"), brackets=True)).alias("file_name"),
        F.concat(head, body).alias("note"))


def author_grades(scored):
    """Articles and grades per author, for author notes."""
    known = scored.filter(F.col("author").isNotNull() & ~F.col("author").isin("", "Unknown"))
    return known.groupBy("author").agg(
        F.count("*").alias("total_articles"),
        *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCD"])


def export_info(df, exported_at, account=None):
    """Header of a JSON export (X15): number of articles, time, account."""
    return df.agg(F.count("*").alias("total"), F.lit(exported_at).alias("export_time"), F.lit(account or "all").alias("account"))


def write_dump(structured, path, fmt="json", simplified=False):
    """Write articles as JSON Lines or CSV (X15); ``simplified`` leaves out full texts."""
    from pressmill.operators.etl import without_fields

    if simplified:
        structured = without_fields(structured, ["full_content"])
    if fmt == "json":
        structured.write.mode("overwrite").json(path)
    else:
        (structured.select("id", "attributes.*").write.mode("overwrite")
         .option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def text_blocks(df, no="no"):
    """Plain-text form of articles (X15); ``no`` numbers them."""
    unknown = F.lit("Unknown")
    fields = [("Title", F.coalesce("title", F.lit("No Title"))), ("Author", F.coalesce("author", unknown)),
              ("Account", F.coalesce("account_name", unknown)),
              ("Published", F.coalesce(F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss"), unknown)),
              ("URL", F.coalesce("url", F.lit("")))]
    lines = [F.concat(F.lit(f"{label}: "), c) for label, c in fields]
    body = clean_content(F.coalesce(F.col("content"), F.lit("No content")))
    return df.select(F.col(no), F.concat_ws(
        "\n", F.concat(F.lit("Article "), F.col(no).cast("string")), *lines, F.lit("-" * 40), body,
        F.lit(""), F.lit("=" * 80), F.lit("")).alias("value"))


def write_report(df, path):
    """Save a report as JSON."""
    df.write.mode("overwrite").json(path)


def with_row_numbers(df):
    """Add ``no``: place of an article by publication, newest first.  Number first, analyse
    afterwards."""
    return number_rows(df, [F.col("publish_time").desc_nulls_last(), F.col("id")], out="no")


