"""Queries that vault notes ask about the note table.

The table has ``id, title, url, author, account_name, publish_time, vault_tags, grade,
overall``.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.functions import dates
from pressmill.functions.matching import exploded
from pressmill.session import once


def _newest():
    return [F.col("publish_time").desc_nulls_last(), F.col("id").desc()]


def _leaders(rows, key, n):
    """The n newest articles of every key as one small array per key.

    The rank filter cuts every task to n rows per key before the shuffle, so the array
    has at most n entries however many articles share the key.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*_newest())))
    return (ranked.filter(F.col("_rank") <= n).groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("_rank", "id"))).alias("_leaders")))


def _related(rows, leaders, key, n):
    """First n leaders of a row's key that are not the row itself."""
    joined = rows.join(leaders, key)
    others = F.slice(F.filter("_leaders", lambda s: s["id"] != F.col("id")), 1, n)
    return joined.select("id", F.posexplode(others).alias("_pos", "_o")).select(
        "id", (F.col("_pos") + 1).alias("rank"), F.col("_o.id").alias("related_id"))


def related_by_author(notes, n=5):
    """Newest other articles of the same author.

    One more than n per author is enough: at most one of them is the article itself.
    """
    rows = notes.filter("author IS NOT NULL").select("id", "author", "publish_time")
    return _related(rows.select("id", "author"), _leaders(rows, "author", n + 1), "author", n)


def related_by_first_tag(notes, n=5, tags="vault_tags"):
    """Newest other articles with a tag that contains an article's first tag.

    ``ai`` meets ``tech/ai``.  Containment is an equality join: each different tag is expanded to its
    substrings, which meet the tags that are asked for.  Only the n + 1 newest articles of
    each tag go that way: an article among the newest of a text is among those of one of its tags.
    An article without tags asks for ``none``.
    """
    notes = once(notes.select("id", "publish_time", tags))   # tagging and scoring run once
    newest = Window.partitionBy("holder").orderBy(*_newest())
    per_tag = (exploded(notes, ["id", "publish_time"], tags, "holder").withColumn("_rank", F.row_number().over(newest))
               .filter(F.col("_rank") <= n + 1).drop("_rank"))
    # The first tag is taken from the array as an expression of the same projection.
    first = notes.select("id", F.explode_outer(F.slice(tags, 1, 1)).alias("tag")).select("id", F.coalesce("tag", F.lit("none")).alias("tag"))
    parts = F.expr("flatten(transform(sequence(1, length(holder)), i -> transform(sequence(1, length(holder) - i + 1), k -> substring(holder, i, k))))")
    holders = per_tag.select("holder").distinct().filter("holder <> ''").select("holder", F.explode(F.array_distinct(parts)).alias("tag"))
    asked = holders.join(first.select("tag").distinct(), "tag")
    rows = asked.join(per_tag, "holder").select("tag", "id", "publish_time").distinct()
    return _related(first, _leaders(rows, "tag", n + 1), "tag", n)


def author_rows(notes, limit=10):
    """Authors with most articles (D3)."""
    return (notes.groupBy("author").agg(F.count("*").alias("cnt"))
            .orderBy(F.desc("cnt"), F.col("author").asc_nulls_last()).limit(limit))


def list_by_author(notes):
    """Articles under their author, authors ascending (D4): one row per article."""
    return notes.select("author", "id", "title").orderBy(F.col("author").asc_nulls_first(), "id")


def tag_counts(notes, tags="vault_tags", containing=None):
    """Articles per tag (D5); ``containing`` restricts to tags that hold a text."""
    rows = exploded(notes, [], tags, "tag")
    if containing:
        rows = rows.filter(F.contains("tag", F.lit(containing)))
    return rows.groupBy("tag").agg(F.count("*").alias("cnt"))


def with_tag(notes, part, tags="vault_tags"):
    """One row per article and tag for articles with a tag that holds a text."""
    return (exploded(notes, ["id"], F.when(F.exists(tags, lambda t: F.contains(t, F.lit(part))), F.col(tags)), "tag"))


def calendar(notes, as_of=None, days=None):
    """Articles per publication day, of all time or the last days."""
    rows = notes.filter("publish_time IS NOT NULL")
    if days:
        rows = rows.filter(F.col("publish_time") >= dates.days_before(as_of, days))
    return rows.groupBy(dates.day("publish_time").alias("day")).agg(F.count("*").alias("cnt"))


def latest(notes, limit=20, score=None):
    """Newest articles with grade (D7).  ``score`` grades articles that aren't graded yet,
    after the cut."""
    newest = notes.orderBy(*_newest()).limit(limit)
    return (score(newest) if score else newest).select("id", "title", "author", "publish_time", "grade")


def best(notes, grade="A", limit=10):
    """Best articles of a grade.

    The grade leads the sort and is tested behind the limit: a filter in front would be
    pushed below the score's projections and compute every metric twice.
    """
    top = notes.select("id", "title", "author", "publish_time", "overall", "grade").orderBy(
        (F.col("grade") == grade).desc(), F.desc("overall"), F.desc("id")).limit(limit)
    return top.filter(F.col("grade") == grade)


def of_author(notes, author):
    """Articles of one author, newest first."""
    return notes.filter(F.col("author") == author).select(
        "id", dates.day("publish_time").alias("day"), "grade", "overall").orderBy(F.desc("day"), "id")


def author_tags(notes, n=10, tags="vault_tags"):
    """Most frequent tags of every author."""
    counts = exploded(notes, ["author"], tags, "tag").groupBy("author", "tag").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("author").orderBy(F.desc("cnt"), "tag")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
