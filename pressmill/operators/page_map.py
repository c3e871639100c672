"""Deep pages of the article list without sorting what is skipped (Q1).

``build`` numbers the rows in the order of the list and stores every n-th one as a mark: its number and its
place in the order.  A page lies between two marks, so an offset becomes a range of the order: only the rows between the marks
are sorted, however far down they are.  The map is small (one row per ``every`` articles) and serves until the
articles change; new articles come first, so a map of articles up to a day stays right for what lies behind it.

Rows that are equal in the order (repeated ids) share a place, and a mark is the first of them, so no row is shown twice or
left out.  Null dates and ids come last; an empty table has no marks and empty pages.
"""

from pyspark.sql import functions as F

from pressmill.operators.browse import by_account, newest_first, preview
from pressmill.operators.numbering import number_rows
from pressmill.session import new_shared_path

EVERY = 1_000
ORDER = ("publish_time", "crawl_time", "id")


def build(df, every=EVERY, accounts=False, path=None):
    """Store the marks of the list of all articles, or of the list of every account; returns them."""
    group = ["account_name"] if accounts else []
    numbered = number_rows(df.select(*ORDER, *group), newest_first(), "_n", group)
    places = numbered.groupBy(*ORDER, *group).agg(F.min("_n").alias("first"), F.max("_n").alias("last"))
    # Of numbers 1, every + 1, 2 * every + 1 ... one falls on the place.
    marks = places.filter(F.expr(f"((last - 1) DIV {every}) * {every} + 1 >= first")).select(*ORDER, *group, F.col("first").alias("row_no"))
    path = path or new_shared_path(df.sparkSession, "page-map")
    marks.write.parquet(path)
    return df.sparkSession.read.schema(marks.schema).parquet(path)


def _from(mark):
    """Rows at a mark or behind it in the order of the list."""
    at_or_behind = F.lit(True)
    for name in reversed(ORDER):
        c, value = F.col(name), mark[name]
        if value is None:
            at_or_behind = c.isNull() & at_or_behind
        else:
            at_or_behind = F.coalesce(c < F.lit(value), F.lit(True)) | (c.eqNullSafe(F.lit(value)) & at_or_behind)
    return at_or_behind


def page(df, marks, account=None, limit=20, offset=0):
    """The rows of ``browse.page`` (Q1, Q2), read between two marks of ``build`` (``accounts=True`` where an account is given)."""
    limit, offset = max(1, min(limit, 100)), max(offset, 0)
    marks = marks.filter(F.col("account_name") == account) if account else marks
    # The last mark at or before the first row wanted, and the first one behind the last row wanted.
    first = marks.filter(F.col("row_no") <= offset + 1).orderBy(F.desc("row_no")).limit(1)
    last = marks.filter(F.col("row_no") > offset + limit).orderBy("row_no").limit(1)
    ends = sorted(first.unionByName(last).collect(), key=lambda m: m["row_no"])   # at most two
    rows = by_account(df, account)
    begun = [m for m in ends if m["row_no"] <= offset + 1]
    if not begun:
        return preview(rows.filter(F.lit(False)))
    rows = rows.filter(_from(begun[0]))
    for mark in ends[len(begun):]:
        rows = rows.filter(~_from(mark))
    return preview(rows).orderBy(*newest_first()).offset(offset + 1 - begun[0]["row_no"]).limit(limit)
