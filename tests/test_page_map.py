"""Deep pages by marks against the sorted list."""

import datetime as dt

import pytest

from pressmill.operators import browse, page_map

TYPES = "id long, url string, title string, content string, author string, account_name string, publish_time timestamp_ntz, crawl_time timestamp_ntz"


def row(i, row_id, day=None, hour=None, account="a"):
    return (row_id, f"u{i}", f"t{i}", "c" * i, "x", account, day and dt.datetime(2024, 1, day), hour and dt.datetime(2024, 2, 1, hour))


ROWS = ([row(i, i, 1 + i % 5, 1 + i % 3, "ab"[i % 2]) for i in range(23)] + [row(30 + i, 100 + i, None, 1 + i % 3) for i in range(7)]
        + [row(40 + i, 200 + i, None, None, "b") for i in range(4)] + [row(50 + i, 7, 3, 2) for i in range(6)] + [row(60, None, 2, 1), row(61, None, None, None)])


def keys(rows):
    return [(r["publish_time"], r["crawl_time"], r["id"]) for r in rows.select("publish_time", "crawl_time", "id").collect()]


@pytest.mark.parametrize("every", [1, 4, 1000])
@pytest.mark.parametrize("account", [None, "b"])
def test_pages_are_those_of_the_sorted_list(spark, every, account):
    df = spark.createDataFrame(ROWS, TYPES).repartition(3)
    marks = page_map.build(df, every=every, accounts=account is not None)
    every_row = keys(browse.by_account(df, account).orderBy(*browse.newest_first()))
    assert marks.count() <= len(ROWS) // every + (2 if account else 1)
    for offset, limit in [(0, 3), (2, 9), (11, 12), (len(every_row) - 2, 5), (len(every_row) + 3, 5)]:
        assert keys(page_map.page(df, marks, account, limit, offset)) == every_row[offset:offset + limit]


def test_pages_show_every_row_once(spark):
    """Repeated ids too: seven rows share a place, on which marks fall."""
    df = spark.createDataFrame(ROWS, TYPES).repartition(3)
    marks = page_map.build(df, every=3)
    # All rows of one place on one page, as equal rows have no order of their own.
    assert sorted(r["url"] for r in page_map.page(df, marks, limit=100).collect()) == sorted(r[1] for r in ROWS)


def test_no_articles(spark):
    df = spark.createDataFrame([], TYPES)
    marks = page_map.build(df)
    assert marks.count() == 0 and page_map.page(df, marks, offset=5).count() == 0
