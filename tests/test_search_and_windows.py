"""Trigram search and trends over windows, on rows derived by hand and against full scans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressmill.operators import browse, substring_index, trend_windows, trends

TYPES = "id long, url string, title string, content string, author string, account_name string, publish_time timestamp_ntz, crawl_time timestamp_ntz"


def articles(spark, rows):
    """Rows of (id, title, content) and more fields by name."""
    made = []
    for row_id, title, content, *rest in rows:
        more = rest[0] if rest else {}
        made.append((row_id, f"https://example.com/{row_id}", title, content, more.get("author", "a"), "a", more.get("publish_time"),
                     more.get("crawl_time", dt.datetime(2024, 1, 10))))
    return spark.createDataFrame(made, TYPES)


TEXTS = [
    (1, "Apache License", "text"), (2, "x", "the LICENSE of apache"), (3, None, None), (4, "", ""), (5, "ab", "abcab"), (6, "abc", None),
    (7, "用大模型写", "é Éa 100% _under"), (8, "😀😀 face", "tail 😀x😀"), (None, "no id, license", "y"), (9, "same", "twin"), (9, "same", "twin"),
    (10, "long", "z" * 99_999 + "needle" + "z" * 150_000 + "Needle of the end"), (11, "lic ense", "li cense"), (12, "bac", "cab abd"),
    (13, "back\\slash", "a.c a+c (x)"), (14, "line\nbreak", "li\nc"),
]


@pytest.mark.parametrize("pattern", [
    "license", "LICENSE", "lic_nse%ap", "abc", "ab", "a", "", "%", "needle", "needle of", "zneedlez", "大模型", "模型", "😀😀", "😀x😀", "Éa ", "100%", "twin", "k\\s",
    "a.c", "a+c (x", "line\nb", "nothing like it", "li%break", "cab abd", "zzz",
])
def test_search_by_trigrams(spark, indexed, pattern):
    index, df = indexed
    def key(rows):
        return sorted((str(r["id"]), r["title"] or "", len(r["content"] or "")) for r in rows.select("id", "title", "content").collect())
    assert key(index.matches(pattern)) == key(browse.search_matches(df, pattern))


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    df = articles(spark, TEXTS).repartition(5)
    return substring_index.build(df, f"{tmp_path_factory.mktemp('index')}/i"), df


def test_search_joins_where_many_match(spark, tmp_path, monkeypatch):
    df = articles(spark, [(i, f"title {i}", "common words " * (i % 3)) for i in range(60)]).repartition(4)
    index = substring_index.build(df, f"{tmp_path}/i")
    monkeypatch.setattr(substring_index, "NAMED", 5)
    for pattern in ("common", "title 1", "title 59"):
        assert sorted(r["id"] for r in index.matches(pattern).collect()) == sorted(r["id"] for r in browse.search_matches(df, pattern).collect())
    assert [r["id"] for r in index.search("common", 7).collect()] == [r["id"] for r in browse.search(df, "common", 7).collect()]


def test_search_reads_few_files(spark, tmp_path):
    df = articles(spark, [(i, f"title {i}", f"body number{i:04d} " + "filler " * 50) for i in range(400)]).repartition(16, "id")
    index = substring_index.build(df, f"{tmp_path}/i")
    found = index.matches("number0123")
    assert [r["id"] for r in found.collect()] == [123]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert substring_index.SHELF in scan.split("PartitionFilters")[1]
    # One shelf of 16 holds it, and the postings are read from the folders of its trigrams only.
    def read(rows):
        metrics = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
        return metrics.apply("numFiles").value()
    assert 1 <= read(found) <= 2 < 16 <= len(index.articles().inputFiles())
    grams = substring_index.pattern_grams("number0123")
    postings = index.postings(grams)
    postings.collect()
    assert 1 <= read(postings) <= 16 * len(grams) and read(postings) < len(postings.inputFiles())


def test_search_of_an_empty_table(spark, tmp_path):
    index = substring_index.build(articles(spark, TEXTS).limit(0), f"{tmp_path}/i")
    assert index.matches("license").count() == 0 and index.matches("a").count() == 0
    assert index.matches("license").columns == [c.split()[0] for c in TYPES.split(", ")]


def test_pattern_grams():
    assert substring_index.pattern_grams("ABcd%x_yz") == ["abc", "bcd"]
    assert substring_index.pattern_grams("a%b") == []


DAY = dt.datetime(2024, 1, 31, 5)
WINDOWED = [
    (1, "ai", "ai notes", {"crawl_time": DAY, "publish_time": dt.datetime(2024, 1, 5)}),
    (2, "git", "git and ai", {"crawl_time": DAY - dt.timedelta(days=10), "author": "b"}),
    (3, None, None, {"crawl_time": DAY - dt.timedelta(days=60), "author": None}),
    (4, "ai", "", {"crawl_time": dt.datetime(2024, 1, 25), "author": "b", "publish_time": dt.datetime(2024, 1, 5, 23)}),
    (5, "git", "x", {"crawl_time": dt.datetime(2024, 1, 24, 23, 59), "author": "Unknown"}),
    (6, "ai", "gone", {"crawl_time": dt.datetime(2020, 1, 1)}), (7, "ai", "no time", {"crawl_time": None}),
]
LEXICON = ["ai", "git"]
AS_OF = "2024-02-01 00:00:00"


def test_windows_equal_the_reports_of_each(spark, tmp_path):
    df, path = articles(spark, WINDOWED), f"{tmp_path}/facts"
    # The second batch is late, and sent twice.
    for name, rows in (("one", df.filter("id % 2 = 0")), ("two", df.filter("id % 2 = 1")), ("two", df.filter("id % 2 = 1"))):
        trend_windows.write_facts(rows, path, name, lexicon=LEXICON)
    facts = trend_windows.read_facts(spark, path)
    top, daily, authors = (f(facts, AS_OF) for f in (trend_windows.top_keywords, trend_windows.daily_keywords, trend_windows.author_stats))
    for days in (7, 30, 90):
        def same(windowed, plain, *columns):
            rows = windowed.filter(F.col("days") == days).select(*columns).collect()
            assert sorted(map(tuple, rows)) == sorted(map(tuple, plain.select(*columns).collect()))
        same(top, trends.top_keywords(df, AS_OF, days, lexicon=LEXICON), "keyword", "cnt", "percentage")
        same(daily, trends.daily_keywords(df, AS_OF, days, lexicon=LEXICON), "day", "keyword", "cnt")
        pairs = trends.author_keyword_counts(df, AS_OF, days, lexicon=LEXICON)
        same(authors, trends.author_stats(pairs, days), "author", "article_count", "total_words", "keyword_diversity", "influence_score", "productivity")
    assert [r["rank"] for r in top.filter("days = 90").orderBy("rank").collect()] == [1, 2]


def test_windows_read_their_days_only(spark, tmp_path):
    path = f"{tmp_path}/facts"
    trend_windows.write_facts(articles(spark, WINDOWED), path, "all", lexicon=LEXICON)
    week = trend_windows.top_keywords(trend_windows.read_facts(spark, path), AS_OF, (7,))
    assert {(r["keyword"], r["cnt"]) for r in week.collect()} == {("ai", 2)}
    assert "day" in week._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]


def test_windows_of_no_articles(spark, tmp_path):
    trend_windows.write_facts(articles(spark, WINDOWED).limit(0), f"{tmp_path}/facts", "none", lexicon=LEXICON)
    facts = trend_windows.read_facts(spark, f"{tmp_path}/facts")
    assert trend_windows.top_keywords(facts, AS_OF).count() == trend_windows.author_stats(facts, AS_OF).count() == 0
