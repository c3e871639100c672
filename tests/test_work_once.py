"""Work that plans must not repeat, and its rows."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.operators import etl, substring_index

COLUMNS = "id long, title string, url string, author string, introduce string, full_content string, episode string, time string"
BODY = "Above\nLead https://e.org/1 x\nAnn: remark\nhttps://e.org/2\nBorrowed\nBob: said\nmore\n\nhttps://e.org/3 tail\nlast"


def test_split_cuts_lines_once_and_repairs_urls_before_filters(spark):
    rows = [(1, fv.COLLECTION_MARKER, "https://e.org/own", "me", BODY, "", "", ""), (2, "plain", "htps://e.org/p", "me", BODY, "", "", ""),
            (3, fv.COLLECTION_MARKER, None, None, None, None, "", "")]
    usable = etl.merged_layout(etl.process_dump(spark.createDataFrame(rows, COLUMNS), "2024-01-01"))
    found = usable.orderBy("id", "sub_pos").collect()
    assert [(r["id"], r["sub_pos"], r["title"], r["url"], r["author"], r["full_content"]) for r in found] == [
        (1, 0, "Lead", "https://e.org/1", "Ann", "remark"),
        (1, 1, "Ann: remark", "https://e.org/2", "Bob", "Borrowed\nsaid\nmore"),
        (1, 2, "more", "https://e.org/3", "me", "last"),
        (2, 0, "plain", "https://e.org/p", "me", BODY)]
    plan = usable._jdf.queryExecution().optimizedPlan().toString()
    # The text is cut at URLs once and every gap into lines once; one repair serves filter and result.
    assert plan.count("split(") == 2
    assert plan.count(fv.SCHEME_TYPOS[0][0]) == 1


def test_trigrams_leave_a_task_as_lists(spark, tmp_path):
    rows = [(i, "abcDE", "bcde\U0001F600x" if i % 2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, title string, content string").coalesce(1)
    index = substring_index.build(df, f"{tmp_path}/i")
    assert substring_index._grams(index.articles()).count() == 5      # not one row per article and trigram
    keys = {r["gram"]: r["keys"] for r in index.postings(["abc", "bcd", "cde", "de\U0001F600", "e\U0001F600x"]).collect()}
    everything = sorted(r[0] for r in index.articles().select(substring_index.KEY).collect())
    odd = sorted(r[0] for r in index.articles().filter(F.col("id") % 2 == 1).select(substring_index.KEY).collect())
    assert keys == {"abc": everything, "bcd": everything, "cde": everything, "de\U0001F600": odd, "e\U0001F600x": odd}


def test_lists_are_sent_before_they_grow_long(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"title {i}", "body") for i in range(60)], "id long, title string, content string").coalesce(2)
    monkeypatch.setattr(substring_index, "PAIRS", 50)
    index = substring_index.build(df, f"{tmp_path}/i")
    assert substring_index._grams(index.articles()).filter("gram = 'bod'").count() > 2
    assert sorted(k for r in index.postings(["bod"]).collect() for k in r["keys"]) == sorted(r[0] for r in index.articles().select(substring_index.KEY).collect())
