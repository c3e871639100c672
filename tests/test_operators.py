"""Hand-derived rows: boundaries, defaults, order rules and rendered notes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill import schema
from pressmill.functions import dates, urls
from pressmill.functions import text as tx
from pressmill.operators import etl, export, html, jobs, links, notes, quality, tags, trends
from pressmill.operators.numbering import number_rows
from pressmill.sources import dumps, files, large_dumps


def values(spark, rows, expression, name="v"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col(name))).collect()]


def article(spark, **fields):
    base = {"id": 1, "url": "https://example.com/1", "title": "t", "content": "", "author": "a", "account_name": "a",
            "publish_time": None, "crawl_time": dt.datetime(2024, 1, 10)}
    rows = fields.pop("rows", [fields])
    types = "id long, url string, title string, content string, author string, account_name string, publish_time timestamp_ntz, crawl_time timestamp_ntz"
    return spark.createDataFrame([tuple({**base, **r}[c.split()[0]] for c in types.split(", ")) for r in rows], types)


@pytest.mark.parametrize("content,expected", [
    ("用ai写", set()), ("use ai now", {"ai"}), ("été-ai", {"ai"}), ("use c++ now", set()), ("c++x", {"c++"}),
    ("Foo.bar a-b-c use_case x_y_z", {"Foo.bar", "a-b", "use_case"}), ("GitHub Actions", {"github", "github actions"}),
    ("next.js and zk-snark", {"next.js", "zk-snark"}), ("我们 大模型 好", {"大模型"}),
])
def test_keywords(spark, content, expected):
    row = trends.with_keywords(article(spark, title="-", content=content)).first()
    assert set(row["keywords"]) == expected


def test_clean_content(spark):
    got = values(spark, ["a\n\n\nb", "x====y", "  　a　 ", "前 点击下方\n阅读原文，查看更多 后", None],
                 lambda c: tx.clean_content(c))
    assert got == ["ab", "xy", "a", "前 更多 后", None]


def test_episode(spark):
    titles = ["X #12", "第 7 期", "Vol. 3", "(5)", "【6】 y", "x", "vol 8 #9"]
    assert values(spark, titles, tx.episode) == ["#12", "#7", "#3", "#5", "#6", "", "#9"]
    assert values(spark, ["X #12 end", "plain"], tx.title_without_episode) == ["X end", "plain"]


def test_summary(spark):
    late, early = "a" * 150 + "。" + "b" * 59, "a" * 100 + "。" + "b" * 109
    df = spark.createDataFrame([(late,), (early,), ("short",)], "cleaned string")
    got = [r["introduce"] for r in tx.with_summary(df).collect()]
    assert got == [late[:151], early[:200] + "...", "short"]


def test_fix_url(spark):
    cases = {
        "中文版：http://a.com": "http://a.com", "htps://a.com": "https://a.com", "a.com/x": "https://a.com/x",
        "https://a.com/中文": "https://a.com/", "/x.y": "/x.y", "": "", "see https://b.com x http://c.com": "https://b.com",
        "note:http://a.com:80": "http://a.com:80", "http://中": "", "ftp://a.b": "ftp://a.b", "hu.baittps://a.com": "https://a.com",
        "word": "word", "a：http://x：http://y": "http://x", "htp://a.com": "http://a.com",
    }
    assert values(spark, list(cases), urls.fixed_url) == list(cases.values())


def test_truncate_and_names(spark):
    a, b = "x" * 70 + " " + "y" * 19, "x" * 60 + " " + "y" * 29
    assert values(spark, [a, b, "ok"], lambda c: tx.truncate_words(c, 80)) == ["x" * 70 + "...", b[:80] + "...", "ok"]
    assert values(spark, ['a<b>:c', "", None], tx.file_name) == ["abc", "untitled", "untitled"]


def test_links(spark):
    url = "https://mp.weixin.qq.com/s/a?scene=1"
    assert values(spark, [url], urls.is_history_link) == [False]
    assert values(spark, [url, None], urls.is_discovery_link) == [True, False]
    assert values(spark, ["https://x/Error", "https://x"], urls.is_error_url) == [True, False]
    base = F.lit("https://h.com/a/b.html?q")
    refs = ["/i.png", "c.png", "../d.png", "//k.com/e", "https://z/f", "?x=1"]
    assert values(spark, refs, lambda c: urls.absolute_url(base, c)) == [
        "https://h.com/i.png", "https://h.com/a/c.png", "https://h.com/d.png", "https://k.com/e", "https://z/f", "https://h.com/a/b.html?x=1"]


def test_series(spark):
    df = spark.createDataFrame([("S #9",), ("S (9)",), ("S 第9期",), ("S vol.9",), ("S",)], "title string")
    got = [(r["series_type"], r["series_name"], r["series_number"]) for r in links.with_series(df).collect()]
    assert got == [("hash_number", "S", 9), ("parentheses_number", "S", 9), ("episode_number", "S", 9), ("volume_number", "S", 9), (None, None, None)]


def test_weeks_and_series(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6),), (dt.datetime(2024, 1, 7),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(dates.sunday_week("t")).collect()] == ["2024-W00", "2024-W01"]
    days = [(1, 2), (2, 1), (3, 3)]
    rows = [{"id": d * 10 + i, "publish_time": dt.datetime(2024, 1, d, 5)} for d, n in days for i in range(n)]
    counts = trends.period_counts(trends.hourly_counts(article(spark, rows=rows), "2024-02-01 00:00:00"))
    got = trends.cumulative_series(counts).orderBy("day").collect()
    assert [(r["cnt"], r["cumulative"]) for r in got] == [(2, 2), (1, 3), (3, 6)]


def test_growth(spark):
    rows = [{"id": d * 10 + i, "title": "rust", "publish_time": dt.datetime(2024, 1, d)} for d, n in [(1, 1), (2, 1), (3, 2), (4, 4)] for i in range(n)]
    df = article(spark, rows=rows)
    assert trends.keyword_growth(df, "RUST", "2024-02-01 00:00:00").first()["growth_rate"] == 200.0
    assert trends.keyword_growth(df, "none", "2024-02-01 00:00:00").first()["growth_rate"] == 0


def test_influence_and_null_dates(spark):
    rows = [{"id": i, "title": "x", "content": "gpt llm rust git".ljust(300, ".")} for i in (1, 2)]
    df = article(spark, rows=rows + [{"id": 3, "author": "Unknown"}, {"id": 4, "author": None}])
    pairs = trends.author_keyword_counts(df, "2024-02-01 00:00:00")
    stats = trends.author_stats(pairs).collect()
    assert [(r["author"], r["article_count"]) for r in stats] == [("a", 2)]
    assert stats[0]["influence_score"] == pytest.approx(2.9)
    assert trends.author_active_month(df, "2024-02-01 00:00:00").first()["most_active_period"] == "未知"


def test_tagging(spark):
    row = tags.with_tags(article(spark, title="gpt", content="llm and rust")).first()
    by_name = {t["name"]: t for t in row["tags"]}
    assert (by_name["ai_ml"]["confidence"], by_name["ai_ml"]["frequency"]) == (2.4 / 5, 2)
    assert {"backend", "blockchain", "ai_ml"} <= set(by_name)
    assert row["main_category"] == "ai_ml" and row["difficulty"] == "beginner" and row["content_type"] == "article"


def test_grade_and_minutes(spark):
    df = spark.createDataFrame([(0.8,), (0.6,), (0.4,), (0.39,)], "s double")
    assert [r[0] for r in df.select(quality.grade(F.col("s"))).collect()] == ["A", "B", "C", "D"]
    rows = [{"id": i, "content": "x" * n} for i, n in enumerate((199, 400, 599))]
    assert [r["reading_time"] for r in quality.with_quality(article(spark, rows=rows)).orderBy("id").collect()] == [1, 2, 2]


def test_round_score(spark):
    import random

    from pressmill.functions.numbers import round_score
    random.seed(1)
    xs = [k / 1000 for k in range(1001)] + [random.random() for _ in range(500)] + [0.44499999999999995]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_score(F.col("x")).alias("r"))
    assert [r for r in df.collect() if r["r"] != round(r["x"], 2)] == []


def test_structure_and_paragraphs(spark):
    content = "# H\n\n\n- a\n1. b\n`x` ![i](u) ```c```\n\n \n\nend?"
    row = quality.with_metrics(article(spark, content=content)).first()
    # heading 2, number 1, list 1, block 1, inline 3, link 1, image 1 (two patterns overlap by design)
    import re
    pats = [r"#+\s+", r"\d+\.\s+", r"[-*]\s+", r"```[\s\S]*?```", r"`[^`]+`", r"\[.*?\]\(.*?\)", r"!\[.*?\]\(.*?\)"]
    n = sum(len(re.findall(p, content)) * (2 if i == 0 else 1) for i, p in enumerate(pats))
    assert row["structure"] == pytest.approx(min(n / (len(content) / 1000) / 5, 1.0))
    assert row["engagement"] == pytest.approx(1 / 3 / 5)


NOTES = [
    ("Probly", "jing\nProbly 是一款智能电子表格工具，类似 Excel 但功能更强大，集成了 AI 技术，可快速分析数据并自动生成图表，简化数据处理的全流程。\nsocial-media-agent",
     95, 0.43, "C", ["account/dan", "author/dan", "category/general", "difficulty/beginner", "length/short", "month/2025-07", "quality/C", "tech/ai", "year/2025"]),
    ("mac-storage-manager", "dan\nmac-storage-manager是一款跨平台Shell工具，帮助用户在macOS和Linux上清理磁盘空间。它能识别大型应用，计算应用大小，并通过交互式界面安全删除应用及其关联文件，支持Homebrew包管理和选择性文件删除功能。",
     122, 0.32, "D", ["account/dan", "author/dan", "category/general", "difficulty/beginner", "length/short", "month/2025-07", "quality/D", "year/2025"]),
]


@pytest.mark.parametrize("title,content,chars,score,grade,expected", NOTES)
def test_rendered_notes(spark, title, content, chars, score, grade, expected):
    df = article(spark, title=title, content=content, author="dan", account_name="dan", publish_time=dt.datetime(2025, 7, 18, 16, 2, 1))
    row = export.vault_tags(quality.with_quality(tags.with_tags(df))).first()
    assert (row["word_count"], round(row["overall"], 2), row["grade"], row["vault_tags"]) == (chars, score, grade, expected)


def test_dump_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"export_info": {"source": "API"}, "articles": [{"id": 1, "attributes": {"title": " t ", "url": "u", "time": "2025-01-15"}}]}')
    (tmp_path / "b.json").write_text('{"articles": [\n{"title": "s", "content": "c", "publish_time": "x"}\n]}')
    dump = dumps.read_dump_files(spark, str(tmp_path))
    got = {(r["file"], r["title"], r["introduce"], r["time"]) for r in dumps.normalise(dumps.dump_articles(dump)).collect()}
    assert got == {("a.json", "t", "", "2025-01-15"), ("b.json", "s", "c", "x")}
    assert {(r["source"], r["article_count"]) for r in dumps.dump_headers(dump).collect()} == {("API", 1), ("Unknown", 1)}


def test_dedup_keys(spark):
    rows = [(0, 1, "u", "a", "x"), (1, 2, "u", "b", "y"), (0, 3, "", "", ""), (0, 4, None, "t", None)]
    df = spark.createDataFrame(rows, "file_no int, id long, url string, title string, author string").withColumn("episode", F.lit(""))
    assert sorted(r["id"] for r in etl.dedup(df, "url", ["file_no", "id"]).collect()) == [1, 4]


def test_removal_reasons(spark):
    df = spark.createDataFrame([(" ", "u", "tt"), ("a", None, "tt"), ("a", "u", "t"), ("a", "u", "tt")], "author string, url string, title string")
    assert [r["reason"] for r in etl.with_removal_reason(df).collect()] == ["empty_author", "empty_url", "empty_values", None]


def test_collection(spark):
    text = "First https://a.com/1\nAnn: good\nmore\n\nTitle two\nhttps://a.com/2\nbody"
    df = spark.createDataFrame([(1, "Web3 极客日报", "https://o", "P", text), (2, "other", "https://o", "P", text)],
                               "id long, title string, url string, author string, content string")
    got = [(r["id"], r["sub_title"], r["sub_url"], r["sub_author"], r["sub_content"])
           for r in etl.split_collections(df, "content").orderBy("id", "sub_pos").collect()]
    assert got == [(1, "First", "https://a.com/1", "Ann", "good\nmore\nTitle two"),
                   (1, "Title two", "https://a.com/2", "P", "body"), (2, "other", "https://o", "P", text)]


def test_numbering_of_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"))
    got = number_rows(df, [F.col("id").desc()], out="no", group=["g"])
    hot = [r["no"] for r in got.filter("g = 'hot'").orderBy(F.desc("id")).collect()]
    assert hot == list(range(1, 1001)) and got.filter("g <> 'hot' AND no <> 1").count() == 0
    flat = number_rows(df, [F.col("id").desc()], out="no")
    assert flat.filter("no <> 3000 - id").count() == 0


def test_numbering_leaves_other_columns_alone(spark):
    seen = spark.sparkContext.accumulator(0)

    def costly(v):
        seen.add(1)
        return v
    df = spark.range(100).withColumn("body", F.udf(costly, "long")("id"))
    assert number_rows(df, [F.col("id")], out="no").agg(F.sum("body"), F.max("no")).first()[:] == (4950, 100)
    assert seen.value == 100


def test_numbering_of_null_and_repeated_keys(spark):
    rows = [(1, "a"), (None, "b"), (2, "c"), (2, "d"), (None, "e"), (2, "c")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "id long, t string, _place int")
    got = number_rows(df, [F.col("id").asc_nulls_last()], out="no").orderBy("no").collect()
    assert sorted(r["no"] for r in got) == [1, 2, 3, 4, 5, 6] and {r["_place"] for r in got} == {7}
    assert [r["id"] for r in got] == [1, 2, 2, 2, None, None]
    assert sorted((r["id"] or 0, r["t"]) for r in got) == sorted((i or 0, t) for i, t in rows)
    by_id = number_rows(df, [F.col("t")], out="no", group=["id"]).collect()
    assert sorted((r["id"] or 0, r["no"]) for r in by_id) == [(0, 1), (0, 2), (1, 1), (2, 1), (2, 2), (2, 3)]
    assert number_rows(df.filter("false"), [F.col("id")]).count() == 0


def test_split_parts_have_numbers_of_their_own(spark):
    df = spark.createDataFrame([(9, 0, "x"), (9, 0, "y"), (None, 0, "z"), (12, 1, "w")], "id long, file_no int, url string")
    got = etl.renumber(df, [F.col("file_no"), F.col("url")]).orderBy("new_id").collect()
    assert [(r["new_id"], r["url"]) for r in got] == [(1, "w"), (2, "x"), (3, "y"), (4, "z")]


def test_landed_pages_without_a_page_number(spark, tmp_path):
    page = '{"data": [%s, %s], "meta": {"pagination": {"pageCount": 3, "total": 250}}}'
    (tmp_path / "page-10.json").write_text(page % ('{"id": 7, "attributes": {"title": "G"}}', '{"attributes": {"title": "H"}}'))
    (tmp_path / "page-2.json").write_text(page % ('{"attributes": {"title": "A"}}', '{"id": null, "attributes": {"title": "B", "url": "u"}}'))
    rows = dumps.api_items(dumps.read_api_pages(spark, str(tmp_path))).collect()
    assert sorted((r["id"], r["title"], r["url"]) for r in rows) == [(1, "A", ""), (2, "B", "u"), (4, "H", ""), (7, "G", "")]


def test_many_parent_segments(spark):
    base = "https://h.com/" + "/".join("abcdefghijklmn") + "/page"
    here = F.lit(base)
    assert values(spark, ["../" * 12 + "i.png", "../" * 30 + "i.png", "./x/../y/", "z/.."], lambda c: urls.absolute_url(here, c)) == [
        "https://h.com/a/b/i.png", "https://h.com/i.png", base[:-4] + "y/", base[:-4]]


def test_link_lists(spark):
    page = """<p data-role="recommend"><a href="https://mp.weixin.qq.com/s/r">R</a></p><a href="https://other.org/s/a">no</a>
    <a href="https://mp.weixin.qq.com/s/a">yes</a><script>var related_article_list = [{url: "u1", title: "x [1]; y"}, {url: 'u2'}]; var t = [];</script>"""
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [r[:] for r in links.script_links(df).select("list", "pos", "url", "title", "source").orderBy("list", "pos").collect()] == [
        (0, 0, "u1", "x [1]; y", "js_related_articles"), (0, 1, "u2", "", "js_related_articles"),
        (3, 0, "https://mp.weixin.qq.com/s/r", "R", "js_recommendations")]
    assert [r["title"] for r in links.content_links(df).orderBy("pos").collect()] == ["R", "yes"]


def test_late_article_is_stored(spark, tmp_path):
    from pressmill.streaming import ingest

    kind = "url string, id long, crawl_time timestamp_ntz"
    for day, url in ((20, "a"), (21, "b"), (1, "late"), (22, "a")):
        row = spark.createDataFrame([(url, day, dt.datetime(2024, 1, day))], kind)
        row.write.mode("append").parquet(f"{tmp_path}/landed")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/landed")
        ingest.ingest_stream(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint", lambda rows: ["id"]).awaitTermination()
    assert sorted((r["url"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [("a", 20), ("b", 21), ("late", 1)]


def test_page_after_a_row(spark):
    from pressmill.operators import browse

    day = dt.datetime(2024, 1, 5)
    rows = [{"id": i, "publish_time": None if i % 4 == 0 else day + dt.timedelta(days=i % 3)} for i in range(1, 21)]
    df = article(spark, rows=rows)
    every = browse.page(df, limit=100).collect()
    last = every[6]
    got = browse.page(df, limit=5, after=(last["publish_time"], last["crawl_time"], last["id"])).collect()
    assert [r["id"] for r in got] == [r["id"] for r in every[7:12]]
    last = every[17]
    assert [r["id"] for r in browse.page(df, after=(last["publish_time"], last["crawl_time"], last["id"])).collect()] == [r["id"] for r in every[18:]]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from pressmill.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    def session(master):
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("local[2]"))


def test_jobs_fail_by_exceptions_only(spark):
    rows = [("none saved", 1, False, None), ("broken", 1, True, None), ("broken", 3, True, "second"), ("broken", 2, False, "first")]
    df = spark.createDataFrame(rows, "batch string, seq long, ok boolean, error string").withColumn("ts", F.col("seq"))
    got = {r["batch"]: (r["status"], r["error_message"], r["crawled_articles"]) for r in jobs.batch_outcomes(df).collect()}
    assert got == {"none saved": ("completed", None, 0), "broken": ("failed", "first", 2)}


def test_endpoints(spark):
    rows = [("h", 1, i, ok) for i, ok in enumerate([False, True, True, True])] + [("k", 1, i, False) for i in range(6)]
    df = spark.createDataFrame(rows, "host string, port int, seq int, ok boolean").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,seq)"))
    state = {r["host"]: (r["success_count"], r["failure_count"], r["is_alive"]) for r in jobs.endpoint_state(df).collect()}
    assert state == {"h": (3, 0, True), "k": (0, 6, False)}
    assert {r["host"]: r["reliability"] for r in jobs.endpoint_reliability(df).collect()} == {"h": 0.75, "k": 0.0}
    one = spark.range(1).select(jobs.reliability(F.lit(0), F.lit(0)).alias("r")).first()["r"]
    assert one == 0.5


def test_page(spark):
    page = """<h1 id="activity-name"> A <b>B</b>&amp;C</h1><span id="js_author_name">作者：Zed</span><strong id="profileBt"><a>Acc</a></strong>
    <em id="publish_time">2024年3月5日</em><div class="x rich_media_content"><div>one<script>no()</script></div><p>two &lt;3<img src="p.png">
    <img data-src="/q.png"><!-- c --></p></div><div>out</div>"""
    df = spark.createDataFrame([(1, "https://h.com/a/b", page), (2, "https://h.com", "<p>captcha</p>"), (3, "https://h.com", "<h1>x</h1>")], "page_id long, url string, html string")
    rows = html.extract_articles(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["title"], r["author"], r["account_name"], r["publish_time"]) == ("AB&C", "Zed", "Acc", dt.datetime(2024, 3, 5))
    assert r["content"] == "one\ntwo <3" and r["images"] == ["https://h.com/a/p.png", "https://h.com/q.png"] and r["cover_image"] == "https://h.com/a/p.png"


def test_schema_has_unique_columns():
    assert len({f.name for f in schema.ARTICLES}) == len(schema.ARTICLES)
    assert len(fv.TREND_KEYWORDS) == len(set(fv.TREND_KEYWORDS))


def test_one_file_per_row(spark, tmp_path):
    rows = [("a b", "0001_é+100%.md", "text\nof one"), ("c", "0002_x.md", ""), ("c", "0003_y.md", None), ("c", "0004_z.md", "last\n")]
    df = spark.createDataFrame(rows, "folder string, file_name string, body string")
    files.write_files(df.repartition(3), str(tmp_path / "out"), "body", folder="folder")
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and p.name != "_SUCCESS" and p.suffix != ".crc"} == {
        f"{a}/{b}": c or "" for a, b, c in rows}
    back = {(r["folder"], r["file_name"]): r["text"] for r in files.read_files(spark, str(tmp_path / "out")).collect()}
    assert back[("a b", "0001_é+100%.md")] == "text\nof one" and back[("c", "0004_z.md")] == "last\n"
    assert not list((tmp_path / "out").glob("_staging*"))


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    df = spark.range(0, 40, 1, 4).select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("file_name"),
                                        F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("body"))
    with pytest.raises(Exception, match="broken"):
        files.write_files(df, str(tmp_path / "out"), "body")
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_related_by_a_tag_that_contains_the_first(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day, ["ai"]), (2, day + dt.timedelta(1), ["tech/ai", "x"]), (3, day + dt.timedelta(2), ["tech/ai", "ai-tools"]), (4, None, ["x"]), (5, day, [])]
    df = spark.createDataFrame(rows, "id long, publish_time timestamp_ntz, vault_tags array<string>")
    got = sorted((r["id"], r["rank"], r["related_id"]) for r in notes.related_by_first_tag(df, 2).collect())
    assert got == [(1, 1, 3), (1, 2, 2), (2, 1, 3), (3, 1, 2), (4, 1, 2)]


def test_large_dumps_are_cut_anywhere(spark, tmp_path):
    import json
    import random

    draw = random.Random(5)
    signs = ['"', "\\", "[", "]", "{", "}", ",", ":", " ", "\n", "a", "文", '"articles": [', "\\\\\""]

    def text():
        return "".join(draw.choice(signs) for _ in range(draw.randrange(30)))

    def articles(n):
        return [None if draw.random() < 0.1 else {"id": i, "attributes": {"title": text(), "full_content": text()}, "x": [1, [2, {"y": text()}]]}
                if draw.random() < 0.5 else {"id": i, "title": text(), "content": text()} for i in range(n)]

    cases = [{"export_info": {"source": text() + "s", "total": 3}, "articles": articles(40)}, {"articles": articles(5), "more": {"articles": [1, 2], "a": 1}},
             {"other": [{"articles": [{"id": 5}]}, 2], "articles": articles(9), "export_info": {"source": "late"}}, {"articles": []}, {"export_info": {"source": "x"}}, {}]
    for i, case in enumerate(cases):
        (tmp_path / f"d {i}.json").write_text(json.dumps(case, ensure_ascii=bool(i % 2), indent=i % 3 or None), encoding="utf-8")
    want = sorted((f"d {i}.json", n, (case.get("export_info") or {}).get("source"), (a or {}).get("id"), ((a or {}).get("attributes") or a or {}).get("title"))
                  for i, case in enumerate(cases) for n, a in enumerate(case.get("articles", [])))
    key = lambda r: r[:2]
    for part, chunk in [(7, 3), (50, 1000), (1 << 20, 64)]:
        got = large_dumps.read_large_dumps(spark, str(tmp_path), part_bytes=part, chunk_bytes=chunk)
        rows = got.select("file", "pos", "source", "id", F.coalesce("attributes.title", "title")).collect()
        assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    whole = dumps.dump_articles(dumps.read_dump_files(spark, str(tmp_path)))
    assert got.columns == whole.columns and sorted(map(repr, got.drop("file").collect())) == sorted(map(repr, whole.drop("file").collect()))
    # One file is read by several tasks.
    ranges = large_dumps.dump_ranges(spark, str(tmp_path), part_bytes=1000).filter("n > 0 AND path LIKE '%d 0.json'").collect()
    assert len(ranges) > 1 and sum(r["n"] for r in ranges) == 40


def test_texts_of_large_dumps_meet_no_join(spark, tmp_path):
    # Spark knows the size of the rows of ranges, not that of the texts read by them: it broadcast the texts.
    (tmp_path / "d.json").write_text('{"export_info": {"source": "s"}, "articles": [' + ", ".join(f'{{"id": {i}}}' for i in range(50)) + "]}")
    got = large_dumps.read_large_dumps(spark, str(tmp_path), part_bytes=20)
    assert sorted((r["id"], r["pos"], r["source"]) for r in got.collect()) == [(i, i, "s") for i in range(50)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    # Ranges stay with as many tasks as a shuffle has, though their rows are small.
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_written_files_are_listed_by_tasks(spark, tmp_path):
    rows = [("a+b c", "1 %41.md", "x\n"), ("a+b c", "2.md", "文"), ("d", "1.md", None), ("d", "_h.md", "no"), ("d", "3.txt", "no"), ("e/f", "1.md", "deep")]
    files.write_files(spark.createDataFrame(rows, "folder string, file_name string, text string"), str(tmp_path / "w"), "text", folder="folder")
    got = files.read_files(spark, str(tmp_path / "w"))
    assert sorted(map(tuple, got.collect())) == [("a+b c", "1 %41.md", "x\n"), ("a+b c", "2.md", "文"), ("f", "1.md", "deep")]
    assert not got.inputFiles()      # the driver lists none of them
    files.write_files(spark.createDataFrame([("1.md", "t")], "file_name string, text string"), str(tmp_path / "v"), "text")
    assert [tuple(r) for r in files.read_files(spark, f"file://{tmp_path}/v").collect()] == [("v", "1.md", "t")]


def test_quality_counts_without_lists_of_matches(spark):
    from pressmill.functions.text import strip

    spaces = [chr(i) for i in range(0x10000) if chr(i).isspace()]
    body = "".join(spaces) + "Ab cd1 ef. Gh!\u3000? ij" + "".join(spaces)
    df = spark.createDataFrame([(1, "t", body), (2, "t", " \u2003\n"), (3, None, None), (4, "", "")], "id long, title string, content string")
    assert {r["id"]: r["s"] for r in df.select("id", strip(F.col("content")).alias("s")).collect()} == {1: body.strip(), 2: "", 3: None, 4: ""}
    got = df.select("id", quality._tokens(F.col("content")).alias("n"), quality._count(F.col("content"), "[a-z]").alias("c")).collect()
    assert [(r["n"], r["c"]) for r in sorted(got) if r["id"] != 3] == [(6, 8), (0, 0), (0, 0)]
    counted = df.select(quality._count(F.col("content"), "[a-z]+"), quality._tokens(F.col("content")))
    assert "regexp_extract_all" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_batches_are_merged(spark, tmp_path):
    import pathlib

    from pressmill.streaming import ingest

    path, landed = f"{tmp_path}/counts", f"{tmp_path}/landed"
    want, held = {}, []
    for batch in range(23):
        rows = [(dt.datetime(2024, 1, 1 + (batch * k) % 9), "ab"[k % 2]) for k in range(4)]
        spark.createDataFrame(rows, "ts timestamp_ntz, kind string").coalesce(1).write.mode("append").parquet(landed)
        for ts, kind in rows:
            want[(ts.strftime("%Y-%m-%d"), kind)] = want.get((ts.strftime("%Y-%m-%d"), kind), 0) + 1
    stream = spark.readStream.schema("ts timestamp_ntz, kind string").option("maxFilesPerTrigger", 1).parquet(landed)
    ingest.keep_counts(stream, lambda rows: ingest.daily_counts(rows, "ts", "kind"), path, f"{tmp_path}/checkpoint", merge_every=4).awaitTermination()

    def counts():
        rows = ingest.read_counts(spark, path, "kind").collect()
        assert len({(r["day"], r["kind"]) for r in rows}) == len(rows)
        return {(r["day"], r["kind"]): r["cnt"] for r in rows}

    def folders():
        return sorted(f.name for f in pathlib.Path(path).iterdir())

    assert counts() == want and len(folders()) <= 2 + 8
    # A total that was never finished isn't read and is written anew.
    before = folders()
    broken = pathlib.Path(path, "total=22")
    broken.mkdir()
    assert counts() == want
    ingest.merge_counts(spark, path)
    assert counts() == want and folders() != before
    # A batch that a total holds changes nothing when the stream repeats it after a failure.
    newest = max(pathlib.Path(f"{tmp_path}/checkpoint/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink()
    ingest.keep_counts(stream, lambda rows: ingest.daily_counts(rows, "ts", "kind"), path, f"{tmp_path}/checkpoint", merge_every=4).awaitTermination()
    assert counts() == want


def test_pages_are_parsed_once(spark):
    """Filter, content and images share one evaluation of the container."""
    page = '<h1 id="activity-name">T</h1><div id="js_content">a<img src="/b.png"> c</div>'
    pages = spark.createDataFrame([(1, "https://e.org/x", page), (2, "https://e.org/y", None), (3, None, page)], "page_id long, url string, html string")
    covers = html.extract_articles(pages).select("page_id", "content", "images", "cover_image")
    assert covers._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["page_id"], r["content"]) for r in covers.orderBy("page_id").collect()] == [(1, "a\nc"), (3, "a\nc")]
    assert covers.filter("page_id = 1").first()["cover_image"] == "https://e.org/b.png"
