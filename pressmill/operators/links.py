"""Links found in pages, and series of articles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions.text import SPACE, first_match, strip
from pressmill.functions.urls import is_history_link

_ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
_LINK_LIST = "array<struct<url:string,title:string>>"


def unescape_basic(c):
    """The entities that stand in attribute values and link texts."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def content_links(pages, source="content_link", keep=is_history_link):
    """Anchors to articles, of every page in order: url, title, source, list, pos (L1).

    ``keep`` is the test a URL has to pass (L3); None keeps every anchor.
    """
    anchors = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))
    rows = pages.select("page_id", F.posexplode(anchors).alias("pos", "_a"))
    text = F.regexp_replace(F.regexp_extract("_a", _ANCHOR, 2), "<[^>]*>", "")
    links = rows.select(
        "page_id", F.lit(0).alias("list"), "pos", unescape_basic(F.regexp_extract("_a", _ANCHOR, 1)).alias("url"),
        unescape_basic(text).alias("title"), F.lit(source).alias("source"))
    return links.filter(keep(F.col("url"))) if keep else links


def script_links(pages):
    """Links in lists that page scripts assign, source ``js_<list>`` (L2).

    ``list`` is the number of the list, ``pos`` the place in it.  The literal is read from
    its opening bracket by the JSON reader, which stops where the list ends, so no sign
    inside a title can cut it.
    """
    parts = []
    for i, (variable, name) in enumerate(fv.SCRIPT_LISTS.items()):
        literal = F.regexp_extract("html", rf"(?s)\b{variable}\s*=\s*(\[.*?)(?:</script|\z)", 1)
        items = F.from_json(literal, _LINK_LIST, {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"})
        parts.append(pages.filter(F.contains("html", F.lit(variable))).select(
            "page_id", F.posexplode(items).alias("pos", "_l")).select(
            "page_id", F.lit(i).alias("list"), "pos", F.col("_l.url").alias("url"),
            F.coalesce("_l.title", F.lit("")).alias("title"), F.lit(f"js_{name}").alias("source")))
    out = recommended_links(pages, len(parts))
    for p in reversed(parts):
        out = p.unionByName(out)
    return out.filter("url IS NOT NULL")


# An element that recommends, with all up to the end of the first element of its kind.
_RECOMMEND = r"(?is)<(\w+)\b[^>]*\bdata-role\s*=\s*[\"']?recommend[\"'\s>].*?</\1\s*>"


def recommended_links(pages, number=0):
    """The first article link of every element that recommends (L2, fourth list)."""
    elements = F.regexp_extract_all("html", F.lit(_RECOMMEND), F.lit(0))
    rows = pages.select("page_id", F.posexplode(elements).alias("pos", "_e"))
    anchors = F.filter(F.regexp_extract_all("_e", F.lit(_ANCHOR), F.lit(0)), lambda a: F.contains(
        F.regexp_extract(a, _ANCHOR, 1), F.lit(fv.ARTICLE_HOST)))
    rows = rows.withColumn("_a", F.get(anchors, F.lit(0))).filter("_a IS NOT NULL")
    def text(c):
        return unescape_basic(F.regexp_replace(c, "<[^>]*>", ""))
    own = text(F.regexp_extract("_a", _ANCHOR, 2))
    return rows.select(
        "page_id", F.lit(number).alias("list"), "pos", unescape_basic(F.regexp_extract("_a", _ANCHOR, 1)).alias("url"),
        F.when(own != "", own).otherwise(text(F.col("_e"))).alias("title"), F.lit("js_recommendations").alias("source"))


def first_per_url(*sources, order=("page_id", "list", "pos")):
    """Union of link sources; a URL keeps its first source."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(i))
        out = s if out is None else out.unionByName(s)
    w = Window.partitionBy("url").orderBy("_rank", *order)
    return out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_rank")


# Anchored shapes of series titles: (type, pattern with name and number).
SERIES_SHAPES = [
    ("hash_number", rf"^([^\n]+?)[{SPACE}]*#(\p{{Nd}}+)\n?\z"),
    ("parentheses_number", rf"^([^\n]+?)[{SPACE}]*\((\p{{Nd}}+)\)\n?\z"),
    ("episode_number", rf"^([^\n]+?)[{SPACE}]*第(\p{{Nd}}+)期\n?\z"),
    ("volume_number", rf"(?iu)^([^\n]+?)[{SPACE}]*Vol\.?(\p{{Nd}}+)\n?\z"),
]


def with_series(df, title="title"):
    """Add ``series_type, series_name, series_number`` of titles that name a series."""
    t = F.col(title)
    kind = name = number = None
    for label, shape in SERIES_SHAPES:
        hit = t.rlike(shape)
        parts = (F.lit(label), strip(F.regexp_extract(t, shape, 1)),
                 F.regexp_extract(t, shape, 2).try_cast("bigint"))
        if kind is None:
            kind, name, number = (F.when(hit, p) for p in parts)
        else:
            kind, name, number = kind.when(hit, parts[0]), name.when(hit, parts[1]), number.when(hit, parts[2])
    return df.withColumns({"series_type": kind, "series_name": name, "series_number": number})


# The leftmost marker decides, whatever its kind.
SERIES_NUMBER = r"(?iu)(?:#(\p{Nd}+)|第(\p{Nd}+)期|Vol\.?(\p{Nd}+)|\((\p{Nd}+)\))"


def series_number(title):
    """First number in a title that stands as ``#n``, ``第n期``, ``Vol.n`` or ``(n)``, else 0."""
    marker = first_match(title, SERIES_NUMBER, 0)
    return F.coalesce(F.regexp_extract(marker, r"(\p{Nd}+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def series_order(df, title="title", pos="pos", limit=None):
    """Articles by series number, first found first among equals."""
    out = df.withColumn("series_no", series_number(F.col(title))).orderBy("series_no", pos)
    return out.limit(limit) if limit else out
