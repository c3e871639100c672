"""Article fields from raw pages.

Single elements are read with regular expressions inside Spark.  Only the content
container, which nests, goes through Python: one Arrow-batched function around the
standard HTML parser.
"""

import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions import dates
from pressmill.functions.text import SPACE, first_match, nonempty, strip
from pressmill.functions.urls import absolute_url
from pressmill.operators.links import unescape_basic

# The parser travels to the workers with the job; they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VAR = r"(?s)\bvar\s+(\w+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\d+))"


def with_script_fields(pages):
    """Add ``js``: values of known script variables, null where a page sets none.

    All assignments of a page are found in one pass; the first of a variable counts.
    """
    df = pages.withColumn("_vars", F.transform(F.regexp_extract_all("html", F.lit(_VAR), F.lit(0)), lambda v: F.struct(
        F.regexp_extract(v, _VAR, 1).alias("name"),
        F.concat(*[F.regexp_extract(v, _VAR, i) for i in (2, 3, 4)]).alias("value"))))
    def value(name):
        return F.get(F.filter("_vars", lambda v: v["name"] == name), F.lit(0))["value"]
    return df.withColumn("js", F.struct(*[value(v).alias(k) for k, v in fv.SCRIPT_VARIABLES.items()])).drop("_vars")


def _opening(tag, attribute=None, value=None, token=False):
    """Pattern of an opening tag, with an attribute that equals or lists a value."""
    name = tag or "[a-zA-Z][a-zA-Z0-9]*"
    if attribute is None:
        return rf"<{name}\b[^>]*>"
    inner = rf"(?:[^\"'>]*\s)?{value}(?:\s[^\"'>]*)?" if token else value
    return rf"<({name})\b[^>]*\b{attribute}\s*=\s*[\"']{inner}[\"'][^>]*>"


def _element_pattern(selector):
    """Pattern whose last group is the inner HTML (or the ``content`` of a meta tag).

    Understands ``tag``, ``tag#id``, ``tag.class``, ``tag.class:contains("text")``,
    ``tag#id child`` and ``meta[property="name"]`` or ``meta[name="name"]``.
    """
    if selector.startswith("meta["):
        name = selector[5:-1].split("=", 1)[1].strip('"')
        return (rf"(?is)<meta\b(?=[^>]*\b(?:property|name)\s*=\s*[\"']{name}[\"'])"
                r"[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)
    child = None
    if " " in selector:
        selector, child = selector.split(" ")
    text = None
    if ":" in selector:
        selector, text = selector.split(":", 1)
        text = text.removeprefix("contains(").removesuffix(")").strip('"')
    if "#" in selector:
        tag, value = selector.split("#")
        opening = _opening(tag, "id", value)
    elif "." in selector:
        tag, value = selector.split(".")
        opening = _opening(tag, "class", value, token=True)
    else:
        tag, opening = selector, _opening(selector)
    if child:
        return rf"(?is){opening}(?:(?!</{tag}>).)*?<{child}\b[^>]*>(.*?)</{child}>", 1 + opening.startswith("<(")
    must = rf"(?=(?:(?!</{tag}>).)*{text})" if text else ""
    return rf"(?is){opening}{must}(.*?)</{tag}>", 1 + opening.startswith("<(")


def select_text(selector, html="html"):
    """Text of the first element a selector finds, null where it finds none."""
    pattern, group = _element_pattern(selector)
    inner = first_match(F.col(html), pattern, group)
    return strip(unescape_basic(F.regexp_replace(inner, rf"[{SPACE}]*<[^>]*>[{SPACE}]*", "")))


def first_selected(selectors, html="html"):
    """Text under the first selector that finds an element, even when it is empty."""
    return F.coalesce(*[select_text(s, html) for s in selectors])


class _ContainerReader(HTMLParser):
    """Text pieces and images of the first element that meets a selector."""

    def __init__(self, kind, value):
        super().__init__(convert_charrefs=True)
        self.kind, self.value = kind, value
        self.tag, self.depth, self.found, self.muted = None, 0, False, 0
        self.pieces, self.images = [], []

    def _is_container(self, tag, attrs):
        if self.kind == "id":
            return attrs.get("id") == self.value
        if self.kind == "class":
            return self.value in (attrs.get("class") or "").split()
        return tag == self.value

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if not self.found:
            if self._is_container(tag, attrs):
                self.found, self.tag, self.depth = True, tag, 1
            return
        if self.depth == 0:
            return
        if tag == self.tag:
            self.depth += 1
        if tag in ("script", "style"):
            self.muted += 1
        elif tag == "img":
            src = attrs.get("data-src") or attrs.get("src") or attrs.get("data-backup-src")
            if src:
                self.images.append(src)

    def handle_startendtag(self, tag, attrs):
        if tag == "img":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.found and self.depth > 0:
            if tag in ("script", "style") and self.muted:
                self.muted -= 1
            if tag == self.tag:
                self.depth -= 1

    def handle_data(self, data):
        if self.found and self.depth > 0 and not self.muted and data.strip():
            self.pieces.append(data.strip())


def _selector_parts(selector):
    if selector.startswith("#"):
        return "id", selector[1:]
    if selector.startswith("."):
        return "class", selector[1:]
    return "tag", selector


def container_reader(selectors):
    """Arrow function html -> (text, images) of the first selector that finds an element."""
    parts = [_selector_parts(s) for s in selectors]

    # Spark repeats deterministic functions where filters and columns use them: a Python worker each.
    @F.arrow_udf("struct<text:string,images:array<string>>")
    def read(html: pa.Array) -> pa.Array:
        texts, images = [], []
        for row in html:      # pages become Python strings one at a time
            page, text, found = row.as_py(), None, []
            for kind, value in parts:
                if page is None or value not in page:
                    continue
                reader = _ContainerReader(kind, value)
                reader.feed(page)
                reader.close()
                if reader.found:
                    text, found = "\n".join(reader.pieces), reader.images
                    break
            texts.append(text)
            images.append(found)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(images, pa.list_(pa.string()))], ["text", "images"])
    return read.asNondeterministic()


def with_container(pages, selectors=None):
    """Add ``text`` and the image references of the content container (H2, H6 raw)."""
    reader = container_reader(selectors or fv.CONTENT_SELECTORS)
    return (pages.withColumn("_box", reader("html"))
            .withColumns({"text": F.regexp_replace("_box.text", r"\n{3,}", "\n\n"),
                          "image_refs": F.coalesce("_box.images", F.array().cast("array<string>"))})
            .drop("_box"))


def page_title(selectors=None):
    """Script title, else the first title element (H1)."""
    return F.coalesce(strip(nonempty(F.col("js.title"))), first_selected(selectors or fv.TITLE_SELECTORS))


def page_author(selectors=None):
    """Author without the label in front (H3)."""
    found = first_selected(selectors or fv.AUTHOR_SELECTORS)
    return F.regexp_replace(found, rf"^作者[:：][{SPACE}]*", "")


def page_account(selectors=None):
    """Account name (H4)."""
    return F.coalesce(strip(nonempty(F.col("js.nickname"))), strip(nonempty(F.col("js.account_name"))),
                      first_selected(selectors or fv.ACCOUNT_SELECTORS))


def page_time(selectors=None):
    """Publication time: epoch seconds of the script, else the first element that reads (H5)."""
    epoch = F.timestamp_add("SECOND", F.col("js.publish_time").try_cast("bigint"),
                            dates.as_timestamp("1970-01-01 00:00:00"))
    return F.coalesce(epoch, *[dates.parse_date(select_text(s), dates.PAGE_FORMATS)
                               for s in (selectors or fv.TIME_SELECTORS)])


def has_element(selector, html="html"):
    """Whether a page holds an element ``#id``, ``.class`` or ``[attribute=value]``."""
    if selector.startswith("#"):
        pattern = _opening(None, "id", selector[1:])
    elif selector.startswith("."):
        pattern = _opening(None, "class", selector[1:], token=True)
    elif selector.startswith("["):
        attribute, value = selector[1:-1].split("=")
        pattern = _opening(None, attribute, value.strip('"'))
    else:
        pattern = _opening(selector)
    return F.col(html).rlike("(?is)" + pattern)


def is_blocked():
    """Page without content container that speaks of a captcha or a block (H9)."""
    container = F.lit(False)
    for s in fv.CRAWL_CONTENT_SELECTORS:
        container = container | has_element(s)
    return ~container & F.lower("html").rlike("|".join(fv.BLOCKED_PAGE_WORDS))


def extract_articles(pages, title=None, content=None, author=None, account=None, time=None, drop_blocked=True):
    """Article rows of raw pages (H1 to H10); pages without title or content are left out."""
    if drop_blocked:
        pages = pages.filter(~is_blocked())
    df = with_container(with_script_fields(pages), content)
    df = df.withColumns({
        "title": page_title(title), "author": page_author(author),
        "account_name": page_account(account), "publish_time": page_time(time),
        "images": F.array_distinct(F.transform("image_refs", lambda r: absolute_url(F.col("url"), r))),
    })
    og_image = first_match(F.col("html"), *_element_pattern('meta[property="og:image"]'))
    df = df.withColumn("cover_image", F.coalesce(
        nonempty(F.col("js.cdn_url")), og_image, F.try_element_at("images", F.lit(1))))
    usable = F.coalesce(F.col("title") != "", F.lit(False)) & F.coalesce(F.col("text") != "", F.lit(False))
    return df.filter(usable).select(
        "page_id", "url", "title", F.col("text").alias("content"), "author", "account_name",
        "publish_time", "images", "cover_image")
