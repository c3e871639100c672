"""URL expressions."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions.matching import contains_one_of
from pressmill.functions.text import CJK, SPACE, nonempty, rstrip, strip


def _has_scheme(c):
    return c.startswith("http://") | c.startswith("https://")


_DIRTY = f"{SPACE}{CJK}"


def fixed_url(c):
    """Repair common damage of URLs.

    Takes the first of several URLs, drops a label in front (``text：http``), repairs
    scheme typos, adds ``https://`` to bare domains and cuts at blanks or CJK letters.
    Every step uses the text once, so the expression stays small wherever Spark puts it.
    """
    u = strip(F.coalesce(c, F.lit("")))
    u = F.regexp_replace(u, rf"(?s)^(?=.* ).*?(?<![^{SPACE}])(https?://[^{SPACE}]*).*$", "$1")
    # What stands between the first and the second "：http"; the ASCII colon counts only
    # where there is no full-width one.
    u = F.regexp_replace(u, "(?s)^(?:.*?：http(.*?)(?:：http.*)?|(?!.*：http).*?:http(.*?)(?::http.*)?)$", "http$1$2")
    for wrong, right in fv.SCHEME_TYPOS:
        u = F.replace(u, F.lit(wrong), F.lit(right))
    u = F.regexp_replace(u, r"(?s)^(?!https?://|ftp://|/)(?=.*\.)", "https://")
    u = rstrip(u)
    return F.regexp_replace(
        u, rf"(?s)^(?=https?://)(?=.*[{_DIRTY}])(?:.*?(https?://[^{_DIRTY}]+).*|.*)$", "$1")


def has_web_scheme(c):
    return _has_scheme(c)


# Domain, "localhost" or dotted address, optional port, then end, path or query.
VALID_URL = (
    rf"(?iu)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{{0,61}}[A-Z0-9])?\.)+[A-Z]{{2,6}}\.?"
    rf"|localhost|\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}{{1,3}}){{3}})(?::\p{{Nd}}+)?(?:/?|[/?][^{SPACE}]+)\n?\z"
)


def is_valid_url(c):
    return c.rlike(VALID_URL)


def is_history_link(c):
    """Link to an article as the history scan accepts it (L3)."""
    ok = (F.contains(c, F.lit(fv.ARTICLE_HOST))
          & (F.contains(c, F.lit("/s/")) | F.contains(c, F.lit("/s?")))
          & ~contains_one_of(c, fv.HISTORY_LINK_EXCLUDES))
    return F.coalesce(ok, F.lit(False))


def url_path(c):
    """Path of a URL, also for URLs that strict parsers refuse."""
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_query(c):
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def is_discovery_link(c, host=fv.ARTICLE_HOST, path_part="/s/", query_part="/s?"):
    """Link to an article as the discovery scan accepts it (L4)."""
    ok = (F.contains(c, F.lit(host))
          & (F.contains(url_path(c), F.lit(path_part)) | F.contains(url_query(c), F.lit(query_part)))
          & ~contains_one_of(c, fv.DISCOVERY_LINK_EXCLUDES))
    return F.coalesce(ok, F.lit(False))


def is_error_url(c):
    return F.coalesce(contains_one_of(F.lower(c), fv.ERROR_URL_PARTS), F.lit(False))


def is_error_title(c):
    return nonempty(c).isNull() | contains_one_of(c, fv.ERROR_TITLE_PARTS)


def _without_dots(path):
    """A path from the root with its ``.`` and ``..`` segments resolved, however many."""
    names = F.slice(F.split(path, "/"), 2, 1_000_000_000)
    last = F.element_at(names, -1)
    folded = F.aggregate(
        names, F.array().cast("array<string>"),
        lambda kept, name: F.when(name == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(name == ".", kept).otherwise(F.array_append(kept, name)))
    return F.concat(F.lit("/"), F.array_join(folded, "/"),
                    F.when(last.isin(".", "..") & (F.size(folded) > 0), "/").otherwise(""))


def absolute_url(base, ref):
    """A reference made absolute against the page it stands on.

    Covers full URLs, ``//host/path``, ``/path``, ``?query`` and relative paths,
    including ``.`` and ``..`` segments.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = url_path(base)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rest = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    joined = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref_path)
    merged = F.when(ref_path.startswith("/"), ref_path).otherwise(joined)
    tidy = _without_dots(merged)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref_path == "", F.concat(site, path, rest))
        .otherwise(F.concat(site, tidy, rest))
    )
