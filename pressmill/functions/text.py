"""Text expressions.  All of them are built-in Spark functions.

White space and word characters follow Unicode: the character classes below are
written out because ``\\s`` and ``\\w`` mean something narrower in Java.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill import fixed_values as fv

SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"       # body of a class: every Unicode space
SPACE_IN_LINE = r"\t\x0b-\r\x1c-\x20\x85\p{Z}"  # the same without the line feed
# The characters of SPACE, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"                    # body of a class: letters, digits, underscore
CJK = r"一-鿿"
WORD_START = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"


def regex_quote(literal):
    """Quote a literal for Java regular expressions."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-#&~" else c for c in literal)


def unicode_spaces(pattern):
    """Spell ``\\s`` and ``[^\\s]`` of a pattern as Unicode white space."""
    return pattern.replace(r"[^\s]", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def unicode_words(pattern):
    """Spell ``\\s`` and ``\\w`` of a pattern in Unicode."""
    return unicode_spaces(pattern).replace(r"\w", f"[{WORD}]")


def strip(c):
    """Remove Unicode white space at both ends (``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(SPACES))


def rstrip(c):
    return F.rtrim(c, F.lit(SPACES))


def clean_field(c):
    """Null-safe strip: null becomes the empty string."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def is_blank(c):
    """True for null, empty and white space only."""
    return ~F.coalesce(c.rlike(rf"[^{SPACE}]"), F.lit(False))


def collapse_spaces(c):
    return F.regexp_replace(c, rf"[{SPACE}]+", " ")


def nonempty(c):
    return F.nullif(c, F.lit(""))


def first_match(c, pattern, group=1):
    """First capture of a pattern, null where the pattern does not occur."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def text_of(title="title", content="content"):
    """Title and body as one text."""
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "),
                    F.coalesce(F.col(content), F.lit("")))


def _as_column(c):
    return c if isinstance(c, Column) else F.col(c)


def clean_content(c):
    """Remove boilerplate and surplus blank lines from an article body.

    Every phrase pattern holds a CJK literal, so a text without CJK letters skips
    them and only the two layout patterns run.
    """
    c = _as_column(c)
    phrases, layout = fv.BOILERPLATE[:-2], fv.BOILERPLATE[-2:]
    full = c
    for p in phrases:
        full = F.regexp_replace(full, "(?isu)" + unicode_spaces(p), "")
    out = F.when(c.rlike(f"[{CJK}]"), full).otherwise(c)
    for p in layout:
        out = F.regexp_replace(out, unicode_spaces(p), "")
    blank_lines = unicode_spaces(r"\n\s*\n\s*\n")
    return strip(F.regexp_replace(out, blank_lines, "\n\n"))


def _marker(template, number):
    return "(?iu)" + unicode_spaces(template.replace("{n}", number))


def episode(title):
    """Episode number of a title as ``#n``, or the empty string."""
    title = _as_column(title)
    found = [first_match(title, _marker(m, r"(\p{Nd}+)")) for m in fv.EPISODE_MARKERS]
    return F.coalesce(F.concat(F.lit("#"), F.coalesce(*found)), F.lit(""))


def title_without_episode(title):
    """Title with every episode marker removed; unchanged when it has none."""
    title = _as_column(title)
    out = title
    for m in fv.EPISODE_MARKERS:
        out = strip(F.regexp_replace(out, _marker(m, r"\p{Nd}+") + f"[{SPACE}]*", ""))
    return F.when(episode(title) != "", out).otherwise(title)


def with_summary(df, cleaned="cleaned", out="introduce", limit=200):
    """Add a summary of an already cleaned body.

    A text over the limit is cut behind its last sentence mark when that lies in the
    last 30 %, else cut at the limit with dots added.
    """
    flat = strip(collapse_spaces(F.coalesce(F.col(cleaned), F.lit(""))))
    upto_mark = F.regexp_extract(F.col("_head"), r"(?s)^(.*[。！？.!?])", 1)
    return (
        df.withColumn("_flat", flat)
        .withColumn("_head", F.left("_flat", F.lit(limit)))
        .withColumn("_cut", upto_mark)
        .withColumn(out, F.when(F.length("_flat") <= limit, F.col("_flat"))
                    .when(F.length("_cut") - 1 > limit * 0.7, F.col("_cut"))
                    .otherwise(F.concat(F.col("_head"), F.lit("..."))))
        .drop("_flat", "_head", "_cut")
    )


def list_text(c):
    """Text for one-line lists: no HTML tags, single spaces."""
    c = _as_column(c)
    return strip(collapse_spaces(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")))


def truncate_words(c, limit=100):
    """Cut at the last blank when it lies in the last 20 %, add dots."""
    c = _as_column(c)
    head = F.left(c, F.lit(limit))
    upto_blank = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(F.length(upto_blank) > limit * 0.8, upto_blank).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("...")))


def file_name(c, brackets=False):
    """Name without characters that file systems refuse, at most 100 long."""
    c = _as_column(c)
    refused = r'[<>:"/\\|?*\[\]]' if brackets else r'[<>:"/\\|?*]'
    name = F.left(strip(F.regexp_replace(F.coalesce(c, F.lit("")), refused, "")), F.lit(100))
    return F.coalesce(nonempty(name), F.lit("untitled"))


def contains_any_case(c, needle):
    """``LIKE '%needle%'`` with only ASCII letters compared without case.

    ``%`` and ``_`` inside the needle stay wildcards.  The ``ilike`` test is the cheap
    one and lets through a superset; the regular expression settles the rest.
    """
    c = _as_column(c)
    like = "%" + needle.replace("\\", "\\\\") + "%"
    regex = "".join({"%": ".*", "_": "."}.get(ch, regex_quote(ch)) for ch in needle)
    return c.ilike(like) & c.rlike("(?is)" + regex)
