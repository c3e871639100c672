"""Lexicon matching.

Whole words: the text is cut into words once and met with the lexicon as a set, so
the cost does not grow with the number of keywords.  Keywords made of several words
or holding punctuation are few; each is searched as a substring first and only then
tested for its word boundaries.
"""

import re

from pyspark.sql import functions as F

from pressmill.functions.text import CJK, WORD, WORD_END, WORD_START, regex_quote

_WORD_ONLY = re.compile(r"\w+\Z")
_NO_STRINGS = "array(cast(null as string))"


def words(c):
    """Words of a text: maximal runs of letters, digits and underscores."""
    return F.split(c, f"[^{WORD}]+")


def whole_word_pattern(keyword):
    """Pattern of a keyword between word boundaries.

    A boundary is a change between word and other characters: at an edge that is
    punctuation (``c++``) a word character has to follow or precede.
    """
    before = WORD_START if _WORD_ONLY.match(keyword[0]) else f"(?<=[{WORD}])"
    after = WORD_END if _WORD_ONLY.match(keyword[-1]) else f"(?=[{WORD}])"
    return before + regex_quote(keyword) + after


def string_array(values):
    if not values:
        return F.array().cast("array<string>")
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")")


def exploded(df, keep, array, out):
    """One row per array element.

    Explodes in the outer form and drops the null rows afterwards: the inner form makes
    Spark push a size test of the array down and evaluate its expression twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(out)).filter(F.col(out).isNotNull())


def drop_nulls(arr):
    """Non-null elements of an array, each once."""
    return F.array_except(arr, F.expr(_NO_STRINGS))


def with_whole_words(df, lower_text, keywords, out):
    """Add the keywords that occur as whole words, in lexicon order.

    A keyword of several words is searched only where its first word occurs.
    """
    single = [k for k in keywords if _WORD_ONLY.match(k)]
    other = [k for k in keywords if not _WORD_ONLY.match(k)]
    lead = {k: re.match(r"\w+", k).group() for k in other}
    df = df.withColumn("_seen", F.array_intersect(
        string_array(list(dict.fromkeys(single + list(lead.values())))), words(F.col(lower_text))))
    if not other:
        return df.withColumn(out, F.col("_seen")).drop("_seen")
    text = F.col(lower_text)
    phrases = F.array(*[
        F.when(F.array_contains("_seen", lead[k]) & F.contains(text, F.lit(k))
               & text.rlike(whole_word_pattern(k)), F.lit(k)) for k in other])
    # Without a single hit on a first word no phrase is looked at.
    phrases = F.when(F.arrays_overlap("_seen", string_array(sorted(set(lead.values())))), phrases)
    if single:
        hits = F.when(phrases.isNull(), F.array_intersect(string_array(single), F.col("_seen"))).otherwise(
            F.array_intersect(string_array(keywords), F.concat(
                F.array_intersect(string_array(single), F.col("_seen")), phrases)))
    else:
        hits = F.coalesce(drop_nulls(phrases), F.array().cast("array<string>"))
    return df.withColumn(out, hits).drop("_seen")


def _is_cjk(needle):
    return re.search("[\u4e00-\u9fff]", needle) is not None


def with_cjk_flag(df, text, out="_cjk"):
    """Add whether the text holds any CJK letter: the gate of the CJK needles below."""
    return df.withColumn(out, F.col(text).rlike(f"[{CJK}]"))


def sql_text(value):
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tests(column, needles, gate, combine, none):
    """SQL that combines one substring test per needle; CJK needles only behind the gate.

    Written as SQL text: one expression with hundreds of tests is parsed faster than it is
    put together from column objects.
    """
    def all_of(group):
        tests = [f"contains(`{column}`, {sql_text(n)})" for n in group]
        return combine(tests) if tests else none
    if gate is None:
        return all_of(needles), None
    cjk = [n for n in needles if _is_cjk(n)]
    latin = [n for n in needles if not _is_cjk(n)]
    return all_of(latin), (f"coalesce(CASE WHEN `{gate}` THEN {all_of(cjk)} END, {none})" if cjk else None)


def count_present(column, needles, gate=None):
    """How many of the needles occur as substrings of a text column, given by name."""
    latin, cjk = _tests(column, needles, gate, lambda t: "(" + " + ".join(f"CAST({x} AS INT)" for x in t) + ")", "0")
    return F.expr(latin if cjk is None else f"{latin} + {cjk}")


def contains_one_of(text, needles):
    """Whether one of a few needles occurs in a text expression."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def column_contains(column, needles, gate=None):
    """Whether one of the needles occurs in a text column, given by name."""
    latin, cjk = _tests(column, needles, gate, lambda t: "(" + " OR ".join(t) + ")", "false")
    return F.expr(latin if cjk is None else f"({latin} OR {cjk})")


def mapped_values(column, mapping):
    """Values whose key occurs in a text column, each once, in map order."""
    cases = ", ".join(f"CASE WHEN contains(`{column}`, {sql_text(k)}) THEN {sql_text(v)} END" for k, v in mapping.items())
    return drop_nulls(F.expr(f"array({cases})"))


# Three shapes of identifiers: a cheap test that has to hold, then the pattern.
# Letters are ASCII, boundaries are Unicode.
CODE_SHAPES = [
    (r"[a-zA-Z0-9]\.[a-z]", WORD_START + r"[A-Z][a-zA-Z0-9]*\.[a-z][a-zA-Z0-9]*" + WORD_END),
    ("[a-z]-[a-z]", WORD_START + r"[a-z]+-[a-z]+" + WORD_END),
    ("[a-z]_[a-z]", WORD_START + r"[a-z]+_[a-z]+" + WORD_END),
]


def code_shapes(text):
    """Identifiers such as ``Client.get``, ``kebab-case`` and ``snake_case``."""
    none = F.array().cast("array<string>")
    return [F.when(text.rlike(test), F.regexp_extract_all(text, F.lit(p), F.lit(0)))
            .otherwise(none) for test, p in CODE_SHAPES]
