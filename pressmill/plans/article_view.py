"""Articles as a technical blog has them: the documents with words of the lexicons, phrases, signs right
beside words, code, links, images, lists and headings, spread by doc_id.

One SQL text serves Spark and DuckDB.
"""

from pressmill import fixed_values as fv
from pressmill.plans.common import ARTICLES_SQL, articles, quote

LEXICON_WORDS = list(dict.fromkeys(fv.TREND_KEYWORDS + [k for _, keys in fv.TAG_LEXICON.values() for k in keys]))
MARKERS = list(dict.fromkeys(
    [w for needles, _ in fv.DIFFICULTY.values() for w in needles] + [w for words in fv.CONTENT_TYPES.values() for w in words]
    + [w for words in fv.TECH_DEPTH.values() for w in words] + fv.NON_ORIGINAL_MARKERS + fv.ENGAGEMENT_PHRASES + fv.CONCLUSION_WORDS))
PATTERNS = ["how  to build", "Getting started with it", "introduction to it", "basic Spark tutorial", "advanced 用", "deep dive into it",
            "best practices for all", "optimizing queries", "source code analysis", "algorithm implementation", "under the hood", "research paper"]
NL = "chr(10)"
PARAGRAPH = f"{NL} || {NL}"
FENCE = f"'```' || {NL} || 'run(x_y, a-b)' || {NL} || '```' || {NL}"
# Every metric at its best: short paragraphs of plain sentences with what the lists look for.
FULL = ("'# Summary of an implementation' || " + PARAGRAPH + " || " + (" || " + PARAGRAPH + " || ").join(
    f"'{n}. The algorithm in part {n} has an architecture of its own, and its performance is part of our research. "
    f"Readers of part {n} will see what the source code does, and how a benchmark of it turns out in practice.'" for n in range(1, 12))
    + " || " + PARAGRAPH + " || '## Conclusion' || " + PARAGRAPH + " || '- What do you think? Let me know, share your thoughts, comment below? 讨论 交流 分享?' || " + PARAGRAPH
    + " || '![a](https://example.com/i.png) [b](https://example.com/b) ' || repeat('`x` ', 25) || " + f"repeat({FENCE}, 6)")


def pick(words, number):
    """The word of a list at a number that follows the rows."""
    return f"split_part({quote('|'.join(words))}, '|', CAST(1 + ({number}) % {len(words)} AS INT))"


WORD, SECOND = pick(LEXICON_WORDS, "id"), pick(LEXICON_WORDS, "id * 7 + 3")
RICH_CONTENT = f"""CASE WHEN id % 12 = 0 THEN {FULL} WHEN id % 50 = 7 THEN '' ELSE content || ' ' ||
CASE id % 6 WHEN 0 THEN upper({WORD}) || '.' WHEN 1 THEN '用' || {WORD} || '写' WHEN 2 THEN '(' || {WORD} || '), ' || {SECOND} || '!'
  WHEN 3 THEN {WORD} || 'x ' || {SECOND} || '_' WHEN 4 THEN {WORD} || ' ' || {SECOND} || ' ' || {WORD} ELSE 'c++x c# ' || {WORD} || '/' || {SECOND} END || ' ' ||
{pick(MARKERS, 'id * 3')} || ' ' || CASE WHEN id % 4 = 0 THEN {pick(MARKERS, 'id * 5 + 1')} || '; ' || {pick(PATTERNS, 'id')} ELSE '' END ||
CASE id % 9 WHEN 1 THEN {NL} || repeat({FENCE}, CAST(id % 7 AS INT)) WHEN 2 THEN repeat(' `Foo.bar`', CAST(id % 23 AS INT))
  WHEN 3 THEN {NL} || '## Heading ' || {WORD} || {NL} || '1. first item' || {NL} || '* second item'
  WHEN 4 THEN ' [link](https://example.com/l) ![image](https://example.com/i.png)' || repeat(' https://example.com/u', CAST(id % 13 AS INT))
  WHEN 5 THEN repeat({PARAGRAPH} || 'An open question, is it not? What do you think?', CAST(1 + id % 5 AS INT))
  WHEN 6 THEN repeat(' The same sentence comes again.', 5) ELSE '' END END"""
RICH_TITLE = f"CASE id % 5 WHEN 0 THEN {WORD} || ': ' || title WHEN 1 THEN {pick(PATTERNS, 'id * 5')} ELSE title END"
COLUMNS = "id, url, {title} AS title, {content} AS content, author, account_name, publish_time, crawl_time"
RICH_COLUMNS = COLUMNS.format(title=RICH_TITLE, content=RICH_CONTENT)
RICH_ARTICLES_SQL = (ARTICLES_SQL.replace("articles AS (", "plain_articles AS (", 1)
                     + f",\narticles AS (SELECT {RICH_COLUMNS} FROM plain_articles)")


def rich_articles(spark, sf_dir):
    return articles(spark, sf_dir).selectExpr(*[f"{RICH_TITLE} AS title" if c == "title" else f"{RICH_CONTENT} AS content" if c == "content" else c
                                                for c in ["id", "url", "title", "content", "author", "account_name", "publish_time", "crawl_time"]])
