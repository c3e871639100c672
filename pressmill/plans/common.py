"""What the registered queries share: inputs, parameters, and SQL fragments.

Every query reads whole tables.  The SQL of an oracle states the definition of an
operator in another way (splits instead of counts, lists instead of windows), so that it
checks the Spark form and does not repeat it.
"""

from pyspark.sql import functions as F


from pressmill.functions.text import SPACE, WORD
from pressmill.sources.articles import articles_from_documents

AS_OF = "2024-02-01 00:00:00"

# Words that occur in the given documents, as a second lexicon.
PROBE_WORDS = ["the", "with", "que", "der", "und", "mit", "ai", "avec", "los", "license",
               "worthless", "apache"]
PROBE_LEXICON = {
    "english": (1.0, ["the", "with", "license", "worthless", "apache"]),
    "german": (0.9, ["der", "und", "mit", "apache"]),
    "romance": (1.2, ["que", "avec", "los", "license"]),
}


def articles(spark, sf_dir):
    return articles_from_documents(spark, sf_dir)


def plain_articles(spark, sf_dir):
    """Articles for queries that read no texts."""
    return articles_from_documents(spark, sf_dir, for_text=False)


def attempts(spark, sf_dir):
    """Events as ingest attempts of endpoints; errors are failures."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("host"),
        (F.col("user_id") % 7 + 8000).cast("int").alias("port"),
        "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"),
        "event_type")


# ------------------------------------------------------------------ SQL fragments

ARTICLES_SQL = """articles AS (
SELECT doc_id AS id, 'https://example.com/a/' || ((doc_id*9)//10)::VARCHAR AS url,
  substr(split_part(text, chr(10), 1), 1, 100) AS title, text AS content,
  CASE WHEN doc_id % 23 = 0 THEN NULL ELSE source END AS author, lang AS account_name,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_minutes((doc_id*7919) % 43200) END AS publish_time,
  TIMESTAMP '2024-01-02' + to_minutes((doc_id*104729) % 43200) AS crawl_time
FROM documents)"""

ATTEMPTS_SQL = """attempts AS (
SELECT 'host' || user_id::VARCHAR AS host, (user_id % 7 + 8000)::INTEGER AS port, ts, event_id AS seq,
  event_type <> 'error' AS ok, event_type FROM events)"""

IN_WINDOW = "crawl_time >= TIMESTAMP '2024-02-01' - INTERVAL {days} DAY"


def with_articles(body, *ctes):
    return "WITH " + ",\n".join([ARTICLES_SQL, *ctes]) + "\n" + body


def quote(text):
    return "'" + text.replace("'", "''") + "'"


def sql_list(values):
    return "[" + ", ".join(quote(v) for v in values) + "]"


def re2(literal):
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in literal)


def whole_word_sql(text, keyword):
    """Whole-word test for an engine without look-around."""
    import re
    word = re.compile(r"\w")
    before = f"(^|[^{WORD}])" if word.match(keyword[0]) else f"[{WORD}]"
    after = f"([^{WORD}]|$)" if word.match(keyword[-1]) else f"[{WORD}]"
    return f"regexp_matches({text}, {quote(before + re2(keyword) + after)})"


def hits_sql(text, keywords):
    """Keywords that occur as whole words, in lexicon order."""
    cases = ", ".join(f"CASE WHEN {whole_word_sql(text, k)} THEN {quote(k)} END" for k in keywords)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def shapes_sql(text):
    """Code shapes.  Letters beyond ASCII are first replaced by a word character that the
    shape cannot hold, other signs by a blank, so ASCII word boundaries are right."""
    blanked = f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}\\x00-\\x7F]', ' ', 'g')"
    low = f"regexp_replace({blanked}, '[^\\x00-\\x7F]', '_', 'g')"
    cap = f"regexp_replace({blanked}, '[^\\x00-\\x7F]', 'Z', 'g')"
    return (f"list_concat(list_concat(regexp_extract_all({low}, '\\b[A-Z][a-zA-Z0-9]*\\.[a-z][a-zA-Z0-9]*\\b'), "
            f"regexp_extract_all({low}, '\\b[a-z]+-[a-z]+\\b')), "
            f"regexp_extract_all({cap}, '\\b[a-z]+_[a-z]+\\b'))")


def keywords_cte(lexicon, where="TRUE", shapes=True):
    """``found``: articles with their distinct keywords."""
    hits = hits_sql("lower(title || ' ' || content)", lexicon)
    if shapes:
        hits = f"list_distinct(list_concat({hits}, {shapes_sql("(title || ' ' || content)")}))"
    return f"found AS (SELECT *, {hits} AS keywords FROM articles WHERE {where})"


def strip_sql(c):
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def present_sql(text, needles):
    """Number of needles that occur."""
    return "(" + " + ".join(f"contains({text}, {quote(n)})::INT" for n in needles) + ")"


def day_sql(c):
    return f"strftime({c}, '%Y-%m-%d')"


__all__ = [n for n in dir() if not n.startswith("_")]
